"""Conversation repair by a dynamic programme whose layers a trie shares.

Turns stand by number, role and text. Each gets one letter, its signature: `x` for one that has to go (blank, or
said before), else the initial of its role, `o` for other roles, in capitals if its text breaks off. The cheapest edits that
make a conversation `(s?(ua)+)?` depend on its letters alone. Signatures are sorted, so that neighbours share their prefixes;
a task walks them as a prefix trie with one layer of the programme a letter, and steps back to the
common prefix where the next one branches off. Equal signatures stand together but may go to several
tasks, each of which works them out once, so a signature that a third of all conversations have is no burden.

A layer holds, for each of four states (nothing yet, system, user, assistant), the least cost and the first of the cheapest edit
strings. Of two such strings none is the start of the other, as they name the same rows at the same cost; so the
first stays first however they go on. What all states' strings share goes to a stem that layers have in common.

Equal rows are counted before they are moved, and a role and text's first turn is an aggregate, so repeats without end are no burden
either. A conversation streams past one task in order, one letter a row held; its texts are never gathered.

Defined cases: a null role or text is one space, a null turn comes first, a null conv_id is a conversation of its own; equal
rows of a turn stand together, the later ones being duplicates; blank rows count as blank, not as duplicates; gaps beyond a long are
the greatest long; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, cut, read_table

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Layers that a task keeps for prefixes to come, and the letters of a tail before it becomes part of the stem.
LAYERS, TAIL = 65_536, 64
MOST = (1 << 63) - 1
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long"


def units(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) -> conv, turn, role, text, copies, fault, letter: one row for equal rows, `fault` and `letter` being those of the first one.

    A conversation whose rows have no copies is kept by one row with none.
    """
    there = F.col("copies") > 0
    read = lambda c: F.when(there, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("").alias(c)
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.when(there, F.col("turn").cast("long")).alias("turn"), read("role"), read("text"), "copies")
    counted = cut(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies")))
    said = counted.where(there).groupBy("conv", "role", "text").agg(F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("least"))
    on = ["conv", "role", "text"]
    joined = counted.join(said.hint("merge"), on, "left")
    again = F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", "b").when(again, "d").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    initial = F.left("role", F.lit(1))
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(plain)).otherwise(plain)
    return joined.select("conv", "turn", "role", "text", "copies", fault.alias("fault")).withColumn("letter", letter)


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "text")


def signatures(marked: DataFrame) -> DataFrame:
    """Units -> conv, signature and the counts of REPORT, one row a conversation."""
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, done = None, None, []

        def flush():
            if state is not None:
                low, high, turns = state["turns"]
                gaps = 0 if low is None else min(MOST, high - low + 1 - turns)
                done.append((conv, "".join(state["letters"]), gaps, state["b"], state["d"], state["t"], state["illegal"]))

        for b in batches:
            for key, turn, initial, copies, fault, letter in zip(b["conv"], b["turn"], b["initial"], b["copies"], b["fault"], b["letter"]):
                if state is None or key != conv:
                    flush()
                    conv, state = key, {"letters": [], "turns": (None, None, 0), "b": 0, "d": 0, "t": 0, "illegal": 0, "last": None}
                copies = int(copies)
                if not copies:
                    continue
                if turn is not None:
                    number, (low, high, turns) = int(turn), state["turns"]
                    state["turns"] = (number if low is None else low, number, turns + (number != high))
                state["letters"].append(letter + "x" * (copies - 1))
                more = fault if fault in ("b", "d") else "d"  # of further copies
                state[more] += copies - 1
                if fault:
                    state[fault] += 1
                state["illegal"] += copies - 1 + (state["last"] is not None and state["last"] + initial not in legal)
                state["last"] = initial
            yield pd.DataFrame(done, columns=names)
            done.clear()
        flush()
        yield pd.DataFrame(done, columns=names)

    names = ["conv", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
    slim = in_order(marked).select("conv", F.col("turn").cast("string").alias("turn"), F.left("role", F.lit(1)).alias("initial"), "copies", "fault", "letter")
    return slim.mapInPandas(run, f"conv string, signature string, {REPORT}")


Layer = tuple[tuple | None, dict[int, tuple[int, str]]]


def _offer(states: dict[int, tuple[int, str]], state: int, cost: int, edits: str) -> None:
    if state not in states or (cost, edits) < states[state]:
        states[state] = cost, edits


def with_inserts(states: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """User turns put in wherever one may follow, then assistant turns."""
    out = dict(states)
    for state in (START, SYSTEM, ASSISTANT):
        if state in states:
            _offer(out, USER, states[state][0] + INSERT, states[state][1] + "I")
    if USER in out:
        _offer(out, ASSISTANT, out[USER][0] + INSERT, out[USER][1] + "I")
    return out


def first_layer() -> Layer:
    return None, {START: (0, "")}


def next_layer(layer: Layer, letter: str) -> Layer:
    stem, states = layer
    out: dict[int, tuple[int, str]] = {}
    role, broken = letter.lower(), BROKEN if letter.isupper() else 0
    for state, (cost, edits) in with_inserts(states).items():
        _offer(out, state, cost + DELETE, edits + "D")
        if letter == "x":
            continue
        after = ASSISTANT if state == USER else USER
        _offer(out, after, cost + REROLE + broken, edits + "R")
        if role == "ua"[after - USER]:
            _offer(out, after, cost + KEEP + broken, edits + "K")
        elif role == "s" and state == START:
            _offer(out, SYSTEM, cost + KEEP + broken, edits + "K")
    if ASSISTANT in out:  # who may go on with a user turn can do what the others can, but for keeping a system turn, which may be deleted
        cost = out[ASSISTANT][0]
        out = {s: v for s, v in out.items() if not (s == START and v[0] > cost + DELETE or s == SYSTEM and v[0] > cost)}
    shared = os.path.commonprefix([edits for _, edits in out.values()])
    if len(shared) >= TAIL:
        stem, out = (stem, shared), {s: (c, e[len(shared) :]) for s, (c, e) in out.items()}
    return stem, out


def answer(layer: Layer) -> tuple[int, str]:
    """Least cost and first cheapest edits of what ends here."""
    stem, states = layer
    ends = with_inserts(states)
    cost, edits = min(ends[s] for s in (START, ASSISTANT) if s in ends)
    pieces = [edits]
    while stem is not None:
        stem, piece = stem
        pieces.append(piece)
    return cost, "".join(reversed(pieces))


def solve(sorted_signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Answers of signatures that come in order: a walk through their trie."""
    layers, before, found = [first_layer()], None, None
    for signature in sorted_signatures:
        if signature != before:
            shared = 0 if before is None else len(os.path.commonprefix([before, signature]))
            del layers[shared + 1 :]
            layer = layers[-1]
            for letter in signature[len(layers) - 1 :]:
                layer = next_layer(layer, letter)
                if len(layers) < LAYERS:
                    layers.append(layer)
            before, found = signature, answer(layer)
        yield found


def audits(marked: DataFrame) -> DataFrame:
    """Units -> conv, the counts of REPORT, cost and audit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def stream():
            for b in batches:
                held.append(b)
                yield from b["signature"]

        answers, got = solve(stream()), []
        for found in answers:
            got.append(found)
            if len(got) == len(held[0]):
                b = held.pop(0).drop(columns="signature")
                b["cost"], b["audit"] = [c for c, _ in got], [a for _, a in got]
                got = []
                yield b

    found = cut(signatures(marked))
    tried = found.repartitionByRange("signature", "conv").sortWithinPartitions("signature")
    return tried.mapInPandas(run, f"conv string, {REPORT}, cost long, audit string")


def edited(marked: DataFrame, audit: DataFrame) -> DataFrame:
    """Units and audits -> conv, edit, role, text of the repaired turns, in order inside a partition, each conversation whole in one; a first row without an edit opens each."""
    names = {USER: "user", ASSISTANT: "assistant"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, edits, at, state, done = None, "", 0, START, []

        def insert():
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                state, at = (ASSISTANT if state == USER else USER), at + 1
                done.append((conv, "I", names[state], ""))

        for b in batches:
            for key, opens, role, text, copies in zip(b["conv"], b["audit"], b["role"], b["text"], b["copies"]):
                if opens is not None:
                    insert()  # the last ones of the conversation before
                    conv, edits, at, state = key, opens, 0, START
                    done.append((conv, None, None, None))
                    continue
                for _ in range(int(copies)):
                    insert()
                    edit, at = edits[at], at + 1
                    if edit == "D":
                        continue
                    state = ASSISTANT if state == USER else SYSTEM if edit == "K" and role[:1] == "s" else USER
                    done.append((conv, edit, role if edit == "K" else names[state], text))
            yield pd.DataFrame(done, columns=columns)
            done.clear()
        insert()
        yield pd.DataFrame(done, columns=columns)

    columns = ["conv", "edit", "role", "text"]
    rows = marked.select("conv", F.lit(1).alias("part"), "turn", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = audit.select("conv", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    return in_order(heads.unionByName(rows), "part").select("conv", "audit", "role", "text", "copies").mapInPandas(run, "conv string, edit string, role string, text string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text, copies) -> audits (conv, counts, cost, audit) and edited turns."""
    marked = cut(units(turns))
    audit = cut(audits(marked))
    return audit, edited(marked, audit)


def digests(turns: DataFrame) -> DataFrame:
    """Edited turns -> conv, repaired_sha256 over `role:text`, newline-joined; a narrow step, so that the order of `edited` holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, lines, done = None, None, 0, []
        for b in batches:
            for key, edit, role, text in zip(b["conv"], b["edit"], b["role"], b["text"]):
                if edit is None:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state, lines = key, hashlib.sha256(), 0
                    continue
                state.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
            done.clear()
        yield pd.DataFrame([] if state is None else [(conv, state.hexdigest())], columns=["conv", "repaired_sha256"])

    return turns.mapInPandas(run, "conv string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations as the contract damages them; copies is 0 for a row that is dropped, 2 for a repeated one."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")), "UTF-8")) % 20
    text: Column = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit, turns = repair(damaged(read_table(spark, sf_dir, "conversations")))
    found = audit.join(digests(turns).hint("merge"), "conv")
    return found.select(F.expr("cast(nullif(conv, '') as bigint) as conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: The programme row by row over all states: `moves` are the inserts that may precede an edit, `steps` the edits.
OP13_SQL = f"""
with recursive raw as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
    from conversations
), turns as (
    select conv_id, turn, if(kind = 4, 'user', role) as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
    from raw, range(if(kind = 3, 2, 1)) where kind <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from turns
), ends as (
    select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed, row_number() over (partition by conv_id, role, text order by i) as said from placed
), rows as (
    select conv_id, turn, role, text, i, role[:1] as r, lag(role[:1]) over (partition by conv_id order by i) || role[:1] as pair,
        case when trimmed = '' then 'blank' when said > 1 then 'duplicate' when trimmed[-1:] not in ('.', '!', '?') then 'truncated' else '' end as fault
    from ends
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
        count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
    from rows group by conv_id
), moves(state, via, edits, put) as (
    values (0, 0, '', []::varchar[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
        (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])
), steps(via, edit, r, goes) as (
    values (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3), (0, 'R', '', 2), (1, 'R', '', 2), (2, 'R', '', 3), (3, 'R', '', 2),
        (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3)
), ways as (
    select conv_id, 0::bigint as i, 0 as state, {{'cost': 0, 'edits': '', 'body': []::varchar[]}} as best from counts
    union all
    select w.conv_id, x.i, s.goes, min({{
        'cost': w.best.cost + 3 * length(m.edits) + case s.edit when 'D' then 4 when 'R' then 3 else 0 end + if(s.edit <> 'D' and x.fault = 'truncated', 3, 0),
        'edits': w.best.edits || m.edits || s.edit,
        'body': list_concat(w.best.body, m.put, case s.edit when 'D' then [] when 'R' then [if(s.goes = 3, 'assistant:', 'user:') || x.text] else [x.role || ':' || x.text] end)}})
    from ways w join rows x on x.conv_id is not distinct from w.conv_id and x.i = w.i + 1 join moves m on m.state = w.state join steps s on s.via = m.via
    where s.edit = 'D' or x.fault not in ('blank', 'duplicate') and (s.edit = 'R' or s.r = x.r)
    group by w.conv_id, x.i, s.goes
), done as (
    select w.conv_id, min({{'cost': w.best.cost + 3 * length(m.edits), 'edits': w.best.edits || m.edits, 'body': list_concat(w.best.body, m.put)}}) as best
    from ways w join counts c on c.conv_id is not distinct from w.conv_id and w.i = c.n join moves m on m.state = w.state where m.via in (0, 3) group by w.conv_id
)
select a.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal,
    coalesce(d.best.cost, 0)::bigint as cost, coalesce(d.best.edits, '') as audit, sha256(coalesce(array_to_string(d.best.body, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join counts c on c.conv_id is not distinct from a.conv_id left join done d on d.conv_id is not distinct from a.conv_id
"""
