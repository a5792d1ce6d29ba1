"""Conversation repair against a plain version, from the last row to the first."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import repair

GOES = {"start": "u", "s": "u", "u": "a", "a": "u"}  # what a turn that is put in or given a role becomes


def best(rows):
    """(cost, audit, repaired) of rows (initial, must go, broken, role, text)."""

    @cache
    def after(i, state, inserts):
        found = []
        if inserts:
            cost, audit, body = after(i, GOES[state], inserts - 1)
            role = {"u": "user", "a": "assistant"}[GOES[state]]
            found.append((cost + 3, "I" + audit, (f"{role}:", *body)))
        if i == len(rows):
            if state in ("start", "a"):
                found.append((0, "", ()))
            return min(found, default=(10**9, "", ()))
        initial, gone, broken, role, text = rows[i]
        cost, audit, body = after(i + 1, state, 2)
        found.append((cost + 4, "D" + audit, body))
        if not gone:
            cost, audit, body = after(i + 1, GOES[state], 2)
            name = {"u": "user", "a": "assistant"}[GOES[state]]
            found.append((cost + 3 + 3 * broken, "R" + audit, (f"{name}:{text}", *body)))
            kept = "s" if initial == "s" and state == "start" else GOES[state] if initial == GOES[state] else None
            if kept:
                cost, audit, body = after(i + 1, kept, 2)
                found.append((cost + 3 * broken, "K" + audit, (f"{role}:{text}", *body)))
        return min(found)

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20 * len(rows) + 1000))
    try:
        return after(0, "start", 2)
    finally:
        sys.setrecursionlimit(limit)


def plain(table):
    """The contract over rows (conv_id, turn, role, text)."""
    of = defaultdict(list)
    for conv, turn, role, text in table:
        of[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        of[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, turns in of.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, rows, faults = set(), [], Counter()
        for _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, body = best(tuple(rows))
        yield conv, min(gaps, repair.MOST), faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()


def test_signatures_of_any_kind(monkeypatch):
    """Random signatures, sorted, with repeats; stems and kept layers so short that every way is taken."""
    rng = random.Random(13)
    drawn = ["".join(rng.choice("suaoxSUAO" if i % 3 else "sua") for _ in range(rng.randrange(i % 14 + 1))) for i in range(900)]
    drawn = sorted(drawn + ["", "s", "ss", "ua" * 9, "su" + "au" * 7, "u" * 12, "a" * 12, "s" * 9])
    want = [best(tuple(("" if c in "oO" else c.lower(), c == "x", c.isupper(), "", "") for c in s))[:2] for s in drawn]
    for layers, tail in ((65_536, 64), (3, 1), (1, 2)):
        monkeypatch.setattr(repair, "LAYERS", layers)
        monkeypatch.setattr(repair, "TAIL", tail)
        assert list(repair.solve(iter(drawn))) == want


def test_layers_are_shared(monkeypatch):
    made = []
    step = repair.next_layer
    monkeypatch.setattr(repair, "next_layer", lambda layer, letter: made.append(letter) or step(layer, letter))
    assert len(list(repair.solve(iter(["ua", "ua", "uau", "uaua", "uax", "x"])))) == 6 and len(made) == 6


def test_a_long_signature():
    """Time and memory in proportion to its length: some ten thousand letters a second at the least."""
    s = "".join(random.Random(1).choice("uuaasxUAo") for _ in range(60_000))
    (cost, audit), = repair.solve(iter([s]))
    assert cost > 0 and sum(e != "I" for e in audit) == len(s)


ROWS = [
    (None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, 0, "", "é!"), (1, 0, "system", "x?"), (1, 5, "assistant", "b.\u0085"), (1, 9, "assistant", "a. \n"),
    (2, -(1 << 63), "user", "a."), (2, (1 << 63) - 1, "assistant", "b."), (3, 0, "user", ""), (3, 1, "assistant", "\t\n"), (4, 2, "tool", "long " * 30_000), (5, 1, "User", "x."), (5, 2, "assistant", "y."),
]


@pytest.mark.parametrize("kind", ["odd", "many", "crowd", "empty"])
def test_against_plain_version(spark, monkeypatch, kind):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "so", "", " ", "Why?", "Yes. ", "a.b"]
    rows = {
        "odd": ROWS,
        "many": [(c, rng.choice([None, t, t, t, t + 1]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice([None, *texts])) for c in range(160) for t in range(rng.randrange(9))],
        "crowd": [(7, t % 40, "user", "same.") for t in range(600)] + [(7, 3, "assistant", f"{t}.") for t in range(50)] + [(i, t, "ua"[t % 2], "x.") for i in range(30) for t in range(4)],
        "empty": [],
    }[kind]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "copies": F.lit("x"), "letter": F.lit(None)})
    monkeypatch.setattr(repair, "read_table", lambda *_: df)
    got = repair.op13_conversation_repair(spark, "")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows))


def test_turns_that_come_out(spark):
    """The general form: edited turns themselves, of conversations as they are."""
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (1, 2, "assistant", "Yes."), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    audit, edited = repair.repair(turns.withColumn("copies", F.lit(1)))
    assert {(r["conv"], r["cost"], r["audit"]) for r in audit.collect()} == {("1", 3, "KIKK"), ("2", 4, "D")}
    out = [(r["conv"], r["edit"], r["role"], r["text"]) for r in edited.collect() if r["edit"]]
    assert out == [("1", "K", "user", "Hi."), ("1", "I", "assistant", ""), ("1", "K", "user", "Well?"), ("1", "K", "assistant", "Yes.")]
