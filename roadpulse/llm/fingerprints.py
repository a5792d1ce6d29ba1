"""Canonical exact fingerprints of documents, in DataFrame functions alone.

A text's canonical form is case-folded (upper, then lower case), composed (NFC)
and has each run of white space as one space, none at the ends. Two chained
64-bit xxHashes of it make a 128-bit fingerprint. Documents with equal hashes are
grouped and their bytes compared: should different forms of documents ever share a
hash, each of them has its SHA-256 as a suffix, so that equal texts have equal fingerprints and others don't.

Composition: a text without combining marks or characters that NFC replaces
is composed already, which one pattern tells. In other texts the words that match
are decomposed by a table, have their marks put in canonical order, and are
composed again, mark by mark. The tables follow from Python's unicodedata.

Defined cases: null text is empty and has the fingerprint of the empty text;
repeated rows all stay; a null id comes after all others; rows of one id order by
text; a single row is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read_table

#: White space that a run is made of: Java's \\s, and what Unicode adds.
SPACES = "\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Marks follow one base at the most three times in a composed character; a fourth pass finds nothing.
PASSES = 3


def char_class(points: list[int]) -> str:
    """Inside of a Java character class for ascending code points."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def tables() -> dict:
    nfd, nfc = (lambda c, form=form: unicodedata.normalize(form, c) for form in ("NFD", "NFC"))
    split, marks, pairs, uneasy = {}, {}, {}, set()
    for p in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        if unicodedata.combining(c):
            marks[c] = unicodedata.combining(c)
            uneasy.add(p)
        if nfc(c) != c:
            uneasy.add(p)
        if 0xAC00 <= p < 0xD7A4:  # Hangul is composed by the same table, and never needs to be split
            continue
        if nfd(c) != c:
            split[c] = nfd(c)
            if nfc(c) == c:
                one, two = (chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
                pairs.setdefault(two, {})[one] = c
                uneasy.add(ord(two))
    for v in range(21):
        pairs[chr(0x1161 + v)] = {chr(0x1100 + k): chr(0xAC00 + (k * 21 + v) * 28) for k in range(19)}
        uneasy.add(0x1161 + v)
    for t in range(1, 28):
        pairs[chr(0x11A7 + t)] = {chr(0xAC00 + k * 28): chr(0xAC00 + k * 28 + t) for k in range(399)}
        uneasy.add(0x11A7 + t)
    return {
        "uneasy": "".join(map(chr, sorted(uneasy))),
        "marks": char_class(sorted(map(ord, marks))),
        "mark_text": "".join(marks),
        "mark_class": list(marks.values()),
        "split_text": "".join(split),
        "split_to": list(split.values()),
        "pairs": [(m, "".join(x), "".join(x.values())) for m, x in sorted(pairs.items())],
    }


def _composed_word(word: F.Column) -> F.Column:
    t = tables()
    split_to, mark_class = F.split(F.lit("|".join(t["split_to"])), "[|]"), F.split(F.lit("|".join(map(str, t["mark_class"]))), "[|]").cast("array<int>")
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(a).alias("bases"), F.lit(b).alias("wholes")) for m, a, b in t["pairs"]])

    def apart(c):
        at = F.instr(F.lit(t["split_text"]), c)
        return F.when(at > 0, F.get(split_to, at - 1)).otherwise(c)

    def rank(c):
        return F.get(mark_class, F.instr(F.lit(t["mark_text"]), c) - 1)

    def in_order(cluster):
        base = F.regexp_extract(cluster, f"^[^{t['marks']}]?", 0)
        rest = F.substring(cluster, F.length(base) + 1, F.length(cluster))
        ordered = F.array_join(F.array_sort(F.split(rest, ""), lambda x, y: rank(x) - rank(y)), "")
        return F.when(F.length(rest) > 1, F.concat(base, ordered)).otherwise(cluster)

    def join_mark(text, row):
        parts = F.split(text, row["m"], -1)

        def closed(p):
            last = F.right(p, F.lit(1))
            fits = (F.length(p) > 0) & (F.instr(row["bases"], last) > 0)
            return F.when(fits, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), F.call_function("translate", last, row["bases"], row["wholes"]))).otherwise(F.concat(p, row["m"]))

        joined = F.concat(F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), closed), ""), F.element_at(parts, -1))
        return F.when(F.contains(text, row["m"]), joined).otherwise(text)

    spread = F.array_join(F.transform(F.split(word, ""), apart), "")
    clusters = F.regexp_extract_all(spread, F.lit(f"[^{t['marks']}][{t['marks']}]*|[{t['marks']}]+"), F.lit(0))
    ordered = F.array_join(F.transform(clusters, in_order), "")
    ordered = F.when(spread.rlike(r"\p{M}{2}"), ordered).otherwise(spread)
    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), ordered, lambda acc, _: F.aggregate(pairs, acc, join_mark))


def canonical(text: F.Column) -> F.Column:
    """Case-folded, composed, white space folded; null is empty."""
    t = tables()
    folded = F.lower(F.upper(F.coalesce(text, F.lit(""))))
    spaced = F.trim(F.regexp_replace(folded, f" [{SPACES}]+|[{SPACES}&&[^ ]][{SPACES}]*", " "))

    def uneasy(part):
        # below U+0300 everything is composed; a table that deletes characters is faster than a class of many ranges
        return part.rlike(r"[^\x{0}-\x{2ff}]") & (F.length(F.translate(part, t["uneasy"], "")) < F.length(part))

    words = F.transform(F.split(spaced, " "), lambda w: F.when(uneasy(w), _composed_word(w)).otherwise(w))
    return F.when(uneasy(spaced), F.array_join(words, " ")).otherwise(spaced)


def wide_hash(form: F.Column) -> F.Column:
    """32 hex digits: XXH64 of the canonical form under two seeds."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), form)), 16, "0")))


def shared_by_different(documents: DataFrame) -> DataFrame:
    """Hashes whose texts differ in canonical bytes: none, but for a collision of 128 bits.

    Grouping by hash and form compares bytes inside each bucket and reduces copies before they are moved.
    """
    form = documents.select(canonical(F.col("text")).alias("form")).select(wide_hash(F.col("form")).alias("hash"), "form")
    return form.distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")


def dealt_by_descending_id(documents: DataFrame, parts: int) -> DataFrame:
    """Adds part and guest, dealt by part: ranges of doc_id whose upper ends are ids of the table.

    `parts` ids at most are on the driver. The first row of each range, by descending id, is also dealt,
    as a guest, to the range before it (that of the first range to the last), so that a row's next
    one is always in its own part and nothing is sorted in one task.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    shares = [i / parts for i in range(1, parts)] or [1.0]
    found = documents.select(key.alias("d")).agg(F.max("d").alias("top"), F.percentile_approx("d", shares, 10_000).alias("ends")).first()
    if found["top"] is None:
        return documents.withColumns({"part": F.lit(0), "guest": F.lit(0)})
    ends = sorted({*found["ends"], found["top"]})

    # the ends are one constant of the plan, searched by halving: the plan's size doesn't grow with the number of parts
    held = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(ends).bit_length()))])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(ends)) & (F.get(held, at + step - 1) < key), at + step).otherwise(at))
    placed = documents.withColumn("part", part)
    here = F.struct("part", F.lit(0).alias("guest"))
    there = F.struct((F.pmod(F.col("part") + 1, F.lit(len(ends)))).alias("part"), F.lit(1).alias("guest"))
    places = F.when(key == F.get(held, F.col("part")), F.array(here, there)).otherwise(F.array(here))
    return placed.select(*documents.columns, F.explode(places).alias("at")).select(*documents.columns, "at.part", "at.guest").repartition(parts, "part")


def edited_likeness(documents: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the first third of the next document. Likeness is 1
    where canonical bytes are equal and 0 elsewhere; bytes are compared only where hashes are equal.
    """
    dealt = dealt_by_descending_id(documents, parts)
    ready = dealt.withColumn("form", canonical(F.col("text"))).withColumn("hash", wide_hash(F.col("form")))
    order = W.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    paired = ready.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "form", "hash")}).where("guest = 0")
    third = F.floor(F.length("text") / F.lit(3)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    made = paired.withColumn("edited", edited).withColumn("edited_form", canonical(F.col("edited"))).withColumn("edited_hash", wide_hash(F.col("edited_form")))
    same = lambda other: F.when(F.col("hash") == F.col(f"{other}_hash"), (F.col("form") == F.col(f"{other}_form")).cast("double")).otherwise(F.lit(0.0))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("hash").alias("fingerprint"), F.col("edited_hash").alias("edited_fingerprint"), same("edited").alias("near_edited"), same("next").alias("near_next"), "form", "edited_form",
    )


def told_apart(made: DataFrame, clashes: DataFrame) -> DataFrame:
    """Fingerprints whose hash stands for different forms get the SHA-256 of their own form as a suffix, those of edited texts too. Clashes: hash."""
    for column, form in (("fingerprint", "form"), ("edited_fingerprint", "edited_form")):
        marked = clashes.select(F.col("hash").alias(column), F.lit(True).alias("_clash"))
        suffix = F.when(F.col("_clash"), F.concat(F.lit("-"), F.sha2(F.col(form).cast("binary"), 256))).otherwise(F.lit(""))
        made = made.join(marked.hint("merge"), column, "left").withColumn(column, F.concat(column, suffix)).drop("_clash")
    return made


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return fingerprinted(documents, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fingerprinted(documents: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) -> the columns of `edited_likeness`, collisions told apart."""
    made = edited_likeness(documents, parts)
    clashes = cut(shared_by_different(documents))
    if not clashes.isEmpty():
        made = told_apart(made, clashes)
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
