"""Fuzzy line dedup by MinHash, in DataFrame functions alone.

Lines (lower case, white space folded) are sets of character shingles; a line shorter
than a shingle is one shingle. A signature has one least value for each of GRID * ROWS
permutations of the shingles' hashes. A permutation is an exclusive or with a point of its own, so
every value agrees with the probability of the Jaccard similarity, whatever the sizes.
Bands are lines of a grid of these values, any two of which share one value at most; lines of text that agree in a band are candidates, and the
Jaccard similarity of their shingle sets, held as 64-bit hashes, decides. Links are joined into
components; of each the first line, by document and position, stays.

No pairs are made within a bucket. Its members are first compared with its most frequent line. Those that stay in other
components are compared with further heads, and what is then still apart meets
block by block, under a bound that no similar pair exceeds. So components are as if all pairs
of a bucket were compared. Copies count once: signatures are reduced by
line before they are moved, and lines that are very frequent are decided
by a broadcast whose size is bounded.

Defined cases: null text is empty; blank lines always stay; a line of any length goes if it equals
an earlier one; rows of one id and one text get the same result, other rows are told apart by their texts;
rows without an id come after all others; an empty table gives an empty result; columns of any name may stand beside doc_id and text.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read_table, tidy
from .components import connected_components

SHINGLE = 8
SIMILARITY = 0.8
#: GRID rows of ROWS values each; GRID is a prime above ROWS - 1. Bands are the rows, and CLASSES - 1 times as many lines of another slope.
#: Of pairs with a similarity of 0.8 bands find 98.0 %, of 0.85 99.5 %, of 0.9 99.9 % (simulated).
ROWS, GRID, CLASSES = 4, 5, 2
#: Shingles that one row carries while signatures are made.
STEP = 4
#: The bits of a shingle's hash that signatures are made of.
UPPER = -(1 << 32)
#: Members of a bucket, its most frequent lines, that all others of other components are compared with.
HEADS = 4
BLOCK = 1024
#: 64-bit words of a line's sketch, a power of two.
WORDS = 32
#: Lines that make up this share of all lines, at most one in it of them, are decided by broadcast.
HOT_SHARE = 512
#: Seconds after which a step's shuffle files, a good part of the input, are sure to be let go before the next step writes its own.
RELEASE = 1.5
#: The place of rows without an id.
LAST = (1 << 63) - 1


def points(n: int) -> list[int]:
    """Signed 64-bit points of the n permutations: a fixed series, evenly spread in their leading bits."""
    draw, lead = random.Random(8), (n - 1).bit_length()
    return [(x - (1 << 64) if x >> 63 else x) for x in ((i << (64 - lead)) | draw.getrandbits(64 - lead) for i in range(n))]


def folded(line: F.Column) -> F.Column:
    """Lower case; runs of white space are one space, none at the ends."""
    odd = [F.contains(line, F.lit(s)) for s in ("  ", "\t", "\r", "\f", "\x0b")]
    spaced = F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], F.regexp_replace(line, r"[\t\f\r\x0B ]+", " ")).otherwise(line)
    return F.trim(F.lower(spaced))


def blank(line: F.Column) -> F.Column:
    """True of lines whose folded form is empty. Asked of the line itself, as a filter on the form would have it folded twice."""
    return F.btrim(line, F.lit(" \t\r\f\x0b")) == ""


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> place, row, text: the order of ids, and what tells rows apart that aren't equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("place"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.alias("text"))


def line_rows(rows: DataFrame) -> DataFrame:
    """place, row, idx, form of the lines that aren't blank."""
    lines = rows.select("place", "row", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    return lines.where(~blank(F.col("line"))).select("place", "row", "idx", folded(F.col("line")).alias("form"))


def shingles(form: str) -> str:
    """SQL: the 64-bit hashes of a line's shingles, repeats included. The line is encoded once, by the outer step, and cut at places known beforehand."""
    return f"transform(array(encode({form}, 'UTF-32')), b -> transform(sequence(0, greatest(0, cast(octet_length(b) div 4 as int) - {SHINGLE})), i -> xxhash64(substring(b, 4 * i + 1, {4 * SHINGLE}))))[0]"


def signatures(forms: DataFrame) -> DataFrame:
    """(form) -> node, m0, m1, ..: one row per distinct form. Each row of shingles is two bytes a character (four beyond U+FFFF, which count as two), STEP shingles wide. Of a value the upper half counts, so that the rest is zeros, which take little room."""
    ends = F.expr(f"greatest(0, cast(octet_length(b) div 2 as int) - {SHINGLE})")
    bare = forms.select(F.xxhash64("form").alias("node"), F.encode("form", "UTF-16BE").alias("b")).select("node", "b", ends.alias("z"))
    starts = bare.select("node", "b", "z", F.explode(F.expr(f"sequence(0, z, {STEP})")).alias("i"))
    hashes = starts.select("node", *[F.expr(f"xxhash64(substring(b, 2 * least(i + {k}, z) + 1, {2 * SHINGLE})) & {UPPER}").alias(f"h{k}") for k in range(STEP)])
    least = lambda p: F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(p & UPPER)) for k in range(STEP)]))
    return hashes.groupBy("node").agg(*[least(p).alias(f"m{i}") for i, p in enumerate(points(GRID * ROWS))])


def band_values() -> list[list[int]]:
    """The numbers of each band's values: one in each column of the grid, along lines of CLASSES slopes."""
    rows = [[ROWS * t + c for c in range(ROWS)] for t in range(GRID)]
    return rows + [[ROWS * ((t + slope * c) % GRID) + c for c in range(ROWS)] for slope in range(1, CLASSES) for t in range(GRID)]


def band_rows(signed: DataFrame) -> DataFrame:
    """(node, copies, m0, m1, ..) -> node, key, copies: one row per band. Keys have 40 bits and stand before the copies, so that zeros come in one run; what shares a key by chance is told apart like all candidates."""
    keys = F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(b), *[f"m{v}" for v in values]), 24) for b, values in enumerate(band_values())])
    return signed.select("node", F.explode(keys).alias("key"), "copies")


def similar(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(a, b, both) nodes and the sizes of their shingle sets together -> those whose sets have a Jaccard similarity of SIMILARITY at least. The sets are of hashes, built once a pair."""
    a, b = (forms.select(F.col("node").alias(c), F.col("form").alias(f"form_{c}")) for c in ("a", "b"))
    near = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    shared = f"size(array_intersect({shingles('form_a')}, {shingles('form_b')}))"
    return near.where(F.expr(f"transform(array({shared}), n -> n >= {SIMILARITY} * (both - n))[0]")).select("a", "b")


def known_lines(occurrences: DataFrame) -> DataFrame:
    """node, copies, mixed (two forms under one hash), and a place to read the form from; copies are reduced on the map side."""
    of_node = occurrences.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.first("row").alias("row"), F.first("idx").alias("idx"))
    return of_node.select("node", "copies", (F.col("c1") != F.col("c2")).alias("mixed"), "row", "idx")


def bucket_members(rows: DataFrame, known: DataFrame) -> DataFrame:
    """key, node, head, at: a bucket's members after its head, the most frequent line. Lines that are alone in all their buckets end here."""
    keys = band_rows(signatures(line_rows(rows).select("form")).join(known.where("not mixed").select("node", "copies").hint("merge"), "node"))
    order = W.partitionBy("key").orderBy(F.desc("copies"), "node")
    return cut(keys.withColumns({"head": F.first("node").over(order), "at": F.row_number().over(order)}).where("at > 1").select("key", "node", "head", "at"))


def forms_of(members: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """node, form of all lines that have company in a bucket, read from one place each."""
    wanted = members.select("node").union(members.select("head")).distinct()
    places = known.join(wanted.hint("merge"), "node", "left_semi").groupBy("row").agg(F.collect_list(F.struct("idx", "node")).alias("places"))  # lines of one text
    whole = rows.join(places.hint("merge"), "row").select(F.split("text", "\n", -1).alias("lines"), "places")
    # n_lines is asked for so that the split stays a step of its own, done once a text
    found = whole.select(F.size("lines").alias("n_lines"), F.explode(F.transform("places", lambda at: F.struct(at["node"].alias("node"), F.get("lines", at["idx"]).alias("line")))).alias("one"))
    found = found.select("one.node", folded(F.col("one.line")).alias("form"), "n_lines").where(F.xxhash64("form") == F.col("node"))
    return cut(found.groupBy("node").agg(F.min("form").alias("form"), F.max("n_lines").alias("n_lines")))  # rows that are equal hold the line at one place


def line_components(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(node, component) of the hashes of different lines: what all links of at least SIMILARITY within buckets connect."""
    members = bucket_members(rows, known)
    tidy(members.sparkSession, RELEASE)
    forms = forms_of(members, rows, known)
    tidy(members.sparkSession, RELEASE)
    marks = cut(sketches(forms))
    links = cut(similar(within_bound(members.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), marks), forms))

    # what isn't like its bucket's head is compared with a few more members
    unlike = members.join(links.hint("merge"), (F.col("node") == F.col("a")) & (F.col("head") == F.col("b")), "left_anti")
    others = members.where(f"at <= {HEADS}").groupBy("key").agg(F.collect_list("node").alias("others"))  # HEADS at most
    pairs = unlike.join(others.hint("merge"), "key").select("node", F.explode("others").alias("other")).where("node <> other")
    more = similar(within_bound(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), marks), forms)
    links = cut(links.union(more))
    tidy(members.sparkSession, RELEASE)

    components = cut(connected_components(links))
    left = still_apart(members, components)
    if left.isEmpty():
        return components
    stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))  # they stand for the links that made them
    return connected_components(stars.union(similar(cut(block_pairs(left, marks)), forms)))


def still_apart(members: DataFrame, components: DataFrame) -> DataFrame:
    """All members, heads too, of the buckets that `components` leave apart: key, node, component, and n, the bucket's size. Buckets of at most HEADS are done by then."""
    everyone = members.select("key", "node").union(members.where("at = 2").select("key", "head"))
    named = everyone.join(components.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    named = cut(named)
    several = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where(f"lo < hi and n > {HEADS}")
    return cut(named.join(several.select("key", "n").hint("merge"), "key"))


def sketches(forms: DataFrame) -> DataFrame:
    """(node, form) -> node, size, w0..: the number of different shingles, and a bit for each place of a hash, the parity of the shingles that fall on it. So all but a few of the shingles that two lines don't share show."""
    h = forms.select("node", F.explode(F.array_distinct(F.expr(shingles("form")))).alias("h"))
    words = [F.expr(f"bit_xor(if(shiftright(h, 6) & {WORDS - 1} = {w}, shiftleft(1L, cast(h & 63 as int)), 0L))").alias(f"w{w}") for w in range(WORDS)]
    return h.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *words)


def bound(a: str, b: str) -> str:
    """SQL: two lines of s shingles together are similar only if the smaller has SIMILARITY of the larger's, which is asked first, and if d of them are in one alone and d (1 + SIMILARITY) <= s (1 - SIMILARITY); their words differ in at most d bits."""
    differ = " + ".join(f"bit_count({a}.w{k} ^ {b}.w{k})" for k in range(WORDS))
    return f"least({a}.size, {b}.size) >= {SIMILARITY} * greatest({a}.size, {b}.size) - 1e-6 and ({differ}) * {1 + SIMILARITY} <= ({a}.size + {b}.size) * {1 - SIMILARITY} + 1e-6"


def within_bound(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out, and `both`, the sizes of the two sets together."""
    l, r = (marks.select(F.col("node").alias(c), F.struct("size", *[f"w{k}" for k in range(WORDS)]).alias(f"of_{c}")) for c in ("a", "b"))
    return pairs.join(l.hint("merge"), "a").join(r.hint("merge"), "b").where(bound("of_a", "of_b")).select("a", "b", F.expr("of_a.size + of_b.size").alias("both"))


def block_pairs(left: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b, both) of a bucket in different components that their sketches don't rule out. Members fall into blocks by hash, and every two blocks meet under one key."""
    members = left.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    meet = members.withColumn("m", F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) as i, greatest(o, block) as j))")))
    met = meet.join(marks.hint("merge"), "node").select("key", "m.i", "m.j", "block", "component", *marks.columns)
    on = F.expr(f"l.key = r.key and l.i = r.i and l.j = r.j and l.node < r.node and l.component <> r.component and (l.i = l.j or l.block <> r.block) and {bound('l', 'r')}")
    return met.alias("l").join(met.alias("r").hint("merge"), on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.expr("l.size + r.size").alias("both")).distinct()


def joined_by_share(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join on a unique key of `groups`. Groups of over 1 / HOT_SHARE of all `total` rows, HOT_SHARE of them at most, are broadcast; others are merged."""
    hot = F.col(size) * HOT_SHARE > total
    few = F.broadcast(groups.where(hot))
    calm = rows.join(F.broadcast(groups.where(hot).select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(calm.join(groups.where(~hot).hint("merge"), on))


def occurrences_of(rows: DataFrame) -> DataFrame:
    """place, row, idx, node, check, n_lines of all lines that aren't blank, and of each row's first line, whose node is null if it is blank: so every row of the table has one at idx 0."""
    lines = rows.select("place", "row", F.split("text", "\n", -1).alias("lines")).select("place", "row", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("idx", "line"))
    hashed = lines.where(~blank(F.col("line")) | (F.col("idx") == 0)).select("place", "row", "idx", "n_lines", folded(F.col("line")).alias("form"))
    mark = lambda *c: F.when(F.col("form") != "", F.xxhash64(*c))
    return hashed.select("place", "row", "idx", mark("form").alias("node"), mark(F.lit("line"), F.col("form")).alias("check"), "n_lines")


def removed_lines(documents: DataFrame, occurrences: DataFrame | None = None) -> DataFrame:
    """doc_id, row, removed: ascending positions of the lines that an earlier line of their component stands for. `keyed` tells what a row is."""
    rows = keyed(documents)
    occurrences = (cut(occurrences_of(rows)) if occurrences is None else occurrences).where("node is not null")
    known = cut(known_lines(occurrences))
    components = line_components(rows, known)
    total = known.agg(F.sum("copies")).first()[0] or 0
    named = known.join(components.hint("merge"), "node", "left").where("copies > 1 or component is not null")
    named = cut(named.select("node", "copies", "mixed", F.coalesce("component", "node").alias("component")))
    tidy(rows.sparkSession, RELEASE)
    touched = joined_by_share(occurrences, named, ["node"], "copies", total)
    # different lines under one hash are told apart by a second one
    touched = cut(touched.select("place", "row", "idx", "component", F.when(F.col("mixed"), F.col("check")).otherwise(0).alias("form")))
    groups = cut(touched.groupBy("component", "form").agg(F.min(F.struct("place", "row", "idx")).alias("first"), F.count(F.lit(1)).alias("n")))
    gone = joined_by_share(touched, groups, ["component", "form"], "n", total).where(F.struct("place", "row", "idx") != F.col("first"))
    gone = gone.groupBy("place", "row").agg(F.sort_array(F.collect_set("idx")).alias("removed"))
    return gone.select(F.nullif("place", F.lit(LAST)).alias("doc_id"), "row", "removed")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The same rows and columns, `text` without the removed lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = documents.select(F.struct("*").alias("whole"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.alias("text"))
    joined = whole.join(removed_lines(documents).select("row", "removed").hint("merge"), "row", "left")
    stay = F.expr("array_join(transform(array_except(sequence(0, size(split(text, '\\n')) - 1), removed), i -> get(split(text, '\\n'), i)), '\\n')")
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(stay)
    return joined.select(*[kept.alias("text") if c == "text" else F.col(f"whole.`{c}`").alias(c) for c in documents.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, and the removed positions, comma-joined."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    occurrences = cut(occurrences_of(keyed(documents)))
    counts = occurrences.where("idx = 0").select(F.nullif("place", F.lit(LAST)).alias("doc_id"), "row", F.col("n_lines").cast("long").alias("n_lines"))
    out = counts.join(removed_lines(documents, occurrences).select("row", "removed").hint("merge"), "row", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))
