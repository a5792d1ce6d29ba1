"""Merkle manifest of a dataset: ranks by digit histograms, tries keyed by the digits of ranks.

Every row is a leaf, a SHA-256 of its fields. The leaves of a group ascend by id, and runs of `fanout`
consecutive nodes become one, until one is left; the groups' roots then do the same.

Ranks come without a global sort. Ids are cut into digits of eight bits; of each group the histogram of a
digit holds at most 256 counts, and their sums, handed down digit by digit, are the ranks at which buckets
of 256 ids begin. Only digits in which ids differ are counted. Inside a bucket rows are numbered. Rows that share an
id are ranked in the same way by the digits of their leaves, and equal rows are counted first and numbered by chunks,
so no id and no row, however often it comes, is held in one place.

A rank's digits to the base `fanout` are its path in the trie. All ranks with one prefix, short of `HEIGHT`
digits, are reduced together, HEIGHT levels at a time, so a group of rows is never above fanout ** HEIGHT, whatever the
size of a source, and ten thousand million leaves take four steps. On the way back every block learns the siblings
above it; leaves are folded in the block that they stand in.

Defined cases: nulls of any field hash as `-`; a null id stands where the least long stands, and its text counts
as empty for the choice of rows to tamper with; rows of one id ascend by leaf; equal rows are leaves of their own; a null group comes before all others; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_sql, cut, read_table

FANOUT = 3
#: Levels that are reduced in one step.
HEIGHT = 6
DIGIT = 8
#: Copies of one row that one task numbers.
CHUNK = 4096
LEAST = -(1 << 63)


def field(value: Column) -> Column:
    """`-`, or the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def leaves_of(rows: DataFrame, group: str, id: str, fields: list[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """-> grp, id, doc_id, leaf, other: the leaf after tampering, null where it didn't change.

    `grp` is a text without nulls whose bytes order as groups do: empty for a null group, else a letter and the group.
    """
    tampered = tampered or {}
    changed = leaf_of([tampered.get(c, F.col(c)) for c in fields]) if tampered else F.lit(None).cast("string")
    return rows.select(
        F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("grp"), F.coalesce(F.col(id).cast("long"), F.lit(LEAST)).alias("id"),
        F.col(id).cast("long").alias("doc_id"), leaf_of([F.col(c) for c in fields]).alias("leaf"), changed.alias("other"),
    ).withColumn("other", F.nullif("other", F.col("leaf")))


def shifts(keys: DataFrame, key: str) -> list[int]:
    """Bits below each digit, from the highest that any two keys differ in to the one above the last."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    differ = 0 if low is None else (low ^ high) & ((1 << 64) - 1)
    return list(range(DIGIT, max(DIGIT, -(-differ.bit_length() // DIGIT) * DIGIT) + 1, DIGIT))[::-1]


def ranked(keys: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group.., key, n), one row per key of a group -> the same, rank (the sum of n over smaller keys of the group) and total (over all)."""
    levels = shifts(keys, key)
    # counts from the lowest digit up, each from the one below it
    counted: dict[int, DataFrame] = {}
    below = keys.select(*group, F.col(key).alias("at"), "n")
    for shift in reversed(levels):
        below = below.groupBy(*group, F.expr(f"shiftright(at, {DIGIT})").alias("at")).agg(F.sum("n").alias("n"))
        counted[shift] = below
    # first ranks from the highest digit down
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = None
    for shift in levels:
        level = counted[shift].withColumn("up", F.expr(f"shiftright(at, {DIGIT})"))
        if begun is None:  # ids agree above the highest digit: one bucket, or two by sign
            level = level.select(*group, "at", before(W.partitionBy(*group).orderBy("at")).alias("rank"), F.sum("n").over(W.partitionBy(*group)).alias("total"))
        else:
            up = begun.withColumnRenamed("at", "up").withColumnRenamed("rank", "begin")
            level = level.join(up.hint("merge"), [*group, "up"]).select(*group, "at", (F.col("begin") + before(W.partitionBy(*group, "up").orderBy("at"))).alias("rank"), "total")
        begun = cut(level)
    inside = keys.withColumn("at", F.expr(f"shiftright({key}, {DIGIT})"))
    joined = inside.join(begun.withColumnRenamed("rank", "begin").hint("merge"), [*group, "at"])
    return joined.withColumn("rank", F.col("begin") + before(W.partitionBy(*group, "at").orderBy(key))).drop("at", "begin")


def leaf_ranks(leaves: DataFrame) -> DataFrame:
    """(grp, id, doc_id, leaf, other) -> the same rows with rank and total: place in the group, and its size."""
    ids = cut(ranked(cut(leaves.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("n"))), ["grp"], "id"))
    several = cut(ids.where("n > 1").select("grp", "id"))
    on = ["grp", "id"]
    if several.isEmpty():
        return leaves.join(ids.drop("n").hint("merge"), on)
    alone = leaves.join(ids.where("n = 1").drop("n").hint("merge"), on)
    # copies are counted, their leaves ranked within the id, and chunks of copies numbered apart
    shared = leaves.join(several.hint("merge"), on, "left_semi")
    kinds = cut(shared.groupBy("grp", "id", "doc_id", "leaf", "other").agg(F.count(F.lit(1)).alias("n")))
    kinds = kinds.withColumns({"key": F.expr("cast(conv(substring(leaf, 1, 15), 16, 10) as bigint)"), "tail": F.substring("leaf", 16, 49)})
    keys = cut(kinds.groupBy("grp", "id", "key").agg(F.sum("n").alias("n")))
    places = ranked(keys, on, "key").select(*on, "key", F.col("rank").alias("within"))
    ordered = W.partitionBy(*on, "key").orderBy("tail", F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    kinds = kinds.join(places.hint("merge"), [*on, "key"]).withColumn("within", F.col("within") + F.coalesce(F.sum("n").over(ordered), F.lit(0)))
    placed = kinds.join(ids.drop("n").hint("merge"), on).withColumn("begin", F.col("rank") + F.col("within"))
    chunks = placed.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    spread = chunks.repartition("grp", "leaf", "chunk")
    each = spread.withColumn("i", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(n, (chunk + 1) * {CHUNK}) - 1)")))
    return alone.unionByName(each.withColumn("rank", F.col("begin") + F.col("i")).select(*alone.columns))


def group_ranks(groups: DataFrame) -> DataFrame:
    """(grp) unique -> grp, rank, total: sorted ranges are numbered apart, then by the sizes of those before them."""
    ranges = cut(groups.repartitionByRange(F.col("grp")).withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    begin = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"), F.sum("n").over(W.partitionBy()).alias("total"))
    return ranges.join(begin.hint("merge"), "part").select("grp", (F.col("begin") + F.row_number().over(W.partitionBy("part").orderBy("grp")) - 1).alias("rank"), "total")


def _powers(fanout: int) -> str:
    return "array(" + ", ".join(f"{fanout**k}L" for k in range(64) if fanout**k < 1 << 62) + ")"


def blocks_of(nodes: DataFrame, fanout: int, done: int) -> DataFrame:
    """(grp, rank, total, digest, ..) at level `done` -> grp, block, total, members, tree: the levels of the block, from its members up; the last holds one node.

    Members are those whose rank has one prefix, sorted by rank, with all columns of theirs.
    """
    width = fanout**HEIGHT
    rest = [c for c in nodes.columns if c not in ("grp", "total")]
    grouped = nodes.groupBy("grp", F.expr(f"rank div {width}").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", *[c for c in rest if c != "rank"]))).alias("members"))
    levels = f"least({HEIGHT}, greatest(0, size(filter({_powers(fanout)}, p -> p < total)) - {done}))"
    run = f"transform(sequence(0, (size(element_at(t, -1)) - 1) div {fanout}), i -> sha2(array_join(slice(element_at(t, -1), i * {fanout} + 1, {fanout}), ''), 256))"
    steps = f"slice(array({', '.join(map(str, range(HEIGHT)))}), 1, {levels})"
    return grouped.withColumn("tree", F.expr(f"aggregate({steps}, array(transform(members, m -> m.digest)), (t, k) -> array_append(t, {run}))"))


def inner_path(at: str, fanout: int) -> str:
    """SQL: of the member numbered `at` in its block, the siblings left and right of it and of each node above it, level by level."""
    place = f"({at} div cast(element_at({_powers(fanout)}, k + 1) as int))"
    left = f"array_join(slice(tree[k], {place} - {place} % {fanout} + 1, {place} % {fanout}), '')"
    right = f"array_join(slice(tree[k], {place} + 2, {fanout} - 1 - {place} % {fanout}), '')"
    return f"transform(slice(array({', '.join(map(str, range(HEIGHT)))}), 1, size(tree) - 1), k -> struct({left} as l, {right} as r))"


def grow(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Blocks of every step, from the leaves up. The last step has one block a group, the root of its tree being the group's."""
    steps = []
    while True:
        steps.append(cut(blocks_of(nodes, fanout, HEIGHT * len(steps))))
        if steps[-1].where("block > 0").isEmpty():
            return steps
        nodes = steps[-1].select("grp", F.col("block").alias("rank"), "total", F.expr("element_at(tree, -1)[0]").alias("digest"))


def descend(steps: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, path, ..) of each group's root -> members of the lowest step, with `path`: siblings from their own level up to where `above` ends, and its other columns."""
    rest = [c for c in above.columns if c not in ("grp", "path")]
    known = above.withColumn("block", F.lit(0).cast("long"))
    for step in reversed(steps):
        joined = step.join(known.hint("merge"), ["grp", "block"])
        each = joined.select("grp", "tree", "path", *rest, F.posexplode("members").alias("at", "m"))
        known = each.select("grp", F.col("m.rank").alias("block"), "m", F.concat(F.expr(inner_path("at", fanout)), F.col("path")).alias("path"), *rest)
        if step is not steps[0]:
            known = known.drop("m")
    return known


def proof_digest(path: str = "path") -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda e: F.concat(e["l"], e["r"])), ""), 256)


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda d, e: F.sha2(F.concat(e["l"], d, e["r"]), 256))


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, id, doc_id, leaf, other) -> doc_id, grp, leaf, other, subroot, root, and path: left and right siblings of each level."""
    leaves = cut(leaves)
    steps = grow(leaf_ranks(leaves).select("grp", "rank", "total", F.col("leaf").alias("digest"), "doc_id", "other"), fanout)
    subroots = cut(steps[-1].select("grp", F.expr("element_at(tree, -1)[0]").alias("digest")))
    ranks = group_ranks(subroots.select("grp"))
    nodes = subroots.join(ranks.hint("merge"), "grp").select(F.lit("").alias("grp"), "rank", "total", "digest", F.col("grp").alias("of"))
    upper = grow(nodes, fanout)
    top = upper[-1].select("grp", F.expr("element_at(tree, -1)[0]").alias("root"), F.expr("slice(array(struct('' as l, '' as r)), 1, 0)").alias("path"))
    named = cut(descend(upper, top, fanout).select(F.col("m.of").alias("grp"), "path", F.col("m.digest").alias("subroot"), "root"))
    found = descend(steps, named, fanout)
    return found.select("m.doc_id", "grp", F.col("m.digest").alias("leaf"), "m.other", "subroot", "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof, and the root that its copy, line ends lost where the id's crc32 is even, folds to."""
    documents = read_table(spark, sf_dir, "documents")
    even = F.expr("crc32(encode(coalesce(cast(doc_id as string), ''), 'UTF-8')) % 2 = 0")
    tampered = {"text": F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))}
    found = manifest(leaves_of(documents, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], tampered))
    proved = found.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), fold(F.coalesce("other", "leaf")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 by its definition, bit by bit; trees by levels, each from the one before.
OP11_SQL = f"""
with recursive docs as (
    select row_number() over () as k, doc_id, source, text, lang, n_chars,
        dense_rank() over (order by source nulls first) as g,
        {crc32_sql("coalesce(doc_id::varchar, '')")} % 2 = 0 as even
    from documents
), fields as (
    select k, g, doc_id, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
        text, case when even then replace(text, chr(10), '') else text end as other
    from docs
), leaves as (
    select k, g, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) as altered
    from fields
), placed as (
    select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from leaves
), levels as (
    select g, 0 as level, pos::bigint as pos, n::bigint as n, leaf as digest from placed
    union all
    select g, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' order by pos)) from levels where n > 1 group by g, level, pos // 3
), subroots as (
    select g, digest from levels where n = 1
), tops as (
    select 0 as level, (row_number() over (order by g) - 1)::bigint as pos, (count(*) over ())::bigint as n, digest from subroots
    union all
    select level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' order by pos)) from tops where n > 1 group by level, pos // 3
), sides as (
    select 0 as part, a.g, a.level, a.pos, string_agg(b.digest, '' order by b.pos) filter (where b.pos < a.pos) as l, string_agg(b.digest, '' order by b.pos) filter (where b.pos > a.pos) as r
    from levels a join levels b on a.g = b.g and a.level = b.level and a.pos // 3 = b.pos // 3 where a.n > 1 group by all
    union all
    select 1, 0, a.level, a.pos, string_agg(b.digest, '' order by b.pos) filter (where b.pos < a.pos), string_agg(b.digest, '' order by b.pos) filter (where b.pos > a.pos)
    from tops a join tops b on a.level = b.level and a.pos // 3 = b.pos // 3 where a.n > 1 group by all
), steps as (
    select p.k, row_number() over (partition by p.k order by s.part, s.level) as step, coalesce(s.l, '') as l, coalesce(s.r, '') as r
    from placed p join sides s on (s.part = 0 and s.g = p.g and s.pos = p.pos // (3 ** s.level)::bigint) or (s.part = 1 and s.pos = (p.g - 1) // (3 ** s.level)::bigint)
), folds as (
    select k, 0::bigint as step, altered as digest from placed
    union all
    select f.k, s.step, sha256(s.l || f.digest || s.r) from folds f join steps s on s.k = f.k and s.step = f.step + 1
), proofs as (
    select k, string_agg(l || r, '' order by step) as siblings from steps group by k
)
select p.doc_id, p.leaf, s.digest as subroot, t.digest as root, sha256(coalesce(q.siblings, '')) as proof_sha256, f.digest as folded_root, f.digest = t.digest as verified
from placed p join subroots s on s.g = p.g join tops t on t.n = 1 left join proofs q on q.k = p.k join (select k, arg_max(digest, step) as digest from folds group by k) f on f.k = p.k
"""
