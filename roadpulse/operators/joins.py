"""Nearest as-of join, interval overlap, coverage and gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import Running, dealt, following, running

def nearest_asof(probes: DataFrame, samples: DataFrame, keys: list[str], time: str, payload: list[str], order: str, ranges: int | None = None) -> DataFrame:
    """Adds sample: a struct of time and payload of the sample nearest in time, null without any.

    Ties go to the earlier sample, and an exact match wins. Of samples at one time the last by `order` stands for those before
    a probe, the first for those at its time or after. Both sides meet in two sorted passes of running extremes, one a direction of time,
    so work is linear in a key's rows but for the sort; there is no range join. One key's rows are one task's, unless `ranges` are given: then
    keys are cut by time, see `scans`.
    """
    v = F.struct(F.col(time).alias(time), F.col(order).alias("_order"), *[F.col(c).alias(c) for c in payload])
    left = probes.select(*[F.col(k) for k in keys], F.col(time), F.struct(*probes.columns).alias("_probe"))
    right = samples.select(*[F.col(k) for k in keys], F.col(time), v.alias("_sample"))
    both = left.unionByName(right, allowMissingColumns=True)
    # running extremes from an open end are kept up row by row; a frame that is open towards later rows would be computed anew for each
    sample = F.col("_sample")
    near = running(both, keys, [time], {"_prev": Running("max", sample, strict=True, peers=True), "_next": Running("min", sample, peers=True, back=True)}, ranges)
    earlier = F.col("_prev").isNotNull() & (F.col("_next").isNull() | (F.col(time) - F.col(f"_prev.{time}") <= F.col(f"_next.{time}") - F.col(time)))
    return near.where("_probe is not null").withColumn("sample", F.when(earlier, F.col("_prev")).otherwise(F.col("_next"))).select("_probe.*", "sample")


#: Bucket widths grow by this factor from level to level.
STEP = 16
#: Widths end here; above them one bucket holds all.
WIDEST = 1 << 62


def level_of(lo: str, hi: str, width: int) -> Column:
    """The first level whose buckets are as wide as the span, by the logarithm of its length; rounding may cost a bucket more, never a pair."""
    length = F.col(hi).cast("double") - F.col(lo).cast("double")
    return F.greatest(F.lit(0), F.ceil(F.log(length / float(width)) / math.log(STEP))).cast("int")


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str], width: int, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Inner join on keys where the half-open spans (longs) strictly overlap. `width` is that of the narrowest buckets.

    A span belongs to the level whose buckets are just wide enough for it, so that it touches two of them, rarely three. Two spans meet on the
    wider one's level, in the first bucket that both touch: an equi-join, each pair once. A side is copied to a wider level only if
    the other side has spans that belong there, and to its own only if the other has some as narrow, which two small subqueries tell. Spans of
    any length are taken: levels go on until one bucket holds every long, so open ends may be the greatest of them.
    """
    (a, b), (c, d) = left_span, right_span
    if width < 1:
        raise ValueError("width must be positive")
    widths = [width * STEP**k for k in range(64) if width * STEP**k < WIDEST]
    whole = len(widths)  # the level of one bucket

    def placed(df: DataFrame, lo: str, hi: str, side: str) -> DataFrame:
        return df.where(F.col(hi) > F.col(lo)).withColumn(f"_own_{side}", F.least(F.lit(whole), level_of(lo, hi, width)))

    l, r = placed(left, a, b, "l"), placed(right, c, d, "r")
    # one bit for each level that occurs, by subqueries of the same query
    used = {s: F.coalesce(df.select(F.bit_or(F.expr(f"shiftleft(1L, _own_{s})"))).scalar(), F.lit(0)) for s, df in (("l", l), ("r", r))}

    def spread(df: DataFrame, lo: str, hi: str, side: str, others: Column) -> DataFrame:
        own = F.col(f"_own_{side}")
        at = [F.struct(F.lit(k).alias("level"), F.lit(widths[k] if k < whole else None).cast("long").alias("w"), F.lit(1 << k).cast("long").alias("bit")) for k in range(whole + 1)]
        df = df.withColumn("_others", others)
        wider = F.filter(F.array(*at), lambda s: F.when(s["level"] == own, F.col("_others") % (s["bit"] * 2) != 0).otherwise((s["level"] > own) & (F.col("_others").bitwiseAND(s["bit"]) != 0)))
        copies = df.withColumn("_at", F.explode(wider)).withColumn("_level", F.col("_at.level"))
        bucket = lambda x: f"if(_at.w is null, 0L, ({x}) div _at.w - if(({x}) % _at.w < 0, 1, 0))"
        copies = copies.withColumn(f"_from_{side}", F.expr(bucket(f"`{lo}`")))
        return copies.withColumn("_bucket", F.explode(F.expr(f"sequence(_from_{side}, {bucket(f'`{hi}` - 1')})"))).drop("_at", "_others")

    joined = spread(l, a, b, "l", used["r"]).join(spread(r, c, d, "r", used["l"]), [*keys, "_level", "_bucket"])
    first = (F.col("_level") == F.greatest("_own_l", "_own_r")) & (F.col("_bucket") == F.greatest("_from_l", "_from_r"))
    return joined.where((F.col(a) < F.col(d)) & (F.col(b) > F.col(c)) & first).drop("_level", "_bucket", "_own_l", "_own_r", "_from_l", "_from_r")


def coverage(pairs: DataFrame, request: list[str], start: str, end: str, lo: str, hi: str, ranges: int | None = None) -> DataFrame:
    """Merged covered stretches of each request: request columns, start, end, lo, hi. Touching stretches merge. `ranges` as in `scans`, for requests with very many stretches."""
    cut = pairs.select(*request, start, end, F.greatest(F.col(start), F.col(lo)).alias("lo"), F.least(F.col(end), F.col(hi)).alias("hi"))
    order = ["lo", "hi"]
    cut = cut if ranges is None else dealt(cut, request, order, ranges)
    fresh = running(cut, request, order, {"_most": Running("max", F.col("hi"), strict=True)}).withColumn("_fresh", F.when(F.col("lo") <= F.col("_most"), 0).otherwise(1))
    island = running(fresh, request, order, {"_island": Running("sum", F.col("_fresh"))})
    return island.groupBy(*request, start, end, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def missing(requests: DataFrame, covered: DataFrame, request: list[str], start: str, end: str, ranges: int | None = None) -> DataFrame:
    """Stretches of each request that nothing covers."""
    marks = covered.select(*request, start, end, "lo", "hi").unionByName(requests.select(*request, start, end, F.col(start).alias("lo"), F.col(start).alias("hi")))
    if ranges is None:
        ahead = F.lead("lo").over(W.partitionBy(*request).orderBy("hi", "lo"))
        gaps = marks.withColumn("gap_end", F.coalesce(ahead, F.col(end)))
    else:
        gaps = running(marks, request, ["hi", "lo"], {"_ahead": following(["hi"], "lo")}, ranges).withColumn("gap_end", F.coalesce("_ahead.value", F.col(end)))
    return gaps.where("hi < gap_end").select(*request, F.col("hi").alias("gap_start"), "gap_end")


def seq_gaps(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Stretches of absent sequence numbers: keys, gap_start, gap_end (inclusive), n_missing. No range is expanded."""
    order = W.partitionBy(*keys).orderBy(seq)
    ahead = df.select(*keys, seq).distinct().withColumn("_next", F.lead(seq).over(order))
    return ahead.where(F.col("_next") > F.col(seq) + 1).select(*keys, (F.col(seq) + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"), (F.col("_next") - F.col(seq) - 1).alias("n_missing"))
