"""Sequence-window dedup in closed form: the verdicts of a bounded bitmap, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import Running, dealt, previous, running

WINDOW = 4096
PASSES = ("ACCEPT", "LATE", "BOOT_RESET")


def check_window(window: int) -> int:
    if window <= 0 or window & (window - 1):
        raise ValueError("window must be a power of two")
    return window


def verdicts(df: DataFrame, key: str = "dedup_key", boot: str = "boot_id", seq: str = "seq", order: str = "offset", window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """Adds run (how often the boot has changed so far) and verdict, in arrival order within a key.

    One key's rows are one task's, unless `ranges` are given: then keys are cut by arrival, see `scans`, and whether a number has been before
    is asked of its first arrival, an aggregate.
    """
    w = check_window(window)
    if ranges is None:
        arrival = W.partitionBy(key).orderBy(order)
        flip = F.when(F.col(boot) != F.lag(boot).over(arrival), 1).otherwise(0)
        run = df.withColumn("_flip", flip).withColumn("run", F.sum("_flip").over(arrival.rowsBetween(W.unboundedPreceding, 0)))
        seen = W.partitionBy(key, "run", seq).orderBy(order)
        most = running(run, [key, "run"], [order], {"_most": Running("max", F.col(seq), strict=True)}).withColumn("_again", F.row_number().over(seen) > 1)
    else:
        before = running(dealt(df, [key], [order], ranges), [key], [order], {"_before": previous([order], boot)})
        flips = before.withColumn("_flip", F.when(F.col(boot) != F.col("_before.value"), 1).otherwise(0)).drop("_before")
        run = running(flips, [key], [order], {"run": Running("sum", F.col("_flip"))})
        # a run's rows in one range of its key
        most = running(run, [key, "run"], [order], {"_most": Running("max", F.col(seq), strict=True)}).drop("_range")
        first = run.groupBy(F.col(key).alias("_k"), F.col("run").alias("_r"), F.col(seq).alias("_s")).agg(F.min(order).alias("_first"))
        same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("run") == F.col("_r")) & F.col(seq).eqNullSafe(F.col("_s"))
        most = most.join(first.hint("merge"), same).withColumn("_again", F.col(order) > F.col("_first")).drop("_k", "_r", "_s", "_first")
    verdict = (
        F.when(F.col("_most").isNull(), F.when(F.col("run") == 0, "ACCEPT").otherwise("BOOT_RESET"))
        .when(F.col(seq) > F.col("_most"), "ACCEPT")
        .when(F.col(seq) <= F.col("_most") - w, "TOO_OLD")
        .when(F.col("_again"), "DUPLICATE")
        .otherwise("LATE")
    )
    return most.withColumn("verdict", verdict).drop("_flip", "_most", "_again")


def passed(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("verdict").isin(*PASSES))


def loss(judged: DataFrame, key: str = "dedup_key", seq: str = "seq", order: str = "offset", window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """Per key and run: first_seq, last_seen, lost, contiguous, pending_holes, as the bitmap has them at the end."""
    w = check_window(window)
    ends = judged.groupBy(key, "run").agg(F.min_by(seq, order).alias("first_seq"), F.max(seq).alias("last_seen"))
    low = F.col("last_seen") - w
    seqs = passed(judged).select(key, "run", F.col(seq).alias("s")).distinct()
    held = seqs.join(ends, [key, "run"]).withColumn("base", F.greatest(F.col("first_seq") - 1, low))
    chain = running(held, [key, "run"], ["s"], {"nth": Running("sum", F.when(F.col("s") > F.col("base"), 1).otherwise(0))}, ranges)
    unbroken = (F.col("s") > F.col("base")) & (F.col("s") - F.col("base") == F.col("nth"))
    sums = chain.groupBy(key, "run", "first_seq", "last_seen", "base").agg(
        F.count(F.when((F.col("s") >= F.col("first_seq")) & (F.col("s") <= low), 1)).alias("old"), F.max(F.when(unbroken, F.col("s"))).alias("end"), F.count(F.when(F.col("s") > F.col("base"), 1)).alias("new")
    )
    contiguous = F.coalesce("end", "base")
    return sums.select(
        key, "run", "first_seq", "last_seen", (F.greatest(F.lit(0), low - F.col("first_seq") + 1) - F.col("old")).alias("lost"), contiguous.alias("contiguous"),
        (F.col("last_seen") - contiguous - (F.col("new") - (contiguous - F.col("base")))).alias("pending_holes"),
    )
