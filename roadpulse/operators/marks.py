"""Marks of completeness and of order, counters that are kept up by deltas, and upload jobs as a log of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Running, dealt, running


def mask_of(names: list[str], given: list[str]) -> int:
    """The bits of the given names, in the order of `names`."""
    return sum(1 << names.index(n) for n in given)


def sensor_mask(frames: DataFrame, keys: list[str], sensor: str, names: list[str], required: list[str]) -> DataFrame:
    """Per frame the bitmap of the sensors that told something (bit i is names[i]), those that are wanting, and whether it is complete.

    Sensors that aren't among `names`, and null, have no bit. Bits are joined on the map side; 62 names at the most.
    """
    if len(names) > 62 or len(set(names)) < len(names):
        raise ValueError("names must differ and be 62 at the most")
    bit = F.lit(0).cast("long")
    for i, n in enumerate(names):
        bit = F.when(F.col(sensor) == n, F.lit(1 << i).cast("long")).otherwise(bit)
    wanted = F.lit(mask_of(names, required)).cast("long")
    got = frames.groupBy(*keys).agg(F.bit_or(bit).alias("sensors"))
    return got.withColumns({"wanting": wanted.bitwiseAND(F.bitwise_not(F.col("sensors")))}).withColumn("complete", F.col("wanting") == 0)


def backward_time(df: DataFrame, key: str, time: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """Adds behind: by how much a row's time lies before the greatest time that its key has had so far, null if it doesn't. `ranges` cut a busy key, see `scans`."""
    most = running(df, [key], order, {"_most": Running("max", F.col(time), strict=True)}, ranges)
    return most.withColumn("behind", F.when(F.col("_most") > F.col(time), F.col("_most") - F.col(time))).drop("_most")


def deltas(rows: DataFrame, keys: list[str], time: str, size: Column) -> DataFrame:
    """What a batch adds to the counters of each key: n, size, first and last. One row a key, reduced on the map side."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.min(time).alias("first"), F.max(time).alias("last"))


def merged(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Counters and deltas of any number of batches, in any order and split, as one row a key. A batch that is repeated must be there once: see `streaming.ledger`."""
    return counters.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"))


# The states of an upload job and the steps between them.
STEPS = {
    "": ("REQUESTED",),
    "REQUESTED": ("LEASED", "CANCELLED", "EXPIRED"),
    "LEASED": ("LEASED", "UPLOADING", "REQUESTED", "CANCELLED", "EXPIRED"),
    "UPLOADING": ("UPLOADING", "UPLOADED", "REQUESTED", "FAILED", "CANCELLED", "EXPIRED"),
}


def _legal() -> Column:
    return F.concat(F.col("before"), F.lit(">"), F.col("state")).isin([f"{a}>{b}" for a, after in STEPS.items() for b in after])


def upload_log(events: DataFrame, job: str = "job_id", order: str = "offset", state: str = "state", token: str = "token", ranges: int | None = None) -> DataFrame:
    """Events of upload jobs with before (the state that the event before told), legal (whether the step is one of STEPS) and fenced.

    A lease has a token, greater than all before it; an event with a smaller one than the greatest so far, its own aside, comes from a worker whose lease is over, and is fenced.
    Whether a step is legal is asked of events that aren't fenced, in their order: a fenced one changes nothing.
    """
    rows = events if ranges is None else dealt(events, [job], [order], ranges)
    most = running(rows, [job], [order], {"_most": Running("max", F.col(token), strict=True)})
    held = most.withColumn("fenced", F.coalesce(F.col(token) < F.col("_most"), F.lit(False))).drop("_most")
    counted = held.withColumn("_state", F.when(~F.col("fenced"), F.col(state)))
    last = Running("max", F.when(~F.col("fenced"), F.struct(F.col(order), F.col("_state").alias("value"))), strict=True)
    told = running(counted, [job], [order], {"_last": last}).withColumn("before", F.coalesce("_last.value", F.lit("")))
    return told.withColumn("state", F.col(state)).withColumn("legal", F.when(~F.col("fenced"), _legal())).drop("_state", "_last", "_range")


def upload_states(log: DataFrame, job: str = "job_id", order: str = "offset") -> DataFrame:
    """Per job: its state and token now, and how many events were illegal or fenced."""
    return log.groupBy(job).agg(
        F.max_by(F.when(~F.col("fenced"), F.col("state")), F.when(~F.col("fenced"), F.col(order))).alias("state"), F.max("token").alias("token"),
        F.count(F.when(F.col("legal") == F.lit(False), 1)).alias("illegal"), F.count(F.when(F.col("fenced"), 1)).alias("fenced"),
    )
