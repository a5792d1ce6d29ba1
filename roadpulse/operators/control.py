"""Control-plane facts that are computations over logs: command receipts, due jobs, retention, what a clip may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequences import ring_budget

# Limits of a command's life, of a clip's size and parts.
LIFETIME_MS = 300_000
MOST_CLIP, MOST_PART, LEAST_PART, MOST_PARTS = 5 << 40, 5 << 30, 5 << 20, 1000
LAST_US = 10_413_792_000 * 1_000_000  # year 2300
TYPES = ("collection_policy", "history_request", "clip_request", "clip_status", "diagnostic")


def receipts(commands: DataFrame) -> DataFrame:
    """Adds status and reason to a log of commands (vehicle_id, command_id, wire, type, version, expires_ms, now_ms, order).

    A command id counts once: the same bytes again get the same answer, others are refused. A policy's version must be above all that came
    before it; those that were refused as stale are not above them either, so a running maximum over all fresh policies is the state.
    """
    of_id, of_vehicle = W.partitionBy("vehicle_id", "command_id").orderBy("order"), W.partitionBy("vehicle_id").orderBy("order")
    c = commands.withColumns({"_first": F.row_number().over(of_id) == 1, "_wire": F.first("wire").over(of_id)})
    alive = (F.col("expires_ms") > F.col("now_ms")) & (F.col("expires_ms") <= F.col("now_ms") + LIFETIME_MS)
    counts = F.when(F.col("_first") & alive & (F.col("type") == "collection_policy"), F.col("version"))
    c = c.withColumn("_before", F.max(counts).over(of_vehicle.rowsBetween(W.unboundedPreceding, -1)))
    reason = (
        F.when(F.col("expires_ms") <= F.col("now_ms"), "expired")
        .when(~alive, "command lifetime exceeds five minutes")
        .when((F.col("type") == "collection_policy") & (F.col("version").isNull() | (F.col("version") <= F.coalesce("_before", F.lit(0)))), "stale policy version")
        .when(F.col("type").isNull() | ~F.col("type").isin(*TYPES), "unsupported command type")
    )
    c = c.withColumn("_own", F.coalesce(reason, F.lit("")))
    c = c.withColumn("_told", F.when(F.col("wire") == F.col("_wire"), F.first("_own").over(of_id)).otherwise("id reused"))
    status = F.when(F.col("_told") == "", "applied").when(F.col("_told") == "expired", "expired").otherwise("rejected")
    return c.select(*commands.columns, status.alias("status"), F.nullif(F.col("_told"), F.lit("")).alias("reason"))


def due_jobs(jobs: DataFrame, now_ms: int, most: int = 1) -> DataFrame:
    """Jobs (id, next_attempt_ms, lease_until_ms) whose time has come and that nobody holds, the longest due first."""
    free = F.col("lease_until_ms").isNull() | (F.col("lease_until_ms") <= now_ms)
    return jobs.where((F.col("next_attempt_ms") <= now_ms) & free).orderBy("next_attempt_ms", "id").limit(most)


def ring_retention(rows: DataFrame, keys: list[str], newest_first: list, created: str, size: str, pinned: str, now_ms: int, keep_ms: int, budget: int) -> DataFrame:
    """What a ring holds: rows that are pinned or young enough, and of these no more than the budget, the oldest unpinned ones going first."""
    young = rows.where(F.col(pinned) | (F.col(created) >= now_ms - keep_ms))
    return ring_budget(young, keys, newest_first, size, budget, pinned)


def clip_error(start_us: Column, end_us: Column, size: Column, sha256: Column, part: Column, samples: Column, channels: Column, calibration: Column) -> Column:
    """Why a clip's description is refused, or null."""
    parts = 1 + F.floor((size - 1) / part)
    return (
        F.when(start_us.isNull() | end_us.isNull() | (start_us <= 0) | (end_us < start_us) | (end_us >= LAST_US), "invalid clip times")
        .when(size.isNull() | ~size.between(1, MOST_CLIP), "size must be within 1 and 5 TiB")
        .when(sha256.isNull() | ~sha256.rlike("^[0-9a-f]{64}$"), "sha256 must be lowercase hex")
        .when(part.isNull() | ~part.between(1, MOST_PART), "invalid part size")
        .when((size > part) & (part < LEAST_PART), "parts but the last must have 5 MiB")
        .when(parts > MOST_PARTS, "too many parts")
        .when(samples.isNull() | (samples <= 0), "sample count must be positive")
        .when(channels.isNull() | (F.size(channels) > 256) | F.exists(channels, lambda c: c.isNull() | (F.trim(c) == "") | (F.length(c) > 256)), "invalid channels")
        .when(calibration.isNull() | F.exists(F.map_values(calibration), lambda v: v.isNull() | F.try_parse_json(v).isNull()), "calibration must be JSON")
    )

