"""Windows and running rules over time-ordered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing
from .scans import Running, running


def tumbling(time_us: Column, width_us: int = 100_000) -> Column:
    """Start of the absolute window, by floor, so that negative times fall right."""
    if width_us <= 0:
        raise ValueError("width must be positive")
    return (F.floor(time_us / F.lit(width_us)) * width_us).cast("long")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n latest rows of each key; a ranked window with a limit is pre-reduced on the map side."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_r") <= n).drop("_r")


def heading(positions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds heading: bearing from the previous position, kept while the vehicle stands still (1e-6 degrees)."""
    by = W.partitionBy(key).orderBy(*order)
    lat0, lon0 = F.lag("lat").over(by), F.lag("lon").over(by)
    moved = F.abs(F.col("lat") - lat0) + F.abs(F.col("lon") - lon0) > 1e-6
    step = positions.withColumn("_step", F.when(moved, bearing(lat0, lon0, F.col("lat"), F.col("lon"))))
    return step.withColumn("heading", F.last("_step", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def harsh_brakes(signals: DataFrame, least: float = 3.0) -> DataFrame:
    accel = F.try_element_at(F.col("values_vec"), F.lit("accel"))
    return signals.where((F.col("channel") == "pose") & (F.abs(F.try_element_at(accel, F.lit(1))) > least))


def ring_budget(df: DataFrame, keys: list[str], order: list[Column] | list[str], size: str, budget: int, pinned: str | None = None, ranges: int | None = None) -> DataFrame:
    """What oldest-first eviction leaves: the newest rows whose sizes fit the budget, and every pinned row.

    `order` is newest first; names of columns mean their greatest first. Pinned rows use up budget but are never evicted.
    With `ranges`, which want names, a busy key is cut by them, see `scans`.
    """
    held = df.withColumn("_pin", F.col(pinned) if pinned else F.lit(False))
    free, fixed = F.when(~F.col("_pin"), F.col(size)).otherwise(0), F.when(F.col("_pin"), F.col(size))
    if ranges is None:
        by = W.partitionBy(*keys)
        newest = [F.desc(c) if isinstance(c, str) else c for c in order]
        used = held.withColumn("_used", F.coalesce(F.sum(fixed).over(by), F.lit(0)) + F.coalesce(F.sum(free).over(by.orderBy(*newest).rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    else:
        # pinned rows before and after a row, whatever it is itself
        ways = {"_free": Running("sum", free, back=True), "_later": Running("sum", fixed, back=True), "_earlier": Running("sum", fixed, strict=True)}
        used = running(held, keys, order, ways, ranges).withColumn("_used", sum((F.coalesce(c, F.lit(0)) for c in ways), F.lit(0))).drop(*ways)
    return used.where(F.col("_pin") | (F.col("_used") <= budget)).drop("_pin", "_used")


def contiguous_ack(done: DataFrame, keys: list[str], seq: str = "seq", first: int = 0) -> DataFrame:
    """Highest sequence number up to which all from `first` are done; first - 1 if the first is absent."""
    by = W.partitionBy(*keys).orderBy(seq)
    numbered = done.where(F.col(seq) >= first).select(*keys, seq).distinct().withColumn("_n", F.row_number().over(by) - 1)
    ends = numbered.where(F.col(seq) - first == F.col("_n")).groupBy(*keys).agg(F.max(seq).alias("ack"))
    return done.select(*keys).distinct().join(ends, keys, "left").withColumn("ack", F.coalesce("ack", F.lit(first - 1)))


def odd_transitions(poses: DataFrame, bounds: dict[str, tuple[float, float, float, float]], key: str = "vehicle_id", time: str = "event_ms", order: str = "offset") -> DataFrame:
    """Exits from and returns to the permitted area, where silence plays no part.

    Rows without bounds or coordinates are skipped, rows that aren't later than all before are late;
    a change of location starts anew, and the first row outside is an exit.
    """
    inside, known = F.lit(None).cast("boolean"), F.lit(False)
    for place, (low_lat, high_lat, low_lon, high_lon) in bounds.items():
        here = F.col("location") == place
        inside = F.when(here, F.col("lat").between(low_lat, high_lat) & F.col("lon").between(low_lon, high_lon)).otherwise(inside)
        known = known | here
    usable = poses.where(known & F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("outside", ~inside)
    arrival = W.partitionBy(key).orderBy(order)
    timely = usable.withColumn("_most", F.max(time).over(arrival.rowsBetween(W.unboundedPreceding, -1))).where(F.col("_most").isNull() | (F.col(time) > F.col("_most")))
    was = F.when(F.lag("location").over(arrival) == F.col("location"), F.lag("outside").over(arrival))
    kind = F.when(F.col("outside") & ~F.coalesce("_was", F.lit(False)), "ODD_EXITED").when(~F.col("outside") & F.col("_was"), "ODD_RETURNED")
    return timely.withColumn("_was", was).withColumn("type", kind).where("type is not null").drop("_was", "_most", "outside")


def stop_runs(status: DataFrame, key: str = "vehicle_id", time: str = "event_ms", order: str = "offset", gap_ms: int = 5_000, least_ms: int = 30_000) -> DataFrame:
    """Unplanned stops: runs of standing still on an active mission, unbroken by gaps or a change of mission, and when each is reported."""
    arrival = W.partitionBy(key).orderBy(order)
    timely = status.withColumn("_most", F.max(time).over(arrival.rowsBetween(W.unboundedPreceding, -1))).where(F.col("_most").isNull() | (F.col(time) > F.col("_most")))
    stopped = (F.col("mission_active") == 1) & (F.col("planned_stop") == 0) & (F.col("speed") <= 0.1)
    broken = (F.col(time) - F.lag(time).over(arrival) > gap_ms) | (F.lag("mission_id").over(arrival) != F.col("mission_id")) | ~F.coalesce(F.lag("_stopped").over(arrival), F.lit(False))
    runs = timely.withColumn("_stopped", stopped).withColumn("_new", F.when(F.col("_stopped") & ~F.coalesce(broken, F.lit(True)), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(arrival.rowsBetween(W.unboundedPreceding, 0))).where("_stopped")
    since = runs.withColumn("since_ms", F.min(time).over(W.partitionBy(key, "_run")))
    return since.groupBy(key, "_run", "since_ms").agg(F.max(time).alias("until_ms"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col(time) - F.col("since_ms") >= least_ms, F.col(time))).alias("reported_ms")).drop("_run")


def sensor_edges(status: DataFrame, key: str = "vehicle_id", order: str = "offset", healthy: str = "sensor_healthy") -> DataFrame:
    """SENSOR_FAULT on the first bad report of a row of them, SENSOR_RECOVERED on the first good one after."""
    before = F.lag(healthy).over(W.partitionBy(key).orderBy(order))
    kind = F.when((F.col(healthy) == 0) & (before.isNull() | (before != 0)), "SENSOR_FAULT").when((F.col(healthy) == 1) & (before == 0), "SENSOR_RECOVERED")
    return status.withColumn("type", kind).where("type is not null")


def stale_deadlines(status: DataFrame, key: str = "vehicle_id", received: str = "received_ms", stale_ms: int = 5_000) -> DataFrame:
    """Deadlines that pass without a further report, and the report that ends the silence, if any."""
    following = F.lead(received).over(W.partitionBy(key).orderBy(received, "offset"))
    out = status.withColumn("recovered_ms", following).withColumn("stale_ms", F.col(received) + stale_ms)
    return out.where(F.col("recovered_ms").isNull() | (F.col("recovered_ms") >= F.col("stale_ms")))


# The family that an alert opens or closes.
ALERT_FAMILIES = {
    "ODD_EXITED": ("odd", True), "ODD_SUSTAINED": ("odd", True), "ODD_RETURNED": ("odd", False), "UNPLANNED_STOP": ("stop", True), "STOP_CLEARED": ("stop", False),
    "SENSOR_FAULT": ("sensor", True), "SENSOR_RECOVERED": ("sensor", False), "TELEMETRY_STALE": ("stale", True), "TELEMETRY_RECOVERED": ("stale", False),
}


def active_alerts(alerts: DataFrame, key: str = "vehicle_id", order: str = "offset") -> DataFrame:
    """Open families per vehicle: an id counts when it first arrives, then the latest transition of each family decides."""
    family, opens = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for kind, (name, state) in ALERT_FAMILIES.items():
        family, opens = F.when(F.col("type") == kind, name).otherwise(family), F.when(F.col("type") == kind, state).otherwise(opens)
    once = alerts.groupBy("event_id").agg(F.min_by(F.struct(key, "type", order), order).alias("e")).select("e.*")
    last = once.select(key, family.alias("family"), opens.alias("open"), order).where("family is not null").groupBy(key, "family").agg(F.max_by("open", order).alias("open"))
    return last.where("open").select(key, "family")
