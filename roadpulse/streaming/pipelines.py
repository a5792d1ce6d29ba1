"""The storage job and the alert job: two queries with checkpoints of their own over one record stream.

Both read records once, pass them through sequence dedup, decode them by kind and check them. Every
record that passes dedup ends in one place: a table of its kind or the dead letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geo import enu_to_wgs84
from ..operators import validate
from ..schemas import ALERTS, KINDS
from ..sources import avro
from .ledger import Ledger
from .machines import FleetMonitor, Gate, SequenceWindow
from .runner import over_stream, over_table

IDENTITY = ("vehicle_id", "boot_id", "seq")
HEADERS = "array<struct<key string, value binary>>"


def deduplicated(records: DataFrame, window: int = 4096) -> DataFrame:
    """The records that pass dedup, with `verdict`, over a stream or a table. One shuffle, by dedup key."""
    e = validate.envelope(records)
    rows = e.select(
        "topic", "partition", "offset", "key", "value", F.to_json("headers").alias("headers_json"), F.unix_micros("timestamp").alias("arrived_us"), "vehicle_id", "boot_id", "seq", "stream_id",
        (F.col("validation_error").isNotNull() | F.col("clip_reference")).alias("bypass"), "dedup_key",
    )
    run = over_stream if records.isStreaming else over_table
    passed = run(rows, Gate, "dedup_key", ["partition", "offset"], window=window)
    return passed.select("topic", "partition", "offset", "key", "value", F.from_json("headers_json", HEADERS).alias("headers"), F.timestamp_micros("arrived_us").alias("timestamp"), "verdict")


def decoded(records: DataFrame, only: str | None = None) -> DataFrame:
    """Envelope, the decoded record of its kind, a place in degrees, and of bad records error_class, error_step and error_message: one pass, no shuffle.

    For a reader of one kind: given `only`, records that aren't routed to it are left out before anything is decoded.
    """
    if only is not None:  # by the header alone, which needs no envelope: what has none of the kind isn't even checked
        records = records.where(validate.route(validate.header("kind")) == only)
    e = validate.envelope(records).withColumn("routed", validate.route(F.col("kind")))
    if only is not None:
        e = e.where(F.col("routed") == only)
    e = e.withColumn("record", avro.decoded(F.col("routed"), F.col("value")))
    e = e.select("*", "record.*").drop("record")
    rules = {
        "signal": validate.signal_error("signal.values_num", "signal.values_vec"),
        "perception": validate.box_error("perception."),
        "segment": validate.segment_error("segment."),
    }
    parsed = rule = None
    for k, r in rules.items():
        mine = F.col("routed") == k
        parsed = F.when(mine, F.col(k).isNotNull()) if parsed is None else parsed.when(mine, F.col(k).isNotNull())
        rule = F.when(mine & F.col(k).isNotNull(), r) if rule is None else rule.when(mine & F.col(k).isNotNull(), r)
    bad = validate.error_class(F.col("validation_error"), F.col("routed"), F.coalesce(parsed, F.lit(False)), rule)
    place = F.try_element_at(F.col("signal.values_str"), F.lit("location"))
    at = F.try_element_at(F.col("signal.values_vec"), F.lit("translation"))
    p = enu_to_wgs84(F.try_element_at(at, F.lit(1)), F.try_element_at(at, F.lit(2)), place)
    pose = F.col("signal.channel") == "ego_pose"
    return e.withColumns({
        "error_class": bad, "error_step": validate.error_step(F.col("validation_error"), F.col("routed"), F.coalesce(parsed, F.lit(False)), rule), "error_message": validate.error_message(F.col("validation_error"), F.col("kind"), F.col("routed"), F.coalesce(parsed, F.lit(False)), rule),
        "location": place, "lat": F.when(pose, p["lat"]), "lon": F.when(pose, p["lon"]),
    })


def bound(records: DataFrame, kind: str) -> DataFrame:
    """Columns of a kind's table: 12, 24 or 15, when it was stored, and the day that the table is cut by."""
    rows = records.where(F.col("error_class").isNull() & (F.col("routed") == kind))
    places = {"signal": ["lat", "lon"], "perception": [F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")], "segment": []}[kind]
    day = F.to_date(F.col("t_start" if kind == "segment" else "sensor_time"))
    return rows.select(*IDENTITY, f"{kind}.*", *places, F.current_timestamp().alias("ingest_time")).withColumn("date", day)


def dead_letters(records: DataFrame) -> DataFrame:
    """Bad records with everything that came with them; identity only of valid envelopes."""
    return records.where("error_class is not null").select(
        "error_class", "error_step", "error_message", F.col("value").alias("original_value"), F.col("key").alias("original_key"), "vehicle_id", "boot_id", "source_boot_id", "seq", "kind",
        F.when(F.col("validation_error").isNull(), F.col("stream_id")).alias("stream_id"), F.when(F.col("validation_error").isNull(), F.col("report_interval_ms").cast("long")).alias("report_interval_ms"),
        F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), F.current_timestamp().alias("failed_at"), "headers",
        F.lit(1).alias("attempt"), F.lit(2).alias("format_version"),
    )


def dead_letter_values(letters: DataFrame) -> DataFrame:
    """`value`: each dead letter as a container file that holds its own schema, for a broker's topic."""
    import pandas as pd

    names = ["original_value", "error_class", "error_message", "source_topic", "error_step", "failed_us", "attempt", "format_version", "source_partition", "source_offset", "original_key", "headers", *["vehicle_id", "boot_id", "source_boot_id", "seq", "kind", "stream_id", "report_interval_ms"]]

    def packed(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                row = {k: None if v is None or (isinstance(v, float) and v != v) else v for k, v in row.items()}
                row["headers"] = [{"key": h["key"], "value": h["value"]} for h in (row["headers"] if row["headers"] is not None else [])]
                whole = ("failed_us", "attempt", "format_version", "source_partition", "source_offset", "seq", "report_interval_ms")
                values = [int(row[n]) if n in whole and row[n] is not None else row[n] for n in names]
                out.append(avro.container(avro.DEAD_LETTER, dict(zip([n for n, _ in avro.DEAD_LETTER], values))))
            yield pd.DataFrame({"value": out})

    # numbers that may be null travel as text: pandas would turn them into floats
    flat = letters.withColumn("failed_us", F.unix_micros("failed_at")).select(*[F.col(n).cast("string").alias(n) if n in ("source_partition", "source_offset", "seq", "report_interval_ms") else F.col(n) for n in names])
    return flat.mapInPandas(packed, "value binary")


def write_batch(batch: DataFrame, root: str) -> None:
    """One micro-batch: an append to each kind's table and one to the dead letters."""
    held = batch.persist()
    try:
        for name, kind in KINDS.items():
            bound(held, validate.ROUTES[kind]).write.mode("append").partitionBy("date").parquet(f"{root}/{name}")
        dead_letters(held).write.mode("append").parquet(f"{root}/dead_letters")
    finally:
        held.unpersist()


def storage_job(records: DataFrame, root: str, checkpoint: str, window: int = 4096, **trigger) -> StreamingQuery:
    """Stores every batch once, however often it is begun: see `ledger`."""
    rows = decoded(deduplicated(records, window))

    def store(batch: DataFrame, number: int) -> None:
        written = []

        def write(staged: str) -> None:
            write_batch(batch, staged)
            written.append(staged)

        Ledger.of_checkpoint(batch.sparkSession, root, checkpoint).commit(number, write)
        if not written:  # a repeated batch is still read, for the state of dedup goes on with it
            batch.write.format("noop").mode("overwrite").save()

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def monitor_rows(live: DataFrame) -> DataFrame:
    """Flat rows that the monitors read; received_ms is the broker's time."""
    num = lambda n: F.try_element_at(F.col("signal.values_num"), F.lit(n))
    return live.where("error_class is null and routed = 'signal'").select(
        "vehicle_id", "boot_id", "seq", "source_boot_id", "stream_id", "report_interval_ms", "partition", "offset", F.col("signal.channel").alias("channel"), F.unix_millis("signal.sensor_time").alias("event_ms"),
        F.unix_millis("timestamp").alias("received_ms"), "location", "lat", "lon", num("speed_mps").alias("speed"), num("mission_active").alias("mission_active"), num("planned_stop").alias("planned_stop"),
        num("sensor_healthy").alias("sensor_healthy"), F.try_element_at(F.col("signal.values_str"), F.lit("mission_id")).alias("mission_id"),
    )


def alert_stream(records: DataFrame, bounds: dict, timers: bool = True, **options) -> DataFrame:
    """Alerts of both monitors: one stateful operator and one shuffle, of the channels that they read.

    Dedup has no operator of its own here: a monitor takes no report that isn't later than the last one, so a copy never tells anything.
    """
    rows = monitor_rows(decoded(records)).where(F.col("channel").isin("ego_pose", "fleet_status"))
    if not records.isStreaming:
        return over_table(rows, FleetMonitor, "vehicle_id", ["partition", "offset"], bounds=bounds, **options)
    return over_stream(rows, FleetMonitor, "vehicle_id", ["partition", "offset"], timers, bounds=bounds, **options)


def alert_values(alerts: DataFrame) -> DataFrame:
    """key (the vehicle) and value (JSON of schemas.ALERTS), as a broker's topic holds them and `alerts_from_json` reads them."""
    own = ("event_id", "type", "severity", "vehicle_id", "boot_id", "seq", "event_ms", "detected_ms", "location", "lat", "lon", "message")
    named: list[Column] = [F.col(a).alias(f.strip().split(" ")[0]) for a, f in zip(own, ALERTS.split(","))]
    return alerts.select(F.encode("vehicle_id", "UTF-8").alias("key"), F.encode(F.to_json(F.struct(*named)), "UTF-8").alias("value"))


def alert_job(records: DataFrame, bounds: dict, path: str, checkpoint: str, timers: bool = True, trigger: dict | None = None, **options) -> StreamingQuery:
    """Alerts as JSON values keyed by vehicle, appended to files."""
    out = alert_values(alert_stream(records, bounds, timers, **options))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start()


def to_broker(values: DataFrame, servers: str, topic: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keys and values to a broker's topic, at least once. Needs the Kafka package."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}
    return values.writeStream.format("kafka").options(**options).trigger(**(trigger or {"processingTime": "1 second"})).start()


def dedup_stream(records: DataFrame, window: int = 4096) -> DataFrame:
    """Verdicts of a stream, by dedup key, in arrival order."""
    e = validate.envelope(records).where("validation_error is null and not clip_reference").select("dedup_key", "vehicle_id", "boot_id", "seq", "partition", "offset")
    return over_stream(e, SequenceWindow, "dedup_key", ["partition", "offset"], window=window)

