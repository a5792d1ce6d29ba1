"""Envelope contract, routing by kind, and business rules. Every rule is a column, so a scan stays one stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import norm

QUATERNION_TOLERANCE = 1e-3
STREAMS = ("status", "event", "history")
QUATERNIONS = ("rotation", "q", "orientation")


def header(name: str) -> Column:
    """Text of the last header of a name; null if there is none or it has no value."""
    keys = F.col("headers")["key"]  # no lambda: what is known of headers when a query is planned, Spark folds away
    from_end = F.array_position(F.reverse(keys), name)  # 0 if there is none, so the place is behind the last
    return F.decode(F.get("headers", (F.size(keys) - from_end).cast("int"))["value"], "UTF-8")


def envelope(records: DataFrame) -> DataFrame:
    """Adds vehicle_id, boot_id, seq, kind, stream_id, report_interval_ms, source_boot_id, dedup_key and validation_error.

    A malformed record stays, with its reason, and has no identity.
    """
    h = {c: header(c) for c in ("vehicle_id", "boot_id", "seq", "kind", "stream_id", "source_boot_id", "report_interval_ms", "producer_origin")}
    seq, interval = (F.expr("try_cast(_h.{} as bigint)".format(c)) for c in ("seq", "report_interval_ms"))
    held = records.withColumn("_h", F.struct(*[v.alias(k) for k, v in h.items()]))
    of = lambda c: F.col(f"_h.{c}")
    blank = lambda c: of(c).isNull() | (F.trim(of(c)) == "")
    error = (
        F.when(blank("vehicle_id") | blank("boot_id") | of("seq").isNull(), "missing identity header")
        .when(F.col("key").isNotNull() & (F.decode(F.col("key"), "UTF-8") != of("vehicle_id")), "key differs from vehicle_id")
        .when(of("stream_id").isNotNull() & blank("source_boot_id"), "source_boot_id is required")
        .when(of("stream_id").isNotNull() & ~of("stream_id").isin(*STREAMS), "unknown stream_id")
        .when(of("stream_id").isNotNull() & (interval.isNull() | ~interval.between(100, 60_000)), "invalid report interval")
        .when(seq.isNull(), "sequence is not a number")
        .when(seq < 0, "negative sequence")
        .when(
            of("producer_origin").isNotNull()
            & ((of("producer_origin") != "clip-upload") | (F.coalesce(of("kind"), F.lit("")) != "RECORD_KIND_SEGMENT_REF") | ~of("boot_id").startswith("clip-") | (seq != 0) | of("stream_id").isNotNull()),
            "invalid clip reference identity",
        )
    )
    fine = F.col("validation_error").isNull()
    out = held.withColumn("validation_error", error).withColumns({
        "vehicle_id": F.when(fine, of("vehicle_id")), "boot_id": F.when(fine, of("boot_id")), "seq": F.when(fine, seq), "kind": F.when(fine, of("kind")),
        "stream_id": F.when(fine, F.coalesce(of("stream_id"), F.lit("legacy"))).otherwise("invalid"),
        "report_interval_ms": F.when(fine & of("stream_id").isNotNull(), interval).otherwise(F.lit(0)),
        "source_boot_id": F.when(fine, F.when(of("stream_id").isNull(), of("boot_id")).otherwise(of("source_boot_id"))),
        "clip_reference": fine & (F.coalesce(of("producer_origin"), F.lit("")) == "clip-upload"),
    })
    sep = F.lit("\0")
    key = (
        F.when(F.col("validation_error").isNotNull(), F.concat_ws("\0", F.lit("invalid"), "topic", F.col("partition").cast("string")))
        .when(F.col("stream_id") == "legacy", F.col("vehicle_id"))
        .otherwise(F.concat(F.col("vehicle_id"), sep, F.col("boot_id"), sep, F.col("stream_id")))
    )
    return out.withColumn("dedup_key", key).drop("_h")


def _off_unit(q: Column) -> Column:
    """NaN passes, as a comparison with it is false; a null component does not."""
    n = norm(q)
    return F.exists(q, lambda v: v.isNull()) | (F.coalesce(~F.isnan(n), F.lit(False)) & (F.abs(n - 1) > QUATERNION_TOLERANCE))


def signal_error(nums: str = "values_num", vecs: str = "values_vec") -> Column:
    """First failing rule of a signal, or null. NaN speed passes."""
    speed = F.try_element_at(F.col(nums), F.lit("vehicle_speed"))
    rule = F.when(~F.isnan(speed) & (speed < 0), "vehicle_speed < 0")
    for name in QUATERNIONS:
        q = F.try_element_at(F.col(vecs), F.lit(name))
        rule = rule.when(q.isNotNull() & (F.size(q) == 4) & _off_unit(q), f"{name} is not a unit quaternion")
    return rule


def box_error(of: str = "") -> Column:
    """First failing rule of a box, or null. NaN sizes fail; zero lidar points pass. `of` stands before the columns' names."""
    rule = None
    for side in ("size_w", "size_l", "size_h"):
        v = F.col(of + side)
        bad = v.isNull() | F.isnan(v) | (v <= 0)
        rule = F.when(bad, f"{side} <= 0") if rule is None else rule.when(bad, f"{side} <= 0")
    return rule.when(_off_unit(F.array(*[of + c for c in ("rot_w", "rot_x", "rot_y", "rot_z")])), "rotation is not a unit quaternion")


def segment_error(of: str = "") -> Column:
    c = {n: F.col(of + n) for n in ("size_bytes", "sample_count", "checksum", "t_start", "t_end")}
    return (
        F.when(c["size_bytes"].isNull() | (c["size_bytes"] <= 0), "size_bytes <= 0")
        .when(c["sample_count"].isNull() | (c["sample_count"] <= 0), "sample_count <= 0")
        .when(c["checksum"].isNull() | (F.length(c["checksum"]) != 64), "checksum is not 64 hex digits")
        .when(c["t_start"].isNull() | c["t_end"].isNull() | (c["t_end"] < c["t_start"]), "t_end before t_start")
    )


#: Kind header to the name that a record is routed by.
ROUTES = {"RECORD_KIND_SIGNAL": "signal", "RECORD_KIND_PERCEPTION": "perception", "RECORD_KIND_SEGMENT_REF": "segment"}


def route(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair]), kind)


def error_class(validation_error: Column, routed: Column, parsed: Column, rule: Column) -> Column:
    """Dead-letter class, or null for a record to store."""
    return (
        F.when(validation_error.isNotNull() | routed.isNull(), "SCHEMA_VALIDATION_FAILURE")
        .when(~parsed, "PARSE_FAILURE")
        .when(rule.isNotNull(), "BUSINESS_RULE_FAILURE")
    )


def error_step(validation_error: Column, routed: Column, parsed: Column, rule: Column) -> Column:
    """Where a bad record failed: envelope, route, decode, or validate- and its kind."""
    return (
        F.when(validation_error.isNotNull(), "envelope").when(routed.isNull(), "route").when(~parsed, "decode")
        .when(rule.isNotNull(), F.concat(F.lit("validate-"), routed))
    )


def error_message(validation_error: Column, kind: Column, routed: Column, parsed: Column, rule: Column) -> Column:
    return F.coalesce(validation_error, F.when(routed.isNull(), F.coalesce(F.concat(F.lit("unknown kind: "), kind), F.lit("no kind header"))), F.when(~parsed, "value can't be decoded"), rule)


def live(stream: Column, event_ms: Column, interval_ms: Column, now_ms: Column, legacy_ms: int = 5_000) -> Column:
    """History never is; a record without a stream always is; others by their age."""
    age = now_ms - event_ms
    return F.when(stream == "history", False).when(stream.isNull() | (stream == "legacy"), True).otherwise((age >= -5_000) & (age < freshness_ms(interval_ms, legacy_ms)))


def freshness_ms(interval_ms: Column, least: int) -> Column:
    return F.greatest(F.lit(least), interval_ms * 3)


def clip_request_error(start_us: Column, end_us: Column, identifier: Column) -> Column:
    return (
        F.when(identifier.isNull() | ~identifier.rlike("^[a-zA-Z0-9_-]{1,80}$"), "invalid identity")
        .when(start_us.isNull() | end_us.isNull() | (start_us < 0) | (end_us <= start_us) | (end_us - start_us > 60_000_000), "clip window must be positive and at most 60 seconds")
    )


def has_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0 if wanted else F.lit(True)
