"""Queries of the record jobs, the uplink's frames and the control plane, each beside its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import control
from ..sources import avro, files, frames
from ..streaming import machines, pipelines
from ..streaming.runner import over_table
from .catalog import _ARRIVALS, _BOUNDS, _BOX, _ODD_ROWS, _SEG, _arrivals
from .registry import query
from .testbed import Testbed


def _record(kind: str, value, offset: str, vehicle: str = "vehicle_id", boot: str = "boot_id", seq: str = "seq") -> list:
    """Columns of a broker's record."""
    named = {"vehicle_id": F.col(vehicle), "boot_id": F.col(boot), "seq": F.col(seq).cast("string"), "kind": F.lit(kind)}
    headers = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value")) for k, v in named.items()])
    return [F.lit("telemetry.records").alias("topic"), F.lit(0).alias("partition"), F.col(offset).cast("long").alias("offset"), F.encode(F.col(vehicle), "UTF-8").alias("key"), value.alias("value"), headers.alias("headers"), F.timestamp_micros(F.lit(0)).alias("timestamp")]


def _signal_bytes():
    v, k = (F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("value", "k"))
    values = {"sensor_time": F.col("t_us"), "log_time": F.col("t_us"), "values_num": F.create_map(F.lit("vehicle_speed"), v - 3), "values_vec": F.create_map(F.lit("translation"), F.array(v * 10 - 200, k * 12.5 - 400, F.lit(0.0))), "values_str": F.create_map(F.lit("location"), F.col("location"))}
    whole = avro.encoded(avro.SIGNAL, values)
    return F.when(F.col("event_id") % 13 == 0, F.substring(whole, 1, 5)).otherwise(whole)


def _signals(t: Testbed) -> DataFrame:
    return t.events().select(*_record("RECORD_KIND_SIGNAL", _signal_bytes(), "event_id"))


def _all_kinds(t: Testbed) -> DataFrame:
    real = {n: F.col(n).cast("double") for n, of in avro.PERCEPTION if of == "double"}
    boxes = avro.encoded(avro.PERCEPTION, real | {"sensor_time": F.unix_micros("sensor_time"), "attribute": F.lit(None).cast("string")})
    clips = avro.encoded(avro.SEGMENT, {"t_start": F.col("start_us"), "t_end": F.col("end_us"), "drop_reason": F.lit(None).cast("string"), "calibration": F.create_map(F.lit("CAM_FRONT"), F.lit("{}"))})
    p = t.perception().select(*_record("RECORD_KIND_PERCEPTION", boxes, "seq"))
    s = t.segments().select(*_record("RECORD_KIND_SEGMENT_REF", clips, "seq"))
    return _signals(t).unionByName(p).unionByName(s)


_SIGNAL_CLASS = "case when event_id % 13 = 0 then 'PARSE_FAILURE' when value - 3 < 0 then 'BUSINESS_RULE_FAILURE' else 'stored' end"


@query("storage_by_kind", f"""
, r as (select 'signal' kind, {_SIGNAL_CLASS} outcome from e
  union all select 'perception', case when {_BOX} is null then 'stored' else 'BUSINESS_RULE_FAILURE' end from perception
  union all select 'segment', case when {_SEG} is null then 'stored' else 'BUSINESS_RULE_FAILURE' end from segments)
select kind, outcome, count(*) n from r group by 1, 2""")
def _(t: Testbed):
    d = pipelines.decoded(_all_kinds(t))
    return d.groupBy(F.col("routed").alias("kind"), F.coalesce("error_class", F.lit("stored")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("stored_boxes", f"select vehicle_id, seq, sample_id, t_us, track_id, category, visibility, cast(num_lidar_pts as bigint) num_lidar_pts, cast(num_radar_pts as bigint) num_radar_pts, size_l from perception where {_BOX} is null")
def _(t):
    b = pipelines.bound(pipelines.decoded(_all_kinds(t), only="perception"), "perception")
    return b.select("vehicle_id", "seq", "sample_id", F.unix_micros("sensor_time").alias("t_us"), "track_id", "category", "visibility", "num_lidar_pts", "num_radar_pts", "size_l")


@query("stored_clips", f"select vehicle_id, seq, segment_id, start_us, end_us, case when o_orderkey % 3 = 0 then 'CAM_FRONT,LIDAR_TOP' else 'CAM_FRONT' end channels, size_bytes, state, cast(date_trunc('day', make_timestamp(start_us)) as date) date from segments where {_SEG} is null")
def _(t):
    b = pipelines.bound(pipelines.decoded(_all_kinds(t), only="segment"), "segment")
    return b.select("vehicle_id", "seq", "segment_id", F.unix_micros("t_start").alias("start_us"), F.unix_micros("t_end").alias("end_us"), F.array_join("sensor_channels", ",").alias("channels"), "size_bytes", "state", "date")


@query("dlq_rows", f"""select event_id source_offset, {_SIGNAL_CLASS} error_class, case when event_id % 13 = 0 then 'decode' else 'validate-signal' end error_step,
 case when event_id % 13 = 0 then 'value can''t be decoded' else 'vehicle_speed < 0' end error_message, vehicle_id, seq, 2 format_version from e where event_id % 13 = 0 or value - 3 < 0""")
def _(t):
    return pipelines.dead_letters(pipelines.decoded(_signals(t))).select("source_offset", "error_class", "error_step", "error_message", "vehicle_id", "seq", "format_version")


@query("dedup_routed", _ARRIVALS + "select vehicle_id, ofs source_offset, verdict from ve where verdict in ('ACCEPT', 'LATE', 'BOOT_RESET')")
def _(t):
    records = _arrivals(t).select(*_record("RECORD_KIND_SIGNAL", F.encode(F.lit("x"), "UTF-8"), "offset"))
    d = pipelines.deduplicated(records, window=32)
    return d.select(F.decode("key", "UTF-8").alias("vehicle_id"), F.col("offset").alias("source_offset"), "verdict")


@query("container_values", "select event_id source_offset, vehicle_id, seq from e where event_id % 13 = 0")
def _(t):
    letters = pipelines.dead_letters(pipelines.decoded(_signals(t))).where("error_class = 'PARSE_FAILURE'")

    def unpacked(batches):
        for b in batches:
            rows = [avro.from_container(bytes(v), avro.DEAD_LETTER)[0] for v in b["value"]]
            yield pd.DataFrame([(r["source_offset"], r["vehicle_id"], r["seq"]) for r in rows], columns=["source_offset", "vehicle_id", "seq"])

    return pipelines.dead_letter_values(letters).mapInPandas(unpacked, "source_offset long, vehicle_id string, seq long")


@query("alerts_read_back", f"""{_ODD_ROWS}
select vehicle_id, case when outside and not coalesce(was, false) then 'ODD_EXITED' else 'ODD_RETURNED' end as type, boot_id, seq, ms event_ms, location from w where (outside and not coalesce(was, false)) or (not outside and was)""")
def _(t):
    """Alerts of the area monitor, written as a topic's values and read by the library's own source."""
    poses = t.signals_raw().where("dup = 0").select("vehicle_id", "boot_id", "seq", F.floor(F.col("t_us") / 1000).alias("event_ms"), F.floor(F.col("t_us") / 1000).alias("received_ms"), "location", "lat", "lon", "offset")
    alerts = over_table(poses, machines.AreaMonitor, "vehicle_id", ["offset"], bounds=_BOUNDS, stale_ms=10**12, sustained_ms=10**9)
    read = files.alerts_from_json(pipelines.alert_values(alerts))
    return read.where("type <> 'ODD_SUSTAINED' and message is not null").select("vehicle_id", "type", "boot_id", "seq", "event_ms", "location")


@query("clip_lines", """select '{"clip_id":"' || segment_id || '","vehicle_id":"' || vehicle_id || '","size_bytes":' || size_bytes || ',"state":"' || state || '"}' as line from segments""")
def _(t):
    return files.json_lines(t.segments().select(F.col("segment_id").alias("clip_id"), "vehicle_id", "size_bytes", "state"))


# ---- frames of the uplink ----


def _wires(t: Testbed) -> DataFrame:
    """Frames of up to 16 records in unbroken sequence, of both versions; some are damaged or come under another topic."""
    rows = t.events().withColumn("g", F.floor(F.col("rn") / 17).cast("long")).groupBy("user_id", "vehicle_id", "g").agg(F.sort_array(F.collect_list(F.struct("seq", "event_id"))).alias("rows"))  # 16 at most

    def coded(user: pd.Series, vehicle: pd.Series, g: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for u, v, n, r in zip(user, vehicle, g, rows):
            batch = {"vehicle_id": v, "boot_id": "b0", "stream": "status", "records": [{"seq": int(x["seq"]), "kind": "signal", "payload": str(x["event_id"]).encode(), "report_interval_ms": 1000} for x in r]}
            wire = frames.frame(batch, 1 + int(n) % 2)
            out.append(wire[:-1] + b"!" if (u + n) % 7 == 0 else wire)
        return pd.Series(out, dtype=object)

    wire = F.pandas_udf(coded, "binary")("user_id", "vehicle_id", "g", "rows")
    topic = F.concat(F.lit("fleet/v1/"), F.when((F.col("user_id") + F.col("g")) % 11 == 0, "other").otherwise(F.col("vehicle_id")), F.lit("/up/status"))
    return frames.frames(rows.select("user_id", "vehicle_id", "g", wire.alias("wire"), topic.alias("topic")))


_WIRES = """, w as (select user_id, vehicle_id, seq // 17 g, count(*) n, min(seq) first_seq from e group by 1, 2, 3),
 c as (select *, case when (user_id + g) % 7 = 0 then case when g % 2 = 1 then 'digest mismatch' else 'malformed' end when (user_id + g) % 11 = 0 then 'topic names another vehicle or stream' end error from w)
"""


@query("wire_frames", _WIRES + "select vehicle_id, g, error, case when error is null then cast(1 + g % 2 as int) end as version, case when error is null then n end n, case when error is null then first_seq end first_seq from c")
def _(t):
    f = F.col("frame.records")
    n = F.when(F.col("frame.error").isNull(), F.size(f).cast("long"))
    return _wires(t).select("vehicle_id", "g", "frame.error", "frame.version", n.alias("n"), F.get(f, F.lit(0))["seq"].alias("first_seq"))


@query("relayed_records", _WIRES + "select e.vehicle_id, cast(seq as varchar) seq, cast(event_id as varchar) payload, 'RECORD_KIND_SIGNAL' kind, 'b0' source_boot_id, '1000' report_interval_ms from e join c on e.user_id = c.user_id and e.seq // 17 = c.g where error is null")
def _(t):
    r = frames.relayed(_wires(t))
    named = lambda n: F.decode(F.filter("headers", lambda h: h["key"] == n)[0]["value"], "UTF-8").alias(n)
    return r.select(named("vehicle_id"), named("seq"), F.decode("value", "UTF-8").alias("payload"), named("kind"), named("source_boot_id"), named("report_interval_ms"))


@query("batch_acks", """, b as (select user_id, seq // 17 g, count(*) n from e group by 1, 2),
 x as (select user_id, seq // 17 g, seq pos, event_id ord, event_id % 97 <> 0 ok from e where event_id % 89 <> 0 union all select user_id, seq // 17, seq, event_id + 1000000000, event_id % 97 = 0 from e where event_id % 5 = 0),
 fc as (select user_id, g, pos, arg_min(ok, ord) ok from x group by 1, 2, 3)
select b.* from b join (select user_id, g, count(*) done, bool_and(ok) a from fc group by 1, 2) d using (user_id, g) where done = n and a""")
def _(t):
    e = t.events().withColumn("g", F.floor(F.col("rn") / 17).cast("long"))
    told = "array_compact(array(if(event_id % 89 <> 0, named_struct('order', event_id, 'ok', event_id % 97 <> 0), null), if(event_id % 5 = 0, named_struct('order', event_id + 1000000000, 'ok', event_id % 97 = 0), null)))"
    completions = e.selectExpr("user_id", "g", "seq as at", f"inline({told})")
    return frames.acknowledged(e.groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("n")), completions, ["user_id", "g"])


@query("canonical_json", """select event_id, '{"a":' || k || ',"b":[' || seq || ',null],"z":"' || vehicle_id || '"}' as j from e""")
def _(t):
    j = F.concat(F.lit('{ "z": "'), "vehicle_id", F.lit('", "b" : ['), F.col("seq").cast("string"), F.lit(', null], "a":'), F.col("k").cast("string"), F.lit("}"))
    return t.events().select("event_id", frames.canonical_json(j).alias("j"))


# ---- control plane ----

_NOW = 1_705_000_000_000


@query("command_receipts", f"""
, c as (select vehicle_id, 'c' || (event_id % 40) id, 'w' || (k % 2) wire, case event_id % 4 when 0 then 'diagnostic' when 3 then 'other' else 'collection_policy' end typ, k ver, {_NOW} + (event_id % 6 - 1) * 100000 ex, event_id o from e),
 fc as (select *, row_number() over w = 1 first, first_value(wire) over w fw from c window w as (partition by vehicle_id, id order by o)),
 m as (select *, max(case when first and ex > {_NOW} and ex <= {_NOW} + 300000 and typ = 'collection_policy' then ver end) over (partition by vehicle_id order by o rows between unbounded preceding and 1 preceding) top from fc),
 r as (select *, case when ex <= {_NOW} then 'expired' when ex > {_NOW} + 300000 then 'command lifetime exceeds five minutes' when typ = 'collection_policy' and ver <= coalesce(top, 0) then 'stale policy version' when typ = 'other' then 'unsupported command type' else '' end own from m),
 t as (select *, case when wire = fw then first_value(own) over (partition by vehicle_id, id order by o) else 'id reused' end told from r)
select vehicle_id, o event_id, case told when '' then 'applied' when 'expired' then 'expired' else 'rejected' end status, nullif(told, '') reason from t""")
def _(t):
    c = t.events().selectExpr(
        "vehicle_id", "concat('c', event_id % 40) as command_id", "concat('w', k % 2) as wire", "case event_id % 4 when 0 then 'diagnostic' when 3 then 'other' else 'collection_policy' end as type",
        "cast(k as bigint) as version", f"{_NOW} + (event_id % 6 - 1) * 100000 as expires_ms", f"{_NOW} as now_ms", "event_id as order",
    )
    return control.receipts(c).select("vehicle_id", F.col("order").alias("event_id"), "status", "reason")


@query("due_jobs", f"select o_orderkey id from segments where start_us // 1000 <= 800000000000 and (o_orderkey % 3 <> 0 or o_orderkey % 6 = 0) order by start_us // 1000, o_orderkey limit 5")
def _(t):
    jobs = t.segments().select(F.col("o_orderkey").alias("id"), F.floor(F.col("start_us") / 1000).cast("long").alias("next_attempt_ms"), F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 6 == 0, 1).otherwise(900_000_000_000)).cast("long").alias("lease_until_ms"))
    return control.due_jobs(jobs, 800_000_000_000, 5).select("id")


@query("ring_retention", """, y as (select vehicle_id, event_id, t_us, k + 1 size, event_id % 10 = 0 pin from e where event_id % 10 = 0 or t_us >= 1705000000000000 - 1000000000000),
 q as (select *, coalesce(sum(size) filter (pin) over (partition by vehicle_id), 0) + coalesce(sum(case when pin then 0 else size end) over (partition by vehicle_id order by t_us desc, event_id desc rows unbounded preceding), 0) used from y)
select vehicle_id, event_id from q where pin or used <= 500""")
def _(t):
    e = t.events().selectExpr("vehicle_id", "event_id", "t_us", "cast(k + 1 as bigint) as size", "event_id % 10 = 0 as pin")
    kept = control.ring_retention(e, ["vehicle_id"], [F.desc("t_us"), F.desc("event_id")], "t_us", "size", "pin", 1_705_000_000_000_000, 1_000_000_000_000, 500)
    return kept.select("vehicle_id", "event_id")


@query("clip_check", """, c as (select o_orderkey, start_us, end_us, size_bytes + 1000000 - (o_orderkey % 50 = 0)::int * 100000000000 sz, case when o_orderkey % 9 = 0 then 'A' else 'a' end || repeat('b', 63) sha, case o_orderkey % 5 when 0 then 1000 when 1 then 0 else 5242880 end part, o_orderkey % 7 sc, o_orderkey % 11 ch, o_orderkey % 13 cal from segments)
select o_orderkey, case when start_us <= 0 or end_us < start_us then 'invalid clip times' when not sz between 1 and 5497558138880 then 'size must be within 1 and 5 TiB' when not regexp_matches(sha, '^[0-9a-f]{64}$') then 'sha256 must be lowercase hex' when part = 0 then 'invalid part size'
 when sz > part and part < 5242880 then 'parts but the last must have 5 MiB' when 1 + (sz - 1) // part > 1000 then 'too many parts' when sc = 0 then 'sample count must be positive' when ch = 0 then 'invalid channels' when cal = 0 then 'calibration must be JSON' end error from c""")
def _(t):
    k = F.col("o_orderkey")
    size = F.col("size_bytes") + 1_000_000 - F.when(k % 50 == 0, 100_000_000_000).otherwise(0)
    part = F.when(k % 5 == 0, 1000).when(k % 5 == 1, 0).otherwise(5_242_880)
    part = F.when(part == 0, None).otherwise(part)
    sha = F.concat(F.when(k % 9 == 0, "A").otherwise("a"), F.repeat(F.lit("b"), 63))
    channels = F.array(F.when(k % 11 == 0, " ").otherwise("CAM_FRONT"))
    calibration = F.create_map(F.lit("CAM_FRONT"), F.when(k % 13 == 0, "{").otherwise("{}"))
    return t.segments().select("o_orderkey", control.clip_error(F.col("start_us"), F.col("end_us"), size, sha, part, k % 7, channels, calibration).alias("error"))


@query("identity_check", "select event_id, case when k % 6 = 0 then 'invalid identity' when k % 5 = 0 then 'clip window must be positive and at most 60 seconds' end error from e")
def _(t):
    from ..operators.validate import clip_request_error

    name = F.when(F.col("k") % 6 == 0, "not a name").otherwise(F.col("vehicle_id"))
    end = F.col("t_us") + F.when(F.col("k") % 5 == 0, F.when(F.col("k") % 2 == 0, 0).otherwise(60_000_001)).otherwise(60_000_000)
    return t.events().select("event_id", clip_request_error(F.col("t_us"), end, name).alias("error"))


@query("location_label", "select event_id, replace(replace(location, 'singapore-', 'sg-'), 'boston-', 'bos-') as label, value / 3.6 as mps from e")
def _(t):
    return t.events().select("event_id", text.location_label(F.col("location")).alias("label"), text.metres_per_second(F.col("value")).alias("mps"))


@query("edge_backoff", "select event_id, least(60.0, pow(2.0, least(k - 1, 6))) * 1.25 as s from e")
def _(t):
    return t.events().select("event_id", text.edge_backoff_s(F.col("k"), F.lit(0.25)).alias("s"))


@query("ack_batches_closed", ", d as (select distinct vehicle_id, seq from e where seq <> 40), n as (select *, row_number() over (partition by vehicle_id order by seq) - 1 i from d) select vehicle_id, max(seq) filter (seq = i) ack from n group by 1 having max(seq) filter (seq = i) is not null")
def _(t):
    """What an acknowledging machine has told in the end, drained: the contiguous prefix."""
    rows = t.events().where("seq <> 40").selectExpr("vehicle_id as key", "seq", "floor(t_us / 1000) as at_ms")
    told = over_table(rows, machines.AckTracker, "key", ["at_ms", "seq"], close_ms=1 << 60, every=16, every_ms=10**12)
    last = told.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("ack")))).where("r = 1")
    return last.select(F.col("key").alias("vehicle_id"), "ack")
