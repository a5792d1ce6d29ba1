"""The registered queries, each beside the SQL that must give the same rows.

Times are micro- or milliseconds as long; computed floats are cut to six places on both sides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import aggregates, dedup, joins, latest, marks, sequences, validate
from ..sources import avro
from ..streaming import machines
from ..session import cut
from ..streaming.runner import over_table
from .registry import ORACLE_SQL, QUERIES, cut6, query, sql6, us  # noqa: F401
from .testbed import Testbed, enu_sql

# ---- read queries ----


@query("fleet_roster", f"""
, sc as (select vehicle_id, scene_id, count(*) n, max(t_us) st, max(t_us) // 1000 - min(t_us) // 1000 ms, arg_max({{'lat': lat, 'lon': lon, 'loc': location}}, row(t_us, boot_id, seq)) filter (lat is not null and lon is not null) p,
  max(t_us) filter (lat is not null and lon is not null) pt from signals group by 1, 2),
fl as (select vehicle_id, arg_max(scene_id, row(st, scene_id)) scene_id, arg_max(p, row(pt, scene_id)) filter (pt is not null) p, sum(n) n, sum(ms) ms from sc group by 1)
select vehicle_id, scene_id, coalesce(p.loc, '') as location, cast(n as bigint) n_records, cast(ms as bigint) recorded_ms, {sql6("p.lat")} last_lat, {sql6("p.lon")} last_lon from fl""")  # fmt: skip
def _(t: Testbed):
    r = aggregates.fleet_roster(t.signals())
    return r.select("vehicle_id", "scene_id", "location", "n_records", "recorded_ms", cut6("last_lat").alias("last_lat"), cut6("last_lon").alias("last_lon"))


@query("signals_final", f"select vehicle_id, boot_id, seq, channel, t_us, ingest_us, value, {sql6('lat')} lat from signals")
def _(t):
    return t.signals().select("vehicle_id", "boot_id", "seq", "channel", "t_us", us("ingest_time").alias("ingest_us"), "value", cut6("lat").alias("lat"))


@query("dup_pressure", """
select 'signals' as "table", count(*) rows_raw, count(distinct (vehicle_id, boot_id, seq)) rows_distinct, count(*) - count(distinct (vehicle_id, boot_id, seq)) pending_dupes from signals_raw
union all select 'perception', count(*), count(distinct (vehicle_id, boot_id, seq)), count(*) - count(distinct (vehicle_id, boot_id, seq)) from perception
union all select 'segments', count(*), count(distinct (vehicle_id, boot_id, seq)), count(*) - count(distinct (vehicle_id, boot_id, seq)) from segments""")
def _(t):
    return aggregates.duplicate_pressure({"signals": t.signals_raw(), "perception": t.perception(), "segments": t.segments()})


_PROGRESS = "select vehicle_id, boot_id, min(seq) first_seq, max(seq) last_seq, count(*) received, max(seq) - min(seq) + 1 expected, max(seq) - min(seq) + 1 - count(*) missing from {} group by 1, 2"


@query("vehicle_progress", _PROGRESS.format("(select * from signals where channel <> 'ms_imu')"))
def _(t):
    return aggregates.vehicle_progress(t.signals().where("channel <> 'ms_imu'"))


@query("progress_all_kinds", _PROGRESS.format("signals"))
def _(t):
    return aggregates.vehicle_progress(t.signals())


@query("total_missing", "select cast(sum(m) as bigint) missing from (select max(seq) - min(seq) + 1 - count(*) m from signals group by vehicle_id, boot_id)")
def _(t):
    return aggregates.vehicle_progress(t.signals()).agg(F.sum("missing").alias("missing"))


@query("layer_counts", "select (select count(*) from signals) signals, (select count(*) from perception) perception, (select count(*) from segments) segments")
def _(t):
    return aggregates.layer_counts({"signals": t.signals(), "perception": t.perception(), "segments": t.segments()})


@query("time_range", "select min(t_us) lo, max(t_us) hi from signals")
def _(t):
    return t.signals().agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))


_FROM, _TO = 1_705_000_000_000_000, 1_705_400_000_000_000


@query("next_record", f"select min(t_us) t from signals where t_us > {_TO}")
def _(t):
    return t.signals().where(F.col("t_us") > _TO).agg(F.min("t_us").alias("t"))


@query("signal_window", f"select vehicle_id, boot_id, seq, channel, t_us, value, location from signals where t_us > {_FROM} and t_us <= {_TO} order by t_us, seq, vehicle_id, boot_id limit 200")
def _(t):
    return latest.time_window(t.signals(), _FROM, _TO, "t_us").orderBy("t_us", "seq", "vehicle_id", "boot_id").limit(200).select("vehicle_id", "boot_id", "seq", "channel", "t_us", "value", "location")


@query("signal_batches", f"select vehicle_id, min(t_us) t_us, count(*) n from signals where t_us > {_FROM} and t_us <= {_TO} group by 1")
def _(t):
    return latest.time_window(t.signals(), _FROM, _TO, "t_us").groupBy("vehicle_id").agg(F.min("t_us").alias("t_us"), F.count(F.lit(1)).alias("n"))


_R4 = "floor(({}) * 1e4 + 0.5) / 1e4"


@query("keyframe_agg", f"""
select vehicle_id, sample_id, t_us, count(*) n_objects, count(*) filter (num_lidar_pts = 0) n_zero_lidar,
 array_to_string(list(printf('%.4f', {_R4.format('center_x')}) || '/' || string_split(category, '.')[-1] || '/' || num_lidar_pts || '/' || visibility order by seq, category, center_x, center_y, size_w, size_l, rot_z, visibility, num_lidar_pts), ';') boxes
from perception group by 1, 2, 3""")  # fmt: skip
def _(t):
    k = aggregates.keyframes(t.perception())
    shown = F.array_join(F.transform("boxes", lambda b: F.concat(F.format_string("%.4f", b["center"][0]), F.lit("/"), b["class"], F.lit("/"), b["lidar"], F.lit("/"), b["visibility"])), ";")
    return k.select("vehicle_id", "sample_id", us("sensor_time").alias("t_us"), "n_objects", "n_zero_lidar", shown.alias("boxes"))


@query("keyframe_classes", "select vehicle_id, sample_id, string_split(category, '.')[-1] as class, count(*) n from perception group by all")
def _(t):
    k = aggregates.keyframes(t.perception())
    return k.select("vehicle_id", "sample_id", F.explode("classes").alias("c")).select("vehicle_id", "sample_id", F.col("c.class").alias("class"), F.col("c.n").cast("long").alias("n"))


@query("keyframe_summary", f"""
, b as (select *, case when contains(category, '.') then string_split(category, '.')[2] else category end cls from perception),
r as (select vehicle_id, sample_id, cls, count(*) n, row_number() over (partition by vehicle_id, sample_id order by count(*) desc, cls) r from b group by 1, 2, 3)
select vehicle_id, sample_id, cast(sum(n) as bigint) n_objects, array_to_string(list(cls || '=' || n order by r) filter (r <= 6), ',') classes from r group by 1, 2""")
def _(t):
    k = aggregates.keyframe_summary(t.perception())
    return k.select("vehicle_id", "sample_id", "n_objects", F.array_join(F.transform("classes", lambda c: F.concat(c["class"], F.lit("="), c["n"])), ",").alias("classes"))


@query("clip_catalog", "select segment_id clip_id, vehicle_id, scene_id scene_name, blob_uri, size_bytes, sample_count, state from segments order by start_us desc, vehicle_id, boot_id, seq limit 100")
def _(t):
    return aggregates.clips(t.segments()).select("clip_id", "vehicle_id", "scene_name", "blob_uri", "size_bytes", "sample_count", "state")


@query("clip_duration", "select segment_id clip_id, (end_us // 1000 - start_us // 1000) / 1000.0::double duration_s from segments order by start_us desc, vehicle_id, boot_id, seq limit 1000")
def _(t):
    return aggregates.clips(t.segments(), 999_999).select("clip_id", "duration_s")


# ---- geometry ----

_XY = ("value * 10 - 200", "k * 12.5 - 400")
_BACK = """, g as (select event_id, lat, lon, radians(lat) a, radians(lon) - radians({0}) d, radians({1}) l0 from signals where lat is not null)
select event_id, floor(6378137.0 * acos(greatest(-1.0, least(1.0, sin(l0) * sin(a) + cos(l0) * cos(a) * cos(d)))) * sin(atan2(sin(d) * cos(a), cos(l0) * sin(a) - sin(l0) * cos(a) * cos(d))) + 0.25) x,
 floor(6378137.0 * acos(greatest(-1.0, least(1.0, sin(l0) * sin(a) + cos(l0) * cos(a) * cos(d)))) * cos(atan2(sin(d) * cos(a), cos(l0) * sin(a) - sin(l0) * cos(a) * cos(d))) + 0.25) y from g"""


@query("enu_to_wgs84", f"select event_id, dup, {sql6('lat')} lat, {sql6('lon')} lon from signals_raw")
def _(t):
    return t.signals_raw().select("event_id", "dup", cut6("lat").alias("lat"), cut6("lon").alias("lon"))


def _origin_sql(k: int) -> str:
    return "case location " + " ".join(f"when '{n}' then {p[k]!r}" for n, p in geo.ORIGINS.items()) + " end"


@query("wgs84_to_enu", _BACK.format(_origin_sql(1), _origin_sql(0)))
def _(t):
    s = t.signals().where("lat is not null").withColumn("p", geo.wgs84_to_enu(F.col("lat"), F.col("lon"), F.col("location")))
    return s.select("event_id", F.floor(F.col("p.x") + 0.25).cast("double").alias("x"), F.floor(F.col("p.y") + 0.25).cast("double").alias("y"))


@query("mercator_scale", f"select event_id, {sql6('1 / cos(radians(lat))')} s from signals where lat is not null")
def _(t):
    return t.signals().where("lat is not null").select("event_id", cut6(geo.mercator_scale(F.col("lat"))).alias("s"))


_STEP = ", p as (select vehicle_id, event_id, lat, lon, lag(lat) over w lat0, lag(lon) over w lon0 from signals where lat is not null window w as (partition by vehicle_id order by t_us, event_id))"


@query("haversine", _STEP + " select event_id, floor(1e3 * 2 * 6378137.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) + 0.5) / 1e3 m from p where lat0 is not null")
def _(t):
    by = W.partitionBy("vehicle_id").orderBy("t_us", "event_id")
    p = t.signals().where("lat is not null").withColumns({"lat0": F.lag("lat").over(by), "lon0": F.lag("lon").over(by)}).where("lat0 is not null")
    return p.select("event_id", geo.round_half_up(geo.haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 3).alias("m"))


_BEARING = "degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0))))"


@query("bearing_heading", _STEP + f", q as (select *, case when abs(lat - lat0) + abs(lon - lon0) > 1e-6 then fmod({_BEARING} + 360.0, 360.0) end step from p), h as (select event_id, last_value(step ignore nulls) over (partition by vehicle_id order by rn rows unbounded preceding) heading from (select q.*, s.t_us, row_number() over (partition by q.vehicle_id order by s.t_us, q.event_id) rn from q join signals s using (event_id))) select event_id, floor(heading * 1e3 + 0.5) / 1e3 heading from h")
def _(t):
    h = sequences.heading(t.signals().where("lat is not null"), "vehicle_id", ["t_us", "event_id"])
    return h.select("event_id", geo.round_half_up(F.col("heading"), 3).alias("heading"))


_CORNER = [(0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5)]
_cx, _cy = "center_x / 10 + size_l * {0} * cos(yaw) - size_w * {1} * sin(yaw)", "center_y / 10 + size_l * {0} * sin(yaw) + size_w * {1} * cos(yaw)"
_points = [enu_sql(_cx.format(a, b), _cy.format(a, b), "'boston-seaport'") for a, b in _CORNER]


@query("box_footprint", ", b as (select *, 2 * asin(rot_z) yaw from perception) select l_orderkey, l_partkey, seq, center_x, " + ", ".join(f"{sql6(lon)} lon{i}, {sql6(lat)} lat{i}" for i, (lat, lon) in enumerate(_points)) + " from b")
def _(t):
    ring = geo.box_footprint(F.col("center_x") / 10, F.col("center_y") / 10, F.col("size_w"), F.col("size_l"), geo.yaw_approx(F.col("rot_z")), F.lit("boston-seaport"))
    b = t.perception().withColumn("ring", ring)  # the compiler shares what the corners have in common
    return b.select("l_orderkey", "l_partkey", "seq", "center_x", *[cut6(F.col("ring")[i][j]).alias(f"{n}{i}") for i in range(4) for j, n in ((0, "lon"), (1, "lat"))])


@query("yaw_approx", f"select l_orderkey, l_partkey, seq, {sql6('2 * asin(greatest(-1.0, least(1.0, rot_z * 1.01)))')} yaw from perception")
def _(t):
    return t.perception().select("l_orderkey", "l_partkey", "seq", cut6(geo.yaw_approx(F.col("rot_z") * 1.01)).alias("yaw"))


@query("yaw_true", f"select l_orderkey, l_partkey, seq, {sql6('atan2(2 * (rot_w * rot_z + rot_x * rot_y), 1 - 2 * (rot_y * rot_y + rot_z * rot_z))')} yaw from perception")
def _(t):
    return t.perception().select("l_orderkey", "l_partkey", "seq", cut6(geo.yaw_true(*map(F.col, ("rot_w", "rot_x", "rot_y", "rot_z")))).alias("yaw"))


@query("round4", f"select l_orderkey, l_partkey, seq, {_R4.format('-center_x / 7')} r from perception")
def _(t):
    return t.perception().select("l_orderkey", "l_partkey", "seq", geo.round_half_up(-F.col("center_x") / 7).alias("r"))


@query("vector_norm", f"select vec_id, {sql6('sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))))')} norm from embeddings", base=False)
def _(t):
    return t.table("embeddings").select("vec_id", cut6(geo.norm(F.col("embedding").cast("array<double>"))).alias("norm"))


# ---- envelope, validation, dead letters ----

_HEADERS = """
array_compact(array(
  if(event_id % 19 = 0, null, named_struct('key', 'vehicle_id', 'value', encode(vehicle_id, 'UTF-8'))), named_struct('key', 'boot_id', 'value', encode(if(event_id % 11 = 0, 'clip-x', boot_id), 'UTF-8')),
  named_struct('key', 'seq', 'value', encode(cast(if(event_id % 23 = 0, -1, if(event_id % 11 = 0, 0, seq)) as string), 'UTF-8')),
  named_struct('key', 'kind', 'value', encode(if(event_id % 11 = 0, 'RECORD_KIND_SEGMENT_REF', 'RECORD_KIND_SIGNAL'), 'UTF-8')),
  if(event_id % 3 = 0, named_struct('key', 'stream_id', 'value', encode(if(event_id % 29 = 0, 'other', 'status'), 'UTF-8')), null),
  if(event_id % 3 = 0 and event_id % 5 <> 0, named_struct('key', 'source_boot_id', 'value', encode('sb', 'UTF-8')), null),
  if(event_id % 3 = 0, named_struct('key', 'report_interval_ms', 'value', encode(cast(k * 10 as string), 'UTF-8')), null),
  if(event_id % 11 = 0, named_struct('key', 'producer_origin', 'value', encode('clip-upload', 'UTF-8')), null)))"""


def _envelopes(t: Testbed) -> DataFrame:
    r = t.events().selectExpr("*", f"{_HEADERS} as headers", "encode(if(event_id % 31 = 0, 'x', vehicle_id), 'UTF-8') as key", "'telemetry.records' as topic", "cast(user_id % 3 as int) as partition", "event_id as offset")
    return validate.envelope(r.select("event_id", "headers", "key", "topic", "partition", "offset"))


_ENVELOPE = """, h as (select event_id, user_id, vehicle_id v, case when event_id % 11 = 0 then 'clip-x' else boot_id end b, case when event_id % 23 = 0 then -1 when event_id % 11 = 0 then 0 else seq end s, k, event_id % 3 = 0 st, event_id % 11 = 0 clip from e),
x as (select *, case when event_id % 19 = 0 then 'missing identity header' when event_id % 31 = 0 then 'key differs from vehicle_id' when st and event_id % 5 = 0 then 'source_boot_id is required' when st and event_id % 29 = 0 then 'unknown stream_id'
  when st and not (k * 10 between 100 and 60000) then 'invalid report interval' when s < 0 then 'negative sequence' when clip and (s <> 0 or st) then 'invalid clip reference identity' end err from h)
"""


@query("envelope_check", _ENVELOPE + "select event_id, err validation_error, case when err is null then v end vehicle_id, case when err is null then s end seq, case when err is not null then 'invalid' when st then 'status' else 'legacy' end stream_id, cast(case when err is null and st then k * 10 else 0 end as bigint) report_interval_ms from x")
def _(t):
    return _envelopes(t).select("event_id", "validation_error", "vehicle_id", "seq", "stream_id", F.col("report_interval_ms").cast("long").alias("report_interval_ms"))


@query("dedup_key", _ENVELOPE + "select event_id, case when err is not null then 'invalid|telemetry.records|' || (user_id % 3) when st then v || '|' || b || '|status' else v end dedup_key from x")
def _(t):
    return _envelopes(t).select("event_id", F.translate("dedup_key", "\0", "|").alias("dedup_key"))


@query("validate_signal", "select event_id, case when value - 3 < 0 then 'vehicle_speed < 0' end error from signals")
def _(t):
    return t.signals().select("event_id", validate.signal_error().alias("error"))


@query("validate_quaternion", """, q as (select vec_id, list_transform(embedding[1:4], lambda x: cast(x as double)) q from embeddings)
select vec_id, case when abs(sqrt(list_sum(list_transform(q, lambda x: x * x))) - 1) > 0.001 then 'rotation is not a unit quaternion' end error from q""")
def _(t):
    q = t.table("embeddings").select("vec_id", F.create_map(F.lit("rotation"), F.slice("embedding", 1, 4).cast("array<double>")).alias("values_vec"), F.lit(None).cast("map<string,double>").alias("values_num"))
    return q.select("vec_id", validate.signal_error().alias("error"))


_BOX = "case when size_w <= 0 then 'size_w <= 0' when size_l <= 0 then 'size_l <= 0' when abs(sqrt(rot_w * rot_w + rot_x * rot_x + rot_y * rot_y + rot_z * rot_z) - 1) > 0.001 then 'rotation is not a unit quaternion' end"
_SEG = "case when size_bytes <= 0 then 'size_bytes <= 0' when sample_count <= 0 then 'sample_count <= 0' when length(checksum) <> 64 then 'checksum is not 64 hex digits' when end_us < start_us then 't_end before t_start' end"


@query("validate_box", f"select l_orderkey, l_partkey, seq, center_x, {_BOX} error from perception")
def _(t):
    return t.perception().select("l_orderkey", "l_partkey", "seq", "center_x", validate.box_error().alias("error"))


@query("validate_segment", f"select o_orderkey, {_SEG} error from segments")
def _(t):
    return t.segments().select("o_orderkey", validate.segment_error().alias("error"))


@query("dlq_by_class", _ENVELOPE + """, c as (select case when x.err is not null then 'SCHEMA_VALIDATION_FAILURE' when not x.clip and x.event_id % 13 = 0 then 'PARSE_FAILURE' when not x.clip and e.value - 3 < 0 then 'BUSINESS_RULE_FAILURE' else 'ok' end cls from x join e using (event_id))
select cls error_class, count(*) n from c group by 1""")
def _(t):
    e = _envelopes(t).withColumn("routed", validate.route(F.col("kind")))
    s = e.join(t.signals_raw().where("dup = 0").select("event_id", "values_num", "values_vec"), "event_id")
    parsed = F.col("clip_reference") | (F.col("event_id") % 13 != 0)
    rule = F.when(~F.col("clip_reference"), validate.signal_error())
    cls = F.coalesce(validate.error_class(F.col("validation_error"), F.col("routed"), parsed, rule), F.lit("ok"))
    return s.groupBy(cls.alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


@query("odd_containment", f"select event_id, coalesce(lat between 42.335 and 42.337 and lon between -71.06 and -71.05, false) inside from signals")
def _(t):
    b = geo.parse_bounds("boston-seaport=42.335,42.337,-71.06,-71.05")["boston-seaport"]
    return t.signals().select("event_id", F.coalesce(F.col("lat").between(b[0], b[1]) & F.col("lon").between(b[2], b[3]), F.lit(False)).alias("inside"))


@query("liveness", "select event_id, case event_id % 3 when 0 then false when 1 then true else (k * 400 - 6000) >= -5000 and (k * 400 - 6000) < greatest(5000, 3 * 100 * k) end live from e")
def _(t):
    e = t.events()
    stream = F.when(F.col("event_id") % 3 == 0, "history").when(F.col("event_id") % 3 == 1, "legacy").otherwise("status")
    return e.select("event_id", validate.live(stream, F.lit(0), F.col("k") * 100, F.col("k") * 400 - 6000).alias("live"))


@query("live_filter", "select vehicle_id, count(*) n from signals where channel = 'ego_pose' group by 1")
def _(t):
    return t.signals().where("channel = 'ego_pose'").groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"))


# ---- dedup ----

# arrival order: each fifth record comes forty places later, and every ninth is sent again
_ARRIVALS = """, ar as (select vehicle_id, boot_id, seq, seq + case when seq % 5 = 0 then 40 else 0 end + 0.1 * (seq % 7) ord, 0 again from e union all select vehicle_id, boot_id, seq, seq + 25 + 0.01 * (seq % 7), 1 from e where seq % 9 = 0),
o as (select *, row_number() over (partition by vehicle_id order by ord, again, seq) ofs from ar),
fl as (select *, case when boot_id <> lag(boot_id) over (partition by vehicle_id order by ofs) then 1 else 0 end flip from o),
ru as (select *, sum(flip) over (partition by vehicle_id order by ofs rows unbounded preceding) run from fl),
pm as (select *, max(seq) over (partition by vehicle_id, run order by ofs rows between unbounded preceding and 1 preceding) pm, row_number() over (partition by vehicle_id, run, seq order by ofs) rn from ru),
ve as (select *, case when pm is null then case when run = 0 then 'ACCEPT' else 'BOOT_RESET' end when seq > pm then 'ACCEPT' when seq <= pm - 32 then 'TOO_OLD' when rn > 1 then 'DUPLICATE' else 'LATE' end verdict from pm)
"""


def _arrivals(t: Testbed) -> DataFrame:
    e = t.events().select("vehicle_id", "boot_id", "seq")
    a = e.withColumns({"ord": F.expr("seq + if(seq % 5 = 0, 40, 0) + 0.1 * (seq % 7)"), "again": F.lit(0)})
    b = e.where("seq % 9 = 0").withColumns({"ord": F.expr("seq + 25 + 0.01 * (seq % 7)"), "again": F.lit(1)})
    both = a.select("vehicle_id", "boot_id", "seq", F.col("ord").cast("double").alias("ord"), "again").unionByName(b.select("vehicle_id", "boot_id", "seq", F.col("ord").cast("double").alias("ord"), "again"))
    return both.withColumn("offset", F.row_number().over(W.partitionBy("vehicle_id").orderBy("ord", "again", "seq")).cast("long"))


def _judged(t: Testbed) -> DataFrame:
    return dedup.verdicts(_arrivals(t), key="vehicle_id", window=32)


@query("dedup_verdicts", _ARRIVALS + "select vehicle_id, ofs arrival, seq, verdict from ve")
def _(t):
    return _judged(t).select("vehicle_id", F.col("offset").alias("arrival"), "seq", "verdict")


@query("dedup_passed", _ARRIVALS + "select vehicle_id, count(*) n, count(distinct seq) seqs from ve where verdict in ('ACCEPT', 'LATE', 'BOOT_RESET') group by 1")
def _(t):
    return dedup.passed(_judged(t)).groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("seqs"))


@query("dedup_loss", _ARRIVALS + """, en as (select vehicle_id, run, arg_min(seq, ofs) fs, max(seq) la from ve group by 1, 2),
pa as (select distinct vehicle_id, run, seq from ve where verdict in ('ACCEPT', 'LATE', 'BOOT_RESET')),
bs as (select en.*, greatest(fs - 1, la - 32) base, (select count(*) from pa where pa.vehicle_id = en.vehicle_id and pa.run = en.run and seq between fs and la - 32) old from en),
ct as (select *, coalesce((select max(seq) from (select seq, row_number() over (order by seq) n from pa where pa.vehicle_id = bs.vehicle_id and pa.run = bs.run and pa.seq > base) where seq - base = n), base) contiguous from bs)
select vehicle_id, cast(run as bigint) run, fs first_seq, la last_seen, greatest(0, la - 32 - fs + 1) - old lost, contiguous, la - contiguous - (select count(*) from pa where pa.vehicle_id = ct.vehicle_id and pa.run = ct.run and seq > contiguous) pending_holes from ct""")
def _(t):
    return dedup.loss(_judged(t), key="vehicle_id", window=32).withColumn("run", F.col("run").cast("long"))


_ONE_ARRIVALS = """, ar as (select boot_id, event_id // 3 seq, event_id + case when event_id % 5 = 0 then 40 else 0 end ord, 0 again, event_id from e union all select boot_id, event_id // 3, event_id + 25, 1, event_id from e where event_id % 9 = 0),
o as (select event_id, again, event_id // 5000 boot, seq, (ord * 10 + again * 5) * 1000000 + event_id ofs from ar),
ru as (select *, sum(flip) over (order by ofs rows unbounded preceding) run from (select *, case when boot <> lag(boot) over (order by ofs) then 1 else 0 end flip from o)),
pm as (select *, max(seq) over (partition by run order by ofs rows between unbounded preceding and 1 preceding) pm, row_number() over (partition by run, seq order by ofs) rn from ru),
ve as (select *, case when pm is null then case when run = 0 then 'ACCEPT' else 'BOOT_RESET' end when seq > pm then 'ACCEPT' when seq <= pm - 32 then 'TOO_OLD' when rn > 1 then 'DUPLICATE' else 'LATE' end verdict from pm)
"""


def _one_judged(t: Testbed) -> DataFrame:
    """All events as the records of one sender, copies and late ones among them."""
    e = t.events().select(F.lit("fleet").alias("fleet"), "event_id", F.expr("event_id div 5000").alias("boot"), F.expr("event_id div 3").alias("seq"))
    sent = e.withColumns({"again": F.lit(0), "ord": F.expr("event_id + if(event_id % 5 = 0, 40, 0)")}).unionByName(e.where("event_id % 9 = 0").withColumns({"again": F.lit(1), "ord": F.expr("event_id + 25")}))
    arrived = sent.withColumn("offset", F.expr("cast((ord * 10 + again * 5) * 1000000 + event_id as bigint)"))
    return dedup.verdicts(arrived.drop("ord"), "fleet", "boot", window=32, ranges=RANGES)


@query("dedup_one_key", _ONE_ARRIVALS + "select event_id, again, cast(run as bigint) run, verdict from ve")
def _(t):
    return _one_judged(t).select("event_id", F.col("again").cast("int").alias("again"), F.col("run").cast("long").alias("run"), "verdict")


@query("loss_one_key", _ONE_ARRIVALS + """, en as (select run, arg_min(seq, ofs) fs, max(seq) la from ve group by 1), pa as (select distinct run, seq from ve where verdict in ('ACCEPT', 'LATE', 'BOOT_RESET')),
bs as (select en.*, greatest(fs - 1, la - 32) base, (select count(*) from pa where pa.run = en.run and seq between fs and la - 32) old from en),
ct as (select *, coalesce((select max(seq) from (select seq, row_number() over (order by seq) n from pa where pa.run = bs.run and pa.seq > base) where seq - base = n), base) contiguous from bs)
select cast(run as bigint) run, fs first_seq, la last_seen, greatest(0, la - 32 - fs + 1) - old lost, contiguous, la - contiguous - (select count(*) from pa where pa.run = ct.run and seq > contiguous) pending_holes from ct""")
def _(t):
    return dedup.loss(_one_judged(t), key="fleet", window=32, ranges=RANGES).drop("fleet").withColumn("run", F.col("run").cast("long"))


# ---- joins ----

_ASOF = """, pr as (select vehicle_id, event_id, t_us from e where channel = 'ego_pose'), sa as (select vehicle_id, event_id sid, t_us st from e where channel = 'pose'),
pv as (select pr.*, sa.st pst, sa.sid psid from pr asof left join sa on pr.vehicle_id = sa.vehicle_id and pr.t_us > sa.st),
nx as (select pv.*, sa.st nst, sa.sid nsid from pv asof left join sa on pv.vehicle_id = sa.vehicle_id and pv.t_us <= sa.st)
select event_id, case when psid is null then nsid when nsid is null then psid when t_us - pst <= nst - t_us then psid else nsid end sample_event from nx"""


@query("nearest_asof", _ASOF)
def _(t):
    e = t.events().select("vehicle_id", "channel", "event_id", "t_us")
    near = joins.nearest_asof(e.where("channel = 'ego_pose'"), e.where("channel = 'pose'"), ["vehicle_id"], "t_us", ["event_id"], "event_id")
    return near.select("event_id", F.col("sample.event_id").alias("sample_event"))


#: Ranges that the queries over one busy key cut it into.
RANGES = 64

_ONE_ASOF = """, pr as (select event_id, t_us from e where channel = 'ego_pose'), sa as (select t_us st, max(event_id) last, min(event_id) first from e where channel = 'pose' group by 1),
pv as (select pr.*, sa.st pst, sa.last psid from pr asof left join sa on pr.t_us > sa.st), nx as (select pv.*, sa.st nst, sa.first nsid from pv asof left join sa on pv.t_us <= sa.st)
select event_id, case when psid is null then nsid when nsid is null then psid when t_us - pst <= nst - t_us then psid else nsid end sample_event from nx"""


@query("asof_one_key", _ONE_ASOF)
def _(t):
    """The sample of the whole fleet that is nearest in time: one key holds all rows."""
    e = t.events().select(F.lit("fleet").alias("fleet"), "channel", "event_id", "t_us")
    near = joins.nearest_asof(e.where("channel = 'ego_pose'"), e.where("channel = 'pose'"), ["fleet"], "t_us", ["event_id"], "event_id", RANGES)
    return near.select("event_id", F.col("sample.event_id").alias("sample_event"))


def _overlap(t: Testbed) -> DataFrame:
    s = t.segments().where("state = 'UPLOADED'").select("vehicle_id", "segment_id", "start_us", "end_us")
    return joins.interval_overlap(s, t.requests(), ["vehicle_id"], 172_800_000_000, ("start_us", "end_us"), ("req_start", "req_end"))


_OVERLAP = ", ov as (select s.vehicle_id, segment_id, request_id, req_start, req_end, start_us, end_us from segments s join requests r on s.vehicle_id = r.vehicle_id and s.state = 'UPLOADED' and start_us < req_end and end_us > req_start and end_us > start_us)"


@query("interval_overlap", _OVERLAP + " select segment_id, request_id from ov")
def _(t):
    return _overlap(t).select("segment_id", "request_id")


_COVERED = _OVERLAP + """, cl as (select request_id, req_start, req_end, greatest(req_start, start_us) lo, least(req_end, end_us) hi from ov),
fr as (select *, case when lo <= max(hi) over (partition by request_id order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end f from cl),
isl as (select *, sum(f) over (partition by request_id order by lo, hi rows unbounded preceding) i from fr),
cv as (select request_id, req_start, req_end, min(lo) lo, max(hi) hi from isl group by request_id, req_start, req_end, i)
"""


@query("coverage", _COVERED + "select request_id, lo, hi from cv")
def _(t):
    return joins.coverage(_overlap(t), ["request_id"], "req_start", "req_end", "start_us", "end_us").select("request_id", "lo", "hi")


@query("coverage_missing", _COVERED + """, mk as (select request_id, req_start, req_end, lo, hi from cv union all select request_id, req_start, req_end, req_start, req_start from requests),
gp as (select request_id, hi gap_start, coalesce(lead(lo) over (partition by request_id order by hi), req_end) gap_end from mk) select * from gp where gap_start < gap_end""")
def _(t):
    covered = joins.coverage(_overlap(t), ["request_id"], "req_start", "req_end", "start_us", "end_us")
    return joins.missing(t.requests(), covered, ["request_id"], "req_start", "req_end")


_WHOLE = """, q as (select min(start_us) + 1 lo0, max(end_us) + 500 hi0 from segments), cl as (select lo0, hi0, greatest(lo0, start_us) lo, least(hi0, end_us) hi from segments, q where state = 'UPLOADED' and start_us < hi0 and end_us > lo0 and end_us > start_us),
fr as (select *, case when lo <= max(hi) over (order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end f from cl), isl as (select *, sum(f) over (order by lo, hi rows unbounded preceding) i from fr),
cv as (select lo0, hi0, min(lo) lo, max(hi) hi from isl group by lo0, hi0, i), mk as (select * from cv union all select lo0, hi0, lo0, lo0 from q), gp as (select lo0, hi0, hi gap_start, coalesce(lead(lo) over (order by hi, lo), hi0) gap_end from mk)
"""


@query("fleet_coverage", _WHOLE + "select 'covered' as kind, lo, hi from cv union all select 'missing', gap_start, gap_end from gp where gap_start < gap_end")
def _(t):
    """What all uploaded clips of the fleet cover together, and what they leave open: one request over all of them."""
    s = t.segments()
    request = s.agg((F.min("start_us") + 1).alias("lo0"), (F.max("end_us") + 500).alias("hi0")).withColumn("request_id", F.lit("fleet"))
    pairs = s.where("state = 'UPLOADED' and end_us > start_us").join(F.broadcast(request), F.expr("start_us < hi0 and end_us > lo0"))
    covered = cut(joins.coverage(pairs, ["request_id"], "lo0", "hi0", "start_us", "end_us", RANGES))
    gaps = joins.missing(request, covered, ["request_id"], "lo0", "hi0", RANGES)
    return covered.select(F.lit("covered").alias("kind"), "lo", "hi").union(gaps.select(F.lit("missing"), "gap_start", "gap_end"))


@query("semi_pinned", _OVERLAP + " select segment_id, size_bytes from segments where segment_id in (select segment_id from ov)")
def _(t):
    return t.segments().join(_overlap(t).select("segment_id"), "segment_id", "left_semi").select("segment_id", "size_bytes")


@query("anti_unpinned", _OVERLAP + " select segment_id, size_bytes from segments where segment_id not in (select segment_id from ov)")
def _(t):
    return t.segments().join(_overlap(t).select("segment_id"), "segment_id", "left_anti").select("segment_id", "size_bytes")


@query("ring_pending", "select r.event_id, r.t_us from signals r join (select event_id from e where event_id % 4 = 0) p on p.event_id = r.event_id order by r.event_id limit 128")
def _(t):
    pending = t.events().where("event_id % 4 = 0").select("event_id")
    return t.signals().join(pending, "event_id").orderBy("event_id").limit(128).select("event_id", "t_us")


@query("seq_gaps", ", d as (select distinct vehicle_id, seq from signals), g as (select *, lead(seq) over (partition by vehicle_id order by seq) nx from d) select vehicle_id, seq + 1 gap_start, nx - 1 gap_end, nx - seq - 1 n_missing from g where nx > seq + 1")
def _(t):
    return joins.seq_gaps(t.signals(), ["vehicle_id"])


@query("seq_report", "select vehicle_id, count(*) n, min(seq) lo, max(seq) hi, max(seq) - min(seq) + 1 - count(distinct seq) missing, count(*) - count(distinct seq) duplicates from signals_raw group by 1")
def _(t):
    s = t.signals_raw().groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.countDistinct("seq").alias("d"))
    return s.select("vehicle_id", "n", "lo", "hi", F.expr("hi - lo + 1 - d").alias("missing"), F.expr("n - d").alias("duplicates"))


@query("odd_bounds_lookup", "select channel, count(*) filter (location in ('boston-seaport', 'singapore-onenorth')) found, count(*) filter (location not in ('boston-seaport', 'singapore-onenorth')) missing from signals group by 1")
def _(t):
    bounds = t.spark.createDataFrame([("boston-seaport", 42.0), ("singapore-onenorth", 1.0)], "location string, low double")  # configuration: a row a place
    s = t.signals().join(F.broadcast(bounds), "location", "left")
    return s.groupBy("channel").agg(F.count("low").alias("found"), F.count(F.when(F.col("low").isNull(), 1)).alias("missing"))


@query("manifest_reconcile", """, a as (select scene_id, count(*) n from perception group by 1), b as (select scene_id, count(*) n from segments group by 1)
select coalesce(a.scene_id, b.scene_id) scene_id, coalesce(a.n, 0) boxes, coalesce(b.n, 0) recordings, coalesce(a.n, 0) = coalesce(b.n, 0) same from a full join b on a.scene_id = b.scene_id""")
def _(t):
    a, b = (x.groupBy("scene_id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((t.perception(), "boxes"), (t.segments(), "recordings")))
    j = a.join(b, "scene_id", "full").select("scene_id", F.coalesce("boxes", F.lit(0)).alias("boxes"), F.coalesce("recordings", F.lit(0)).alias("recordings"))
    return j.withColumn("same", F.col("boxes") == F.col("recordings"))


# ---- windows, profiles ----


@query("tumbling_100ms", "select vehicle_id, cast(floor((t_us - 1705000000000000) / 3600000000.0) as bigint) * 3600000000 w, count(*) n from signals group by 1, 2")
def _(t):
    return t.signals().groupBy("vehicle_id", sequences.tumbling(F.col("t_us") - 1_705_000_000_000_000, 3_600_000_000).alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query("last_n_trail", "select vehicle_id, event_id from signals where lat is not null qualify row_number() over (partition by vehicle_id order by t_us desc, event_id desc) <= 20")
def _(t):
    return sequences.last_n(t.signals().where("lat is not null"), ["vehicle_id"], [F.desc("t_us"), F.desc("event_id")], 20).select("vehicle_id", "event_id")


@query("harsh_brake", "select vehicle_id, event_id from signals where channel = 'pose' and abs(value / 10 - 3) > 3.0")
def _(t):
    return sequences.harsh_brakes(t.signals()).select("vehicle_id", "event_id")


@query("keyframe_interval", ", k as (select distinct scene_id, t_us from perception) select scene_id, t_us, t_us - lag(t_us) over (partition by scene_id order by t_us) gap_us from k")
def _(t):
    k = t.perception().select("scene_id", us("sensor_time").alias("t_us")).distinct()
    return k.withColumn("gap_us", F.col("t_us") - F.lag("t_us").over(W.partitionBy("scene_id").orderBy("t_us")))


@query("channel_profile", f"select channel, count(*) n, {sql6('count(*) / 1000.0')} hz, 'mission_active,planned_stop,sensor_healthy,speed,vehicle_speed' keys from signals group by 1")
def _(t):
    return aggregates.channel_profile(t.signals(), 1000.0).select("channel", "n", "hz", F.array_join("keys", ",").alias("keys"))


@query("scene_profile", f", d as (select scene_id, (max(t_us) - min(t_us)) / 1e6 s from signals group by 1) select count(*) n, {sql6('min(s)')} lo, {sql6('max(s)')} hi, floor(avg(s) + 0.5) mean from d")
def _(t):
    d = t.signals().groupBy("scene_id").agg(((F.max("t_us") - F.min("t_us")) / 1e6).alias("s"))
    return d.agg(F.count(F.lit(1)).alias("n"), cut6(F.min("s")).alias("lo"), cut6(F.max("s")).alias("hi"), F.floor(F.avg("s") + 0.5).cast("double").alias("mean"))


@query("perception_profile", f", k as (select sample_id, count(*) n, count(*) filter (num_lidar_pts = 0) z from perception group by 1) select {sql6('avg(n)')} mean, min(n) lo, max(n) hi, {sql6('sum(z) / sum(n)')} zero_lidar from k")
def _(t):
    k = t.perception().groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("num_lidar_pts") == 0, 1)).alias("z"))
    return k.agg(cut6(F.avg("n")).alias("mean"), F.min("n").alias("lo"), F.max("n").alias("hi"), cut6(F.sum("z") / F.sum("n")).alias("zero_lidar"))


@query("raw_profile", "select scene_id, count(*) n, cast(sum(size_bytes) as bigint) bytes, count(*) filter (state = 'UPLOADED') stored, cast(coalesce(sum(size_bytes) filter (state = 'UPLOADED'), 0) as bigint) stored_bytes from segments group by 1")
def _(t):
    up = F.col("state") == "UPLOADED"
    return t.segments().groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.count(F.when(up, 1)).alias("stored"), F.coalesce(F.sum(F.when(up, F.col("size_bytes"))), F.lit(0)).alias("stored_bytes"))


@query("clip_summary", f"select scene_id, count(*) n, {sql6('avg(lat)')} lat, {sql6('min(lat)')} lat_lo, {sql6('max(lat)')} lat_hi, {sql6('min(lon)')} lon_lo, {sql6('max(lon)')} lon_hi from signals where lat is not null group by 1")
def _(t):
    s = t.signals().where("lat is not null").groupBy("scene_id")
    return s.agg(F.count(F.lit(1)).alias("n"), cut6(F.avg("lat")).alias("lat"), cut6(F.min("lat")).alias("lat_lo"), cut6(F.max("lat")).alias("lat_hi"), cut6(F.min("lon")).alias("lon_lo"), cut6(F.max("lon")).alias("lon_hi"))


_RULES_SQL = {k: v.replace(r"(?<!after\s)\brain(ing|y)?\b", r"\brain(ing|y)?\b") for k, v in text.TAG_RULES.items()}
_DESC = "concat(if(k % 3 = 0, 'Night, ', ''), if(k % 4 = 0, 'after rain, ', ''), if(k % 5 = 0, 'heavy rain; ', ''), if(k % 7 = 0, 'Peds crossing, turn at Intersection', 'parked truck, bus stop'), if(k % 11 = 0, ', bicycles, glare', ''))"
_DESC_SQL = "concat(case when k % 3 = 0 then 'Night, ' else '' end, case when k % 4 = 0 then 'after rain, ' else '' end, case when k % 5 = 0 then 'heavy rain; ' else '' end, case when k % 7 = 0 then 'Peds crossing, turn at Intersection' else 'parked truck, bus stop' end, case when k % 11 = 0 then ', bicycles, glare' else '' end)"


def _rule_sql(tag: str, rule: str) -> str:
    subject = "regexp_replace(d, '(?i)after\\s+rain', '', 'g')" if tag == "rain" else "d"
    return f"case when regexp_matches({subject}, '(?i){rule}') then '{tag}' end"


@query("tag_rules", f", x as (select event_id, {_DESC_SQL} d from e) select event_id, array_to_string(list_sort(list_filter([{', '.join(_rule_sql(k, v) for k, v in _RULES_SQL.items())}, case when not regexp_matches(d, '(?i)\\bnight\\b') then 'day_inferred' end], lambda z: z is not null)), ',') tags from x")
def _(t):
    return t.events().selectExpr("event_id", f"{_DESC} as d").select("event_id", F.array_join(text.tags(F.col("d")), ",").alias("tags"))


@query("tag_histogram", f", x as (select trim(unnest(string_split(replace(lower({_DESC_SQL}), ';', ','), ','))) tag from e) select tag, count(*) n from x where tag <> '' group by 1")
def _(t):
    return aggregates.tag_histogram(t.events().selectExpr(f"{_DESC} as d"), "d")


@query("tag_conjunction", "select count(*) n from e where k % 3 = 0 and k % 7 <> 0")
def _(t):
    return t.events().selectExpr(f"{_DESC} as d").where(validate.has_tags(text.tags(F.col("d")), ["night", "truck"])).agg(F.count(F.lit(1)).alias("n"))


@query("percentile_nearest", "select vehicle_id, quantile_disc(value, 0.95) p from signals group by 1")
def _(t):
    return t.signals().groupBy("vehicle_id").agg(aggregates.percentile_nearest("value", 0.95).alias("p"))


@query("percentile_floor", ", r as (select vehicle_id, value, row_number() over (partition by vehicle_id order by value) - 1 i, count(*) over (partition by vehicle_id) n from signals) select vehicle_id, value from r where i = least(cast(floor(n * 0.95::double) as bigint), n - 1)")
def _(t):
    return aggregates.percentile_floor(t.signals(), "value", 0.95, ["vehicle_id"])


@query("category_topk", "select category, count(*) n from perception group by 1 order by n desc, category limit 3")
def _(t):
    return aggregates.top_values(t.perception(), "category", 3)


@query("channel_distribution", f"select channel, count(*) n, {sql6('100.0 * count(*) / sum(count(*)) over ()')} pct from signals group by 1")
def _(t):
    return aggregates.distribution(t.signals(), "channel")


@query("storage_usage", "select state, count(*) n, cast(coalesce(sum(size_bytes), 0) as bigint) bytes from segments group by 1")
def _(t):
    return t.segments().groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("throughput", "select t_us // 1000000 s, count(*) n from signals group by 1")
def _(t):
    return t.signals().groupBy(F.floor(F.col("t_us") / F.lit(1_000_000)).alias("s")).agg(F.count(F.lit(1)).alias("n"))


# ---- text, hashes ----


@query("object_key", "select o_orderkey, 'clips/vehicle_id=' || vehicle_id || '/date=' || strftime(make_timestamp(start_us), '%Y-%m-%d') || '/' || segment_id || '.mcap' key from segments")
def _(t):
    return t.segments().select("o_orderkey", text.object_key("clips", F.col("vehicle_id"), F.col("t_start"), F.col("segment_id")).alias("key"))


@query("utc_text", "select event_id, strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S.%f') t from e")
def _(t):
    return t.events().select("event_id", text.utc_text(F.timestamp_micros("t_us")).alias("t"))


@query("frame_digest", "select event_id, sha256('FSMQ' || chr(2) || vehicle_id || ':' || seq) digest from e")
def _(t):
    return t.events().select("event_id", text.frame_digest(F.encode(F.concat_ws(":", "vehicle_id", "seq"), "UTF-8"), b"FSMQ\x02").alias("digest"))


@query("event_ids", "select event_id, vehicle_id || ':ODD_EXITED:' || boot_id || ':' || seq id from e")
def _(t):
    return t.events().select("event_id", text.event_id(F.col("vehicle_id"), F.lit("ODD_EXITED"), F.col("boot_id"), F.col("seq")).alias("id"))


@query("retry_backoff", "select event_id, least(300, 2 << least(k, 7)) s, 1 + (value * 1000)::bigint // 64 parts from e")
def _(t):
    size = F.floor(F.col("value") * 1000 + 0.5).cast("long")
    return t.events().select("event_id", text.retry_backoff_s(F.col("k")).alias("s"), text.part_count(size + 1, F.lit(64)).alias("parts"))


@query("uuid5_boot")
def _(t):
    return t.events().select("event_id", text.uuid5(F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), F.concat_ws("/", "vehicle_id", "boot_id")).alias("uuid"))


@query("crc_frames")
def _(t):
    return t.events().select("event_id", F.crc32(F.encode(F.concat_ws(":", "vehicle_id", "seq"), "UTF-8")).alias("crc"))


@query("raw_topics", "select segment_id, case when o_orderkey % 2 = 0 then '/camera/CAM_FRONT' else '/lidar/LIDAR_TOP' end topic, case when o_orderkey % 4 = 0 then 'jpeg' else 'application/octet-stream' end encoding from segments")
def _(t):
    s = t.segments().withColumn("p", text.raw_topic(F.when(F.col("o_orderkey") % 2 == 0, "CAM_FRONT").otherwise("LIDAR_TOP"), F.when(F.col("o_orderkey") % 4 == 0, ".jpg").otherwise(".bin")))
    return s.select("segment_id", "p.topic", "p.encoding")


# ---- detectors, batch forms ----

_BOUNDS = {"boston-seaport": (42.335, 42.338, -71.06, -71.055), "singapore-onenorth": (1.286, 1.289, 103.783, 103.785)}
_INSIDE = "case location when 'boston-seaport' then lat between 42.335 and 42.338 and lon between -71.06 and -71.055 when 'singapore-onenorth' then lat between 1.286 and 1.289 and lon between 103.783 and 103.785 end"


_ODD_ROWS = f""", u as (select vehicle_id, event_id, boot_id, seq, t_us // 1000 ms, location, not ({_INSIDE}) outside from e join (select event_id, lat, lon from signals_raw where dup = 0) using (event_id) where location in ('boston-seaport', 'singapore-onenorth') and lat is not null),
m as (select *, max(ms) over (partition by vehicle_id order by event_id rows between unbounded preceding and 1 preceding) most from u), t as (select * from m where most is null or ms > most),
w as (select *, case when lag(location) over (partition by vehicle_id order by event_id) = location then lag(outside) over (partition by vehicle_id order by event_id) end was from t)"""


@query("odd_transitions", f"""{_ODD_ROWS}
select vehicle_id, event_id, case when outside and not coalesce(was, false) then 'ODD_EXITED' else 'ODD_RETURNED' end as type from w where (outside and not coalesce(was, false)) or (not outside and was)""")
def _(t):
    poses = t.signals_raw().where("dup = 0").withColumn("event_ms", F.floor(F.col("t_us") / 1000).cast("long"))
    return sequences.odd_transitions(poses, _BOUNDS).select("vehicle_id", "event_id", "type")


_STATUS = ", st as (select vehicle_id, event_id, t_us // 1000 ms, k // 50 mission, k % 3 <> 0 and k % 4 <> 0 and value <= 20 stopped, case when k % 5 <> 0 then 1 else 0 end healthy from e)"
_GAP, _LEAST = 4 * 3_600_000, 3_600_000


def _status(t: Testbed) -> DataFrame:
    return t.events().selectExpr(
        "vehicle_id", "event_id", "event_id as offset", "floor(t_us / 1000) as event_ms", "floor(t_us / 1000) as received_ms", "cast(k div 50 as string) as mission_id",
        "if(k % 3 <> 0, 1D, 0D) as mission_active", "if(k % 4 = 0, 1D, 0D) as planned_stop", "if(value <= 20, 0D, value) as speed", "if(k % 5 <> 0, 1D, 0D) as sensor_healthy",
    )


@query("stop_runs", _STATUS + f""", m as (select *, max(ms) over (partition by vehicle_id order by event_id rows between unbounded preceding and 1 preceding) most from st), t as (select * from m where most is null or ms > most),
g as (select *, case when stopped and ms - lag(ms) over w <= {_GAP} and lag(mission) over w = mission and lag(stopped) over w then 0 else 1 end nw from t window w as (partition by vehicle_id order by event_id)),
r as (select *, sum(nw) over (partition by vehicle_id order by event_id rows unbounded preceding) run from g), s as (select *, min(ms) over (partition by vehicle_id, run) since from r where stopped)
select vehicle_id, since since_ms, max(ms) until_ms, count(*) n, min(ms) filter (ms - since >= {_LEAST}) reported_ms from s group by vehicle_id, run, since""")
def _(t):
    return sequences.stop_runs(_status(t), gap_ms=_GAP, least_ms=_LEAST)


@query("sensor_edges", _STATUS + ", l as (select *, lag(healthy) over (partition by vehicle_id order by event_id) p from st) select vehicle_id, event_id, case when healthy = 0 then 'SENSOR_FAULT' else 'SENSOR_RECOVERED' end as type from l where (healthy = 0 and (p is null or p <> 0)) or (healthy = 1 and p = 0)")
def _(t):
    return sequences.sensor_edges(_status(t)).select("vehicle_id", "event_id", "type")


@query("stale_deadlines", _STATUS + f", l as (select vehicle_id, event_id, ms + {_GAP} stale_ms, lead(ms) over (partition by vehicle_id order by ms, event_id) recovered_ms from st) select * from l where recovered_ms is null or recovered_ms >= stale_ms")
def _(t):
    return sequences.stale_deadlines(_status(t), stale_ms=_GAP).select("vehicle_id", "event_id", "stale_ms", "recovered_ms")


@query("active_alerts", """, al as (select vehicle_id, vehicle_id || ':' || (event_id // 3 * 3 % 977) id, event_id,
  ['ODD_EXITED', 'ODD_RETURNED', 'UNPLANNED_STOP', 'STOP_CLEARED', 'SENSOR_FAULT', 'SENSOR_RECOVERED', 'TELEMETRY_STALE', 'TELEMETRY_RECOVERED'][k % 8 + 1] typ from e),
fa as (select * from al qualify row_number() over (partition by id order by event_id) = 1),
g as (select vehicle_id, case when typ like 'ODD%' then 'odd' when typ in ('UNPLANNED_STOP', 'STOP_CLEARED') then 'stop' when typ like 'SENSOR%' then 'sensor' else 'stale' end family, typ in ('ODD_EXITED', 'UNPLANNED_STOP', 'SENSOR_FAULT', 'TELEMETRY_STALE') opens, event_id from fa)
select vehicle_id, family from g group by 1, 2 having arg_max(opens, event_id)""")
def _(t):
    kinds = "array('ODD_EXITED', 'ODD_RETURNED', 'UNPLANNED_STOP', 'STOP_CLEARED', 'SENSOR_FAULT', 'SENSOR_RECOVERED', 'TELEMETRY_STALE', 'TELEMETRY_RECOVERED')"
    a = t.events().selectExpr("vehicle_id", "concat(vehicle_id, ':', (event_id div 3) * 3 % 977) as event_id", f"{kinds}[k % 8] as type", "event_id as offset")
    return sequences.active_alerts(a)


@query("ring_budget", ", p as (select vehicle_id, event_id, t_us, k + 1 size, event_id % 10 = 0 pin from e), q as (select *, coalesce(sum(size) filter (pin) over (partition by vehicle_id), 0) + coalesce(sum(case when pin then 0 else size end) over (partition by vehicle_id order by t_us desc, event_id desc rows unbounded preceding), 0) used from p) select vehicle_id, event_id from q where pin or used <= 2000")
def _(t):
    e = t.events().selectExpr("vehicle_id", "event_id", "t_us", "cast(k + 1 as bigint) as size", "event_id % 10 = 0 as pin")
    return sequences.ring_budget(e, ["vehicle_id"], [F.desc("t_us"), F.desc("event_id")], "size", 2000, "pin").select("vehicle_id", "event_id")


@query("ring_one_key", ", p as (select event_id, t_us, k + 1 size, event_id % 10 = 0 pin from e), q as (select *, coalesce((select sum(size) from p where pin), 0) + coalesce(sum(case when pin then 0 else size end) over (order by t_us desc, event_id desc rows unbounded preceding), 0) used, sum(size) over () whole from p) select event_id from q where pin or used <= whole // 2")
def _(t):
    """One ring for the whole fleet, which keeps half of what it was given."""
    e = t.events().selectExpr("'fleet' as fleet", "event_id", "t_us", "cast(k + 1 as bigint) as size", "event_id % 10 = 0 as pin")
    half = e.agg(F.sum("size")).first()[0] // 2
    return sequences.ring_budget(e, ["fleet"], ["t_us", "event_id"], "size", half, "pin", RANGES).select("event_id")


@query("cumulative_ack", ", d as (select distinct vehicle_id, seq from e where seq <> 40), n as (select *, row_number() over (partition by vehicle_id order by seq) - 1 i from d) select vehicle_id, coalesce(max(seq) filter (seq = i), -1) ack from n group by 1")
def _(t):
    return sequences.contiguous_ack(t.events().where("seq <> 40"), ["vehicle_id"])


# ---- state machines over tables ----


@query("stream_dedup", _ARRIVALS + "select vehicle_id, seq, verdict, count(*) n from ve group by all")
def _(t):
    judged = over_table(_arrivals(t), machines.SequenceWindow, "vehicle_id", ["offset"], window=32)
    return judged.groupBy("vehicle_id", "seq", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("stream_odd")
def _(t):
    poses = t.signals_raw().where("dup = 0").select("vehicle_id", "boot_id", "seq", F.floor(F.col("t_us") / 1000).alias("event_ms"), F.floor(F.col("t_us") / 1000).alias("received_ms"), "location", "lat", "lon", "offset")
    return over_table(poses, machines.AreaMonitor, "vehicle_id", ["offset"], bounds=_BOUNDS, stale_ms=10**12, sustained_ms=10**9)


@query("stream_monitor")
def _(t):
    status = _status(t).withColumn("boot_id", F.lit("b0")).withColumn("seq", F.col("event_id"))
    return over_table(status, machines.VehicleMonitor, "vehicle_id", ["offset"], stop_ms=_LEAST, stale_ms=_GAP)


@query("sampling_policy")
def _(t):
    rows = t.signals_raw().where("dup = 0").select("vehicle_id", "channel", F.floor(F.col("t_us") / 1000).alias("received_ms"), F.col("t_us").alias("event_us"), "values_num", "values_str", (F.col("k") == 0).alias("anomaly"), "offset")
    return over_table(rows, machines.SamplingPolicy, "vehicle_id", ["offset"], normal_ms=60_000, thresholds={"speed": 20.0})


@query("debounce")
def _(t):
    rows = t.events().selectExpr("user_id % 8 as shard", "concat('e', event_id) as id", "floor(t_us / 1000) as t", "vehicle_id", "channel as kind")
    return over_table(rows, machines.Debounce, "shard", ["t", "id"], window_ms=3_600_000)


@query("segment_rotation")
def _(t):
    rows = t.events().selectExpr("vehicle_id as key", "floor(t_us / 1000) as t", "cast(k as bigint) as size")
    return over_table(rows, machines.GreedyCut, "key", ["t", "size"], span=86_400_000, budget=500)


@query("ack_stream")
def _(t):
    rows = t.events().selectExpr("vehicle_id as key", "seq", "floor(t_us / 1000) as at_ms")
    return over_table(rows, machines.AckTracker, "key", ["at_ms", "seq"], every=16, every_ms=10**12)


@query("avro_decode", "select event_id, channel, t_us, value from e")
def _(t):
    def coded(vehicle: pd.Series, channel: pd.Series, t_us: pd.Series, value: pd.Series) -> pd.Series:
        rows = zip(vehicle, channel, t_us, value)
        return pd.Series([avro.encode({"record": avro.SIGNAL}, {"scene_id": v, "channel": c, "sensor_time": int(u), "log_time": int(u), "values_num": {"speed": float(x)}, "values_vec": {}, "values_str": {}}) for v, c, u, x in rows])

    e = t.events().withColumn("payload", F.pandas_udf(coded, "binary")("vehicle_id", "channel", "t_us", "value"))
    d = avro.decode_signals(e.select("event_id", "payload"), "payload")
    return d.select("event_id", "signal.channel", us("signal.sensor_time").alias("t_us"), F.try_element_at(F.col("signal.values_num"), F.lit("speed")).alias("value"))


# ---- marks, counters, upload jobs ----

_SENSORS = ["ego_pose", "pose", "fleet_status", "steeranglefeedback"]
_BITS = " + ".join(f"case when bool_or(channel = '{c}') then {1 << i} else 0 end" for i, c in enumerate(_SENSORS))


@query("sensor_completeness", f", m as (select vehicle_id, scene_id, t_us // 3600000000 as hour, {_BITS} as s from e group by all) select vehicle_id, scene_id, hour, s::bigint sensors, (7 & ~s)::bigint wanting, 7 & ~s = 0 complete from m")
def _(t):
    """Which of its sensors a vehicle's frame of an hour holds, and which of the required ones it wants."""
    frames = t.events().withColumn("hour", F.expr("t_us div 3600000000"))
    return marks.sensor_mask(frames, ["vehicle_id", "scene_id", "hour"], "channel", _SENSORS, _SENSORS[:3])


@query("time_runs_back", ", a as (select *, (event_id * 7919) % 1000 + event_id ord from e), m as (select vehicle_id, event_id, t_us, max(t_us) over (partition by vehicle_id order by ord, event_id rows between unbounded preceding and 1 preceding) most from a) select vehicle_id, event_id, most - t_us behind from m where most > t_us")
def _(t):
    arrived = t.events().selectExpr("vehicle_id", "event_id", "t_us", "(event_id * 7919) % 1000 + event_id as ord")
    return marks.backward_time(arrived, "vehicle_id", "t_us", ["ord", "event_id"]).where("behind is not null").select("vehicle_id", "event_id", "behind")


@query("usage_counters", ", s as (select vehicle_id, channel, k + 1 size, t_us from e) select vehicle_id, channel, count(*) n, sum(size)::bigint size, min(t_us) first, max(t_us) as last from s group by 1, 2")
def _(t):
    """Counters from the deltas of thirteen batches; equal to the sums over everything."""
    e = t.events().withColumn("batch", F.expr("event_id % 13"))
    added = marks.deltas(e, ["batch", "vehicle_id", "channel"], "t_us", (F.col("k") + 1).cast("long"))
    return marks.merged(added, ["vehicle_id", "channel"])


_UPLOADS = """, uj as (select event_id // 9 as job_id, event_id as ofs, ['REQUESTED', 'LEASED', 'UPLOADING', 'UPLOADING', 'UPLOADED', 'REQUESTED', 'FAILED', 'EXPIRED', 'CANCELLED'][1 + cast((event_id % 9 + (event_id // 9) % 3 * (event_id % 2)) % 9 as int)] as state, (event_id % 9) // 3 + case when (event_id // 9) % 4 = 0 and event_id % 9 = 4 then -1 else 0 end as token from e),
uf as (select *, coalesce(token < max(token) over (partition by job_id order by ofs rows between unbounded preceding and 1 preceding), false) fenced from uj),
ub as (select *, coalesce(last_value(case when not fenced then state end ignore nulls) over (partition by job_id order by ofs rows between unbounded preceding and 1 preceding), '') as before from uf),
ul as (select *, case when not fenced then before || '>' || state in (""" + ", ".join(f"'{a}>{b}'" for a, after in marks.STEPS.items() for b in after) + """) end legal from ub)
"""


def _uploads(t: Testbed) -> DataFrame:
    """Nine events a job, some of them out of turn, some of a worker whose lease is over."""
    names = "array('REQUESTED', 'LEASED', 'UPLOADING', 'UPLOADING', 'UPLOADED', 'REQUESTED', 'FAILED', 'EXPIRED', 'CANCELLED')"
    return t.events().selectExpr(
        "event_id div 9 as job_id", "event_id as offset", f"element_at({names}, 1 + cast((event_id % 9 + (event_id div 9) % 3 * (event_id % 2)) % 9 as int)) as state",
        "(event_id % 9) div 3 + case when (event_id div 9) % 4 = 0 and event_id % 9 = 4 then -1 else 0 end as token",
    )


@query("upload_steps", _UPLOADS + "select job_id, ofs as arrival, state, before, legal, fenced from ul")
def _(t):
    return marks.upload_log(_uploads(t)).select("job_id", F.col("offset").alias("arrival"), "state", "before", "legal", "fenced")


@query("upload_states", _UPLOADS + "select job_id, arg_max(state, ofs) filter (not fenced) state, max(token) token, count(*) filter (legal = false) illegal, count(*) filter (fenced) fenced from ul group by 1")
def _(t):
    return marks.upload_states(marks.upload_log(_uploads(t)))
