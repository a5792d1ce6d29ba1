"""Queries of scenes, recordings, projections and whole profiles, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import aggregates, latest, scenes, validate
from ..operators.latest import final_view
from ..sources import files, mcap
from .catalog import _FROM, _R4, _XY, _origin_sql
from .registry import cut6, query, sql6, us
from .testbed import Testbed

# ---- scenes ----


def _chain(t: Testbed) -> DataFrame:
    """Every vehicle's events as a chain of tokens."""
    by = W.partitionBy("user_id").orderBy("t_us", "event_id")
    return t.events().select("user_id", "vehicle_id", "event_id", "t_us", F.concat(F.lit("t"), "event_id").alias("token"), F.concat(F.lit("t"), F.lead("event_id").over(by)).alias("next"), (F.row_number().over(by) - 1).cast("long").alias("n"))


@query("linked_walk", ", w as (select vehicle_id, event_id, row_number() over (partition by user_id order by t_us, event_id) - 1 n, count(*) over (partition by user_id) c from e) select vehicle_id, event_id, c - 1 - n to_end, 't' || last_value(event_id) over (partition by vehicle_id order by n rows between unbounded preceding and unbounded following) chain_end from w")
def _(t: Testbed):
    return scenes.walked(_chain(t)).select("vehicle_id", "event_id", "to_end", "chain_end")


@query("scene_samples", ", w as (select vehicle_id, user_id, event_id, t_us, row_number() over (partition by user_id order by t_us, event_id) - 1 n, min(t_us) over (partition by user_id) + 400000000000 stop from e) select 'sc' || user_id scene_id, event_id, n - 2 pos from w where n >= 2 and t_us <= stop")
def _(t):
    walk = scenes.walked(_chain(t))
    first = walk.where("n = 2").select(F.concat(F.lit("sc"), "user_id").alias("scene_id"), F.col("token").alias("first"), "user_id")
    ends = walk.groupBy("user_id").agg((F.min("t_us") + 400_000_000_000).alias("end_time"))
    rows = scenes.until(walk, first.join(ends, "user_id").drop("user_id"), "first", "end_time", "t_us")
    return rows.select("scene_id", "event_id", F.col("at").alias("pos"))


@query("native_channels", """select scene_id, channel, t_us, '{"value":' || k || '}' as "values" from e where channel in ('ego_pose', 'ms_imu', 'steeranglefeedback', 'pose')""")
def _(t):
    e = t.events().withColumn("values", F.to_json(F.struct(F.col("k").alias("value"))))
    channels = {c: e.where(F.col("channel") == c) for c in ("ms_imu", "steeranglefeedback", "pose")}  # three of six are recorded
    return scenes.native_channels(channels, e.where("channel = 'ego_pose'"), e.select("scene_id").distinct())


@query("joined_signal", f"""select event_id, case when k % 5 <> 0 then {sql6('sqrt(value * value + k * k)')} end speed_mps, case when k % 4 <> 0 then {sql6('value / 10')} end accel_x, case when k % 4 <> 0 then 9.81::double end accel_z,
 case when k % 3 <> 0 then k / 100.0::double end yaw_rate, case when k % 7 <> 0 then value end steering_rad from e""")
def _(t):
    d = t.events().selectExpr(
        "event_id", "named_struct('vel', if(k % 5 = 0, cast(array() as array<double>), array(value, cast(k as double), 0D)), 'accel', if(k % 4 = 0, array(1D, 2D), array(value / 10, 0D, 9.81D))) as pose",
        "named_struct('rotation_rate', if(k % 3 = 0, array(1D), array(0D, 0D, k / 100D))) as imu", "if(k % 7 = 0, null, named_struct('value', value)) as steer",
    )
    j = scenes.joined_signal("pose", "imu", "steer")
    return d.select("event_id", cut6(j["speed_mps"]).alias("speed_mps"), cut6(j["accel_x"]).alias("accel_x"), j["accel_z"].alias("accel_z"), j["yaw_rate"].alias("yaw_rate"), j["steering_rad"].alias("steering_rad"))


@query("keyframe_files", "select segment_id, case when o_orderkey % 5 <> 0 then 'a' || (o_orderkey % 5) end attribute from segments where o_orderkey % 6 = 0")
def _(t):
    s = t.segments().withColumn("is_key_frame", F.col("o_orderkey") % 6 == 0)
    names = F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), F.col("o_orderkey") % 5), F.lit("other")))
    return scenes.keyframes_only(s, False).select("segment_id", scenes.first_attribute(names).alias("attribute"))


# ---- recordings ----


def _recordings(t: Testbed) -> DataFrame:
    rows = t.events().select(
        "vehicle_id", F.concat_ws("/", F.lit(""), "vehicle_id", "channel").alias("topic"), F.lit("json").alias("encoding"), F.col("seq").alias("sequence"), (F.col("t_us") * 1000).alias("log_time"), F.encode(F.to_json(F.struct("event_id", "k")), "UTF-8").alias("data")
    )
    return mcap.write_segments(rows, "vehicle_id", 4096)


@query("recording_manifest", "select vehicle_id segment, count(*) n_messages, count(distinct channel) n_channels, min(t_us) * 1000 as first, max(t_us) * 1000 as last from e group by 1")
def _(t):
    return _recordings(t).select("segment", "n_messages", "n_channels", "first", "last")


@query("recording_topics", "select '/' || vehicle_id || '/' || channel topic, count(*) n, min(t_us) * 1000 lo, max(t_us) * 1000 hi from e group by 1")
def _(t):
    read = mcap.read_contents(_recordings(t).select(F.col("segment").alias("path"), "content"))
    return read.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("log_time").alias("lo"), F.max("log_time").alias("hi"))


@query("recording_window", "select vehicle_id, seq, event_id, k from e where channel in ('pose', 'ego_pose') and t_us >= 1705000000000000 and t_us < 1705900000000000")
def _(t):
    files = _recordings(t).select(F.col("segment").alias("path"), "content")
    got = mcap.read_contents(files, lambda s: {f"/{s}/pose", f"/{s}/ego_pose"}, 1_705_000_000_000_000_000, 1_705_900_000_000_000_000)
    d = F.from_json(F.decode("data", "UTF-8"), "event_id long, k int").alias("d")
    return got.select(F.col("path").alias("vehicle_id"), F.col("sequence").alias("seq"), d).select("vehicle_id", "seq", "d.event_id", "d.k")


# ---- projections ----


@query("signal_json", """select event_id, 'boston-seaport' = location as boston, case when k % 6 = 0 then 'overridden' else '' || cast(value as varchar) end speed, k y, epoch_ms, shown from
 (select *, t_us // 1000 epoch_ms, case when lat is not null and lon is not null then 1 else 0 end shown from signals) s""")
def _(t):
    s = t.signals().withColumn("values_str", F.when(F.col("k") % 6 == 0, F.map_concat("values_str", F.create_map(F.lit("speed"), F.lit("overridden")))).otherwise(F.col("values_str")))
    j = s.withColumn("json", aggregates.signal_json())
    of = lambda path: F.get_json_object("json", path)
    speed = F.when(F.col("k") % 6 == 0, of("$.values.speed")).otherwise(of("$.values.speed").cast("double").cast("string"))
    return j.select("event_id", (of("$.values.location") == "boston-seaport").alias("boston"), speed.alias("speed"), of("$.values.translation[1]").cast("double").cast("int").alias("y"), of("$.t").cast("long").alias("epoch_ms"), of("$.values.lat").isNotNull().cast("int").alias("shown"))


@query("keyframe_window", "select vehicle_id, sample_id, t_us, count(*) n from perception where t_us > 100000000 and t_us <= 9000000000 group by 1, 2, 3 order by t_us, vehicle_id, sample_id limit 50")
def _(t):
    p = latest.time_window(t.perception().withColumn("t_us", us("sensor_time")), 100_000_000, 9_000_000_000, "t_us")
    k = aggregates.keyframes(p).withColumn("t_us", us("sensor_time"))
    return k.orderBy("t_us", "vehicle_id", "sample_id").limit(50).select("vehicle_id", "sample_id", "t_us", F.col("n_objects").alias("n"))


@query("vehicle_window", f"select event_id from signals where t_us > {_FROM} and t_us <= {_FROM} + 900000000000 and vehicle_id = 'v4'")
def _(t):
    return latest.of_vehicle(latest.time_window(t.signals(), _FROM, _FROM + 900_000_000_000, "t_us"), "v4").select("event_id")


@query("plausible_places", "select event_id, k % 9 <> 0 and abs(value * 2 - 80) <= 90 as fine from e")
def _(t):
    lat = F.when(F.col("k") % 9 == 0, F.when(F.col("k") % 2 == 0, None).otherwise(F.lit(float("nan")))).otherwise(F.col("value") * 2 - 80)
    return t.events().select("event_id", geo.plausible(lat, F.lit(100.0)).alias("fine"))


@query("vehicle_home", f", p as (select vehicle_id, lat, lon, row_number() over (partition by vehicle_id order by t_us desc, boot_id desc, seq desc) r from signals where lat is not null and lon is not null) select vehicle_id, {sql6('lat')} home_lat, {sql6('lon')} home_lon from p where r = 1")
def _(t):
    r = aggregates.fleet_roster(t.signals()).where("home is not null")
    return r.select("vehicle_id", cut6(F.col("home")[0]).alias("home_lat"), cut6(F.col("home")[1]).alias("home_lon"))


@query("merged_timeline", "select vehicle_id, t_us, 0 kind, event_id id from signals union all select vehicle_id, t_us, 1, seq from perception")
def _(t):
    a = t.signals().select("vehicle_id", "t_us", F.col("event_id").alias("id"), F.lit(0).alias("kind"))
    b = t.perception().select("vehicle_id", us("sensor_time").alias("t_us"), F.col("seq").alias("id"), F.lit(1).alias("kind"))
    return files.merged_timeline(a, b).select("vehicle_id", "t_us", "kind", "id")


@query("timeline_order", ", m as (select vehicle_id, t_us, 0 kind, event_id id from signals union all select vehicle_id, t_us, 1, t_us + 1 from signals) select vehicle_id, id, row_number() over (partition by vehicle_id order by t_us, kind, id) n from m")
def _(t):
    """Each vehicle's places in the one order that the timeline of the whole fleet has."""
    s = t.signals()
    a = s.select("vehicle_id", "t_us", F.col("event_id").alias("id"))
    b = s.select("vehicle_id", "t_us", (F.col("t_us") + 1).alias("id"))
    both = files.merged_timeline(a, b).withColumn("_n", F.monotonically_increasing_id())
    return both.select("vehicle_id", "id", F.row_number().over(W.partitionBy("vehicle_id").orderBy("_n")).cast("long").alias("n"))


# ---- whole boxes and final views of all layers ----


@query("keyframe_boxes", f"""select sample_id, seq, vehicle_id, {_R4.format('center_x')} x, {_R4.format('center_y')} y, {_R4.format('size_w')} w, {_R4.format('size_l')} l, {_R4.format('2 * asin(greatest(-1.0, least(1.0, rot_z)))')} yaw,
 string_split(category, '.')[-1] as class, cast(num_lidar_pts as int) lidar, visibility from perception""")
def _(t):
    b = aggregates.keyframes(t.perception().select("*")).select("sample_id", "vehicle_id", F.explode("boxes").alias("b"))
    return b.select("sample_id", "vehicle_id", "b.seq", F.col("b.center")[0].alias("x"), F.col("b.center")[1].alias("y"), F.col("b.size")[0].alias("w"), F.col("b.size")[1].alias("l"), "b.yaw", "b.class", F.col("b.lidar").cast("int").alias("lidar"), "b.visibility")


@query("summary_boxes", """, b as (select *, case when contains(category, '.') then string_split(category, '.')[2] else category end cls, row_number() over (partition by vehicle_id, sample_id order by seq, track_id, center_x) n from perception)
select vehicle_id, sample_id, cast(n as int) n, floor(center_x * 100 + 0.5) / 100 x, floor(center_y * 100 + 0.5) / 100 y, floor(atan2(2 * (rot_w * rot_z + rot_x * rot_y), 1 - 2 * (rot_y * rot_y + rot_z * rot_z)) * 100 + 0.5) / 100 yaw, cls as class from b where n <= 60""")
def _(t):
    k = aggregates.keyframe_summary(t.perception()).select("vehicle_id", "sample_id", F.explode("boxes").alias("b"))
    return k.select("vehicle_id", "sample_id", F.col("b._n").alias("n"), F.col("b.center")[0].alias("x"), F.col("b.center")[1].alias("y"), "b.yaw", "b.class")


_AGAIN = "select *, 0 ing from {0} union all select * replace ({1}), 1 from {0} where seq % 5 = 0"


@query("final_layers", f""", pa as ({_AGAIN.format('perception', "'again' as visibility")}), sa as ({_AGAIN.format('segments', "'DROPPED' as state")}),
pf as (select * from pa qualify row_number() over (partition by vehicle_id, boot_id, seq order by ing desc, center_x desc) = 1), sf as (select * from sa qualify row_number() over (partition by vehicle_id, boot_id, seq order by ing desc) = 1)
select 'perception' layer, vehicle_id, count(*) n, count(*) filter (visibility = 'again') again from pf group by 2 union all select 'segments', vehicle_id, count(*), count(*) filter (state = 'DROPPED') from sf group by 2""")
def _(t):
    def final(df: DataFrame, change: str, value: str, tie: tuple) -> DataFrame:
        at = lambda d, s: d.withColumn("ingest_time", F.timestamp_seconds(F.lit(s)))
        return final_view(at(df, 0).unionByName(at(df.where("seq % 5 = 0").withColumn(change, F.lit(value)), 1)), tie=tie)

    p, s = final(t.perception(), "visibility", "again", ("center_x",)), final(t.segments(), "state", "DROPPED", ())
    counted = lambda d, n, hit: d.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("again")).withColumn("layer", F.lit(n))
    return counted(p, "perception", F.col("visibility") == "again").unionByName(counted(s, "segments", F.col("state") == "DROPPED"))


# ---- whole profiles ----


@query("raw_channels", f""", fr as (select unnest(case when o_orderkey % 3 = 0 then ['CAM_FRONT', 'LIDAR_TOP'] else ['CAM_FRONT'] end) channel, abs(size_bytes) sz, o_orderkey % 6 = 0 kf from segments)
select channel, count(*) n, {sql6('count(*) / 1000.0')} hz, {sql6('avg(sz)')} mean_bytes, {sql6('sum(sz) / 1000.0 / 1048576')} mib_s, {sql6('count(*) filter (kf) / count(*)')} key_ratio, {sql6('sum(sz) filter (kf) / sum(sz)')} key_byte_ratio, row_number() over (order by sum(sz) desc, channel) place from fr group by 1""")
def _(t):
    f = t.segments().select(F.explode("sensor_channels").alias("channel"), F.abs("size_bytes").alias("size_bytes"), (F.col("o_orderkey") % 6 == 0).alias("is_key_frame"))
    p = aggregates.raw_channels(f, 1000.0)
    return p.select("channel", "n", cut6("hz").alias("hz"), cut6("mean_bytes").alias("mean_bytes"), cut6("mib_s").alias("mib_s"), cut6("key_ratio").alias("key_ratio"), cut6("key_byte_ratio").alias("key_byte_ratio"), F.col("place").cast("long").alias("place"))


@query("channel_keys", ", k as (select channel, unnest(case when seq % 3 = 0 then ['a', 'speed'] else ['speed', 'z' || (k % 2)] end) key from signals) select channel, array_to_string(list_sort(list_distinct(list(key))), ',') keys from k group by 1")
def _(t):
    s = t.signals().withColumn("values_num", F.when(F.col("seq") % 3 == 0, F.create_map(F.lit("a"), F.lit(1.0), F.lit("speed"), F.lit(2.0))).otherwise(F.create_map(F.lit("speed"), F.lit(1.0), F.concat(F.lit("z"), F.col("k") % 2), F.lit(0.0))))
    return aggregates.channel_profile(s, 1.0).select("channel", F.array_join("keys", ",").alias("keys"))


@query("perception_stats", f""", k as (select scene_id, sample_id, t_us, count(*) n from perception group by 1, 2, 3), i as (select (t_us - lag(t_us) over (partition by scene_id order by t_us, sample_id)) / 1e6 gap from k)
select (select {sql6('avg(gap)')} from i) mean_interval_s, (select {sql6('avg(n)')} from k) objects_mean, count(*) n_annotations, {sql6('count(*) filter (num_lidar_pts = 0) / count(*)')} lidar_zero_ratio, {sql6('count(*) filter (num_radar_pts = 0) / count(*)')} radar_zero_ratio, count(distinct category) n_categories from perception""")
def _(t):
    r = aggregates.perception_stats(t.perception())
    return r.select(cut6("mean_interval_s").alias("mean_interval_s"), cut6("objects_mean").alias("objects_mean"), "n_annotations", cut6("lidar_zero_ratio").alias("lidar_zero_ratio"), cut6("radar_zero_ratio").alias("radar_zero_ratio"), "n_categories")


@query("visibility_topk", "select visibility, count(*) n from perception group by 1 order by n desc, visibility limit 10")
def _(t):
    return aggregates.top_values(t.perception(), "visibility", 10)


@query("scene_sets", f", d as (select scene_id, (max(t_us) - min(t_us)) / 1e6 s from signals group by 1) select (select floor(sum(s) + 0.5) from d) total_s, array_to_string(list_sort(list(distinct vehicle_id)), ',') vehicles, array_to_string(list_sort(list(distinct location)), ',') locations from signals")
def _(t):
    r = aggregates.scene_sets(t.signals())
    return r.select(F.floor(F.col("total_s") + 0.5).cast("double").alias("total_s"), F.array_join("vehicles", ",").alias("vehicles"), F.array_join("locations", ",").alias("locations"))


@query("clip_counts", f""", p as (select scene_id, count(*) n_objects, count(*) filter (num_lidar_pts = 0) n_zero_lidar from perception group by 1), s as (select 's' || (user_id % 20) scene_id, {sql6('avg(lat)')} lat, {sql6('avg(lon)')} lon from signals where channel = 'ego_pose' and lat is not null group by 1)
select scene_id, n_objects, n_zero_lidar, lat, lon from p left join s using (scene_id)""")
def _(t):
    ego = t.signals().where("channel = 'ego_pose' and lat is not null").withColumn("scene_id", F.concat(F.lit("s"), F.regexp_extract("vehicle_id", r"\d+", 0).cast("int") % 20))
    return aggregates.clip_counts(t.perception(), ego).select("scene_id", "n_objects", "n_zero_lidar", cut6("lat").alias("lat"), cut6("lon").alias("lon"))


@query("storage_pinned", "select state, count(*) n, cast(coalesce(sum(size_bytes), 0) as bigint) bytes, count(*) filter (pin) pinned, cast(coalesce(sum(size_bytes) filter (pin), 0) as bigint) pinned_bytes from (select *, o_orderkey % 7 = 0 pin, case when o_orderkey % 4 = 0 then 'DELETED' else state end st from segments) where st <> 'DELETED' group by 1")
def _(t):
    s = t.segments().withColumn("pinned", F.col("o_orderkey") % 7 == 0).withColumn("state", F.when(F.col("o_orderkey") % 4 == 0, "DELETED").otherwise(F.col("state")))
    return aggregates.storage_usage(s)


@query("health", """select (select count(*) from signals) signals, (select count(*) from perception) perception, (select count(*) from segments) segments, (select count(distinct vehicle_id) from signals) vehicles, (select max(t_us) from signals) newest_us,
 (select count(*) - count(distinct (vehicle_id, boot_id, seq)) from signals_raw) pending_dupes, (select cast(sum(m) as bigint) from (select max(seq) - min(seq) + 1 - count(*) m from signals group by vehicle_id, boot_id)) missing""")
def _(t):
    return aggregates.health(t.signals(), t.signals_raw(), t.perception(), t.segments())


@query("map_merge", "select event_id, cast(3 as int) n, k % 2 = 0 same from e")
def _(t):
    a = F.create_map(F.lit("x"), F.col("k").cast("string"), F.lit("y"), F.lit("1"))
    b = F.create_map(F.lit("y"), F.lit("2"), F.lit("z"), F.lit("3"))
    merged = aggregates.merged_maps(a, b)
    same = aggregates.same_channels(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.when(F.col("k") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"))))
    return t.events().select("event_id", F.when(merged["y"] == "2", F.size(merged)).alias("n"), same.alias("same"))


@query("idempotent_append", "select vehicle_id, count(*) n, cast(sum(seq) as bigint) s from (select distinct vehicle_id, boot_id, seq from e) group by 1")
def _(t):
    e = t.events().select("vehicle_id", "boot_id", "seq")
    stored = e.where("seq % 2 = 0")
    return latest.append_new(stored, e, ["vehicle_id", "boot_id", "seq"]).groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("s"))


# ---- positions to the contract's precision ----


@query("enu_to_wgs84_nano", "select event_id, dup, floor(lat * 1e9 + 0.5) / 1e9 lat, floor(lon * 1e9 + 0.5) / 1e9 lon from signals_raw")
def _(t):
    return t.signals_raw().select("event_id", "dup", geo.round_half_up(F.col("lat"), 9).alias("lat"), geo.round_half_up(F.col("lon"), 9).alias("lon"))


@query("position_round_trip", f", g as (select event_id, {_XY[0]} x, {_XY[1]} y from signals where lat is not null) select event_id, floor(x * 1e3 + 0.25) x_mm, floor(y * 1e3 + 0.25) y_mm from g where x * x + y * y > 400")
def _(t):
    """A millimetre there and back; points within twenty metres of an origin are left to the unit tests, as acos is blunt there."""
    s = t.signals().where("lat is not null").withColumn("p", geo.wgs84_to_enu(F.col("lat"), F.col("lon"), F.col("location")))
    x, y = (F.expr(v) for v in _XY)
    return s.where(x * x + y * y > 400).select("event_id", F.floor(F.col("p.x") * 1e3 + 0.25).cast("double").alias("x_mm"), F.floor(F.col("p.y") * 1e3 + 0.25).cast("double").alias("y_mm"))


@query("geo_origins", f"select distinct location, round(({_origin_sql(0)})::double, 12) lat0, round(({_origin_sql(1)})::double, 12) lon0 from e")
def _(t):
    zero = geo.enu_to_wgs84(F.lit(0.0), F.lit(0.0), F.col("location"))
    return t.events().select("location").distinct().withColumn("p", zero).select("location", F.round("p.lat", 12).alias("lat0"), F.round("p.lon", 12).alias("lon0"))
