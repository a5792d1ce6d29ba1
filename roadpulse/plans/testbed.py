"""Telemetry layers derived from the star-schema test tables by a fixed rule, and the same rule as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import ORIGINS, enu_to_wgs84
from ..operators.latest import final_view

PLACES = [*ORIGINS, "unknown-area"]
CHANNELS = {"view": "ego_pose", "click": "pose", "purchase": "fleet_status", "error": "steeranglefeedback", "signup": "ms_imu"}
CATEGORIES = ["vehicle.car", "vehicle.truck", "human.pedestrian.adult", "movable_object.barrier", "vehicle.bicycle", "static"]
VISIBILITY = ["v0-40", "v40-60", "v60-80", "v80-100"]


class Testbed:
    """Frames over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        """Every event with its telemetry columns; each 17th of a vehicle is lost."""
        return self.table("events").selectExpr(
            "event_id", "user_id", "concat('v', user_id) as vehicle_id", "concat('b', (day(ts) - 1) div 10) as boot_id",
            "row_number() over (partition by user_id order by ts, event_id) - 1 as rn", "concat('s', user_id, '-', (day(ts) - 1) div 7) as scene_id",
            "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in CHANNELS.items()) + " end as channel",
            "unix_micros(cast(ts as timestamp)) as t_us", "value", "cast(get_json_object(props, '$.k') as int) as k",
            "element_at(array(" + ", ".join(f"'{p}'" for p in PLACES) + "), cast(user_id % 5 as int) + 1) as location",
        ).where("rn % 17 <> 16").withColumn("seq", F.col("rn").cast("long"))

    def flat(self) -> DataFrame:
        """Raw signal rows, each seventh stored twice: plain columns."""
        e = self.events().withColumn("ingest_us", F.expr("t_us + (event_id % 5) * 1000000")).withColumn("dup", F.lit(0))
        again = e.where("event_id % 7 = 0").withColumns({"ingest_us": F.col("ingest_us") + 10_000_000, "value": F.col("value") + 1, "dup": F.lit(1)})
        both = e.unionByName(again)
        p = enu_to_wgs84(F.expr("value * 10 - 200"), F.expr("k * 12.5 - 400"), F.col("location"))
        return both.withColumn("_p", p).withColumns({"lat": F.col("_p.lat"), "lon": F.col("_p.lon")}).drop("_p")

    def signals_raw(self) -> DataFrame:
        """The same in the declared shape, with typed maps, and `offset` as arrival order."""
        return self._typed(self.flat())

    def _typed(self, flat: DataFrame) -> DataFrame:
        return flat.selectExpr(
            "vehicle_id", "boot_id", "seq", "scene_id", "channel", "timestamp_micros(t_us) as sensor_time", "timestamp_micros(t_us) as log_time", "timestamp_micros(ingest_us) as ingest_time",
            "map('speed', value, 'vehicle_speed', value - 3, 'mission_active', if(k % 3 <> 0, 1D, 0D), 'planned_stop', if(k % 4 = 0, 1D, 0D), 'sensor_healthy', if(k % 5 <> 0, 1D, 0D)) as values_num",
            "map('translation', array(value, cast(k as double), 0D), 'accel', array(value / 10 - 3, 0D, 9.8D)) as values_vec",
            "map('location', location) as values_str", "lat", "lon", "event_id as offset", "event_id", "dup", "t_us", "value", "k", "location",
        )

    def signals(self) -> DataFrame:
        """The final view, chosen among plain columns: maps are several times as large, and would all be sorted."""
        return self._typed(final_view(self.flat(), version="ingest_us", tie=("dup",)))

    def perception(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "concat('v', l_suppkey % 50) as vehicle_id", "'b0' as boot_id", "l_orderkey * 8 + l_linenumber as seq", "concat('s', l_orderkey % 20) as scene_id", "concat('k', l_orderkey) as sample_id",
            "timestamp_micros(l_orderkey * 500000) as sensor_time", "concat('t', l_partkey) as track_id",
            "element_at(array(" + ", ".join(f"'{c}'" for c in CATEGORIES) + "), cast(l_partkey % 6 as int) + 1) as category",
            "l_extendedprice / 100 as center_x", "l_quantity * 7.3 as center_y", "0D as center_z", "l_discount * 10 as size_w", "3 + l_tax * 20 as size_l", "1.5D as size_h",
            "sqrt(1 - pow((l_partkey % 2001 - 1000) / 1000D, 2)) as rot_w", "l_discount / 2 as rot_x", "0D as rot_y", "(l_partkey % 2001 - 1000) / 1000D as rot_z",
            "element_at(array(" + ", ".join(f"'{v}'" for v in VISIBILITY) + "), cast(l_partkey % 4 as int) + 1) as visibility",
            "cast(l_quantity as int) % 4 as num_lidar_pts", "cast(l_linenumber % 3 as int) as num_radar_pts", "l_partkey", "l_orderkey",
        )

    def segments(self) -> DataFrame:
        start = "unix_seconds(cast(o_orderdate as timestamp)) * 1000000 + (o_orderkey % 86400) * 1000000"
        return self.table("orders").selectExpr(
            "concat('v', o_custkey % 50) as vehicle_id", "'b0' as boot_id", "o_orderkey as seq", "concat('seg', o_orderkey) as segment_id", "concat('s', o_orderkey % 20) as scene_id",
            "concat('s3://clips/', o_orderkey) as blob_uri", f"{start} as start_us", f"{start} + cast(o_totalprice * 10 as bigint) * 1000 as end_us",
            "case when o_orderkey % 3 = 0 then array('CAM_FRONT', 'LIDAR_TOP') else array('CAM_FRONT') end as sensor_channels", "cast(o_totalprice * 100 as bigint) - 1000000 as size_bytes",
            "repeat('a', if(o_orderkey % 9 = 0, 63, 64)) as checksum", "cast(o_orderkey % 7 as int) as sample_count", "if(o_orderstatus = 'P', 'DROPPED', 'UPLOADED') as state", "o_orderkey",
        ).withColumns({"t_start": F.expr("timestamp_micros(start_us)"), "t_end": F.expr("timestamp_micros(end_us)")})

    def requests(self) -> DataFrame:
        """Recording requests around errors: a day before, two after."""
        day = 86_400_000_000
        e = self.events().where("channel = 'steeranglefeedback'")
        shift = 27 * 365 * day  # into the years of the recordings
        return e.selectExpr("concat('r', event_id) as request_id", "concat('v', user_id % 50) as vehicle_id", f"t_us - {shift} - (event_id % 2000) * {day} - {day} as req_start", f"t_us - {shift} - (event_id % 2000) * {day} + 2 * {day} as req_end")


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _pick(k: int) -> str:
    return "case location " + " ".join(f"when '{n}' then {p[k]!r}" for n, p in ORIGINS.items()) + " end"


def enu_sql(x: str, y: str, loc: str = "location") -> tuple[str, str]:
    """SQL of latitude and longitude."""
    lat0, lon0 = (f"radians({_pick(k)})".replace("case location", f"case {loc}") for k in (0, 1))
    b, a = f"atan2({x}, {y})", f"(sqrt(({x}) * ({x}) + ({y}) * ({y})) / 6378137.0)"
    s = f"greatest(-1.0, least(1.0, sin({lat0}) * cos({a}) + cos({lat0}) * sin({a}) * cos({b})))"
    lon = f"degrees({lon0} + atan2(sin({b}) * sin({a}) * cos({lat0}), cos({a}) - sin({lat0}) * ({s})))"
    return f"case when {lat0} is not null then degrees(asin({s})) end", lon


_lat, _lon = enu_sql("value * 10 - 200", "k * 12.5 - 400")
_start = "epoch_us(cast(o_orderdate as timestamp)) + (o_orderkey % 86400) * 1000000"
_day = 86_400_000_000

#: Common table expressions of the layers, for DuckDB.
BASE = f"""
with ev as (
  select event_id, user_id, 'v' || user_id vehicle_id, 'b' || ((day(ts) - 1) // 10) boot_id, row_number() over (partition by user_id order by ts, event_id) - 1 seq,
    's' || user_id || '-' || ((day(ts) - 1) // 7) scene_id, case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in CHANNELS.items())} end channel,
    epoch_us(ts) t_us, value, cast(json_extract_string(props, '$.k') as int) k, {_list(PLACES)}[cast(user_id % 5 as int) + 1] as location
  from events),
e as (select *, t_us + (event_id % 5) * 1000000 ingest_us, 0 dup from ev where seq % 17 <> 16),
f as (select * from e union all select * replace (value + 1 as value, ingest_us + 10000000 as ingest_us, 1 as dup) from e where event_id % 7 = 0),
signals_raw as (select *, {_lat} lat, {_lon} lon, event_id as ofs from f),
signals as (select * from signals_raw qualify row_number() over (partition by vehicle_id, boot_id, seq order by ingest_us desc, dup desc) = 1),
perception as (
  select 'v' || (l_suppkey % 50) vehicle_id, 'b0' boot_id, l_orderkey * 8 + l_linenumber seq, 's' || (l_orderkey % 20) scene_id, 'k' || l_orderkey sample_id, l_orderkey * 500000 t_us, 't' || l_partkey track_id,
    {_list(CATEGORIES)}[cast(l_partkey % 6 as int) + 1] category, l_extendedprice / 100 center_x, l_quantity * 7.3 center_y, l_discount * 10 size_w, 3 + l_tax * 20 size_l, 1.5 size_h,
    sqrt(1 - pow((l_partkey % 2001 - 1000) / 1000.0::double, 2)) rot_w, l_discount / 2 rot_x, 0.0 rot_y, (l_partkey % 2001 - 1000) / 1000.0::double rot_z,
    {_list(VISIBILITY)}[cast(l_partkey % 4 as int) + 1] visibility, cast(l_quantity as int) % 4 num_lidar_pts, l_linenumber % 3 num_radar_pts, l_partkey, l_orderkey
  from lineitem),
segments as (
  select 'v' || (o_custkey % 50) vehicle_id, 'b0' boot_id, o_orderkey seq, 'seg' || o_orderkey segment_id, 's' || (o_orderkey % 20) scene_id, 's3://clips/' || o_orderkey blob_uri,
    {_start} start_us, {_start} + cast(trunc(o_totalprice * 10) as bigint) * 1000 end_us, cast(trunc(o_totalprice * 100) as bigint) - 1000000 size_bytes,
    repeat('a', case when o_orderkey % 9 = 0 then 63 else 64 end) checksum, cast(o_orderkey % 7 as int) sample_count, case when o_orderstatus = 'P' then 'DROPPED' else 'UPLOADED' end state, o_orderkey
  from orders),
requests as (
  select 'r' || event_id request_id, 'v' || (user_id % 50) vehicle_id, t_us - {27 * 365 * _day} - (event_id % 2000) * {_day} - {_day} req_start, t_us - {27 * 365 * _day} - (event_id % 2000) * {_day} + {2 * _day} req_end
  from e where channel = 'steeranglefeedback')
"""
