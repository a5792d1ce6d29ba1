"""Read queries and profiles over the record layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import round_half_up, yaw_approx, yaw_true
from ..functions.text import millis_between, second_category, short_category


def fleet_roster(signals: DataFrame) -> DataFrame:
    """One row per vehicle: scene of its latest record, latest valid position, records, recorded time.

    Two levels: per scene, then per vehicle. The scene follows the latest record, the position the latest valid one.
    """
    valid = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    where = F.struct("lat", "lon", F.coalesce(F.try_element_at("values_str", F.lit("location")), F.lit("")).alias("location"))
    scenes = signals.groupBy("vehicle_id", "scene_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("sensor_time").alias("scene_time"),
        millis_between(F.min("sensor_time"), F.max("sensor_time")).alias("scene_ms"),
        F.max_by(where, F.when(valid, F.struct("sensor_time", "boot_id", "seq"))).alias("position"),
        F.max(F.when(valid, F.col("sensor_time"))).alias("position_time"),
    )
    fleet = scenes.groupBy("vehicle_id").agg(
        F.max_by("scene_id", F.struct("scene_time", "scene_id")).alias("scene_id"),
        F.max_by("position", F.when(F.col("position_time").isNotNull(), F.struct("position_time", "scene_id"))).alias("p"),
        F.sum("n").alias("n_records"),
        F.sum("scene_ms").alias("recorded_ms"),
    )
    home = F.when(F.col("p.lat").isNotNull() & F.col("p.lon").isNotNull(), F.array("p.lat", "p.lon"))
    return fleet.select("vehicle_id", "scene_id", F.coalesce("p.location", F.lit("")).alias("location"), "n_records", "recorded_ms", F.col("p.lat").alias("last_lat"), F.col("p.lon").alias("last_lon"), home.alias("home")).orderBy("vehicle_id")


def _first_class_counts(category: Column) -> Column:
    """Class counts of an ordered array, as (class, n) in order of first appearance."""
    return F.transform(F.array_distinct(category), lambda c: F.struct(c.alias("class"), F.size(F.filter(category, lambda x: x == c)).alias("n")))


def keyframes(boxes: DataFrame) -> DataFrame:
    """One row per keyframe, boxes as one array in sequence order, so that their columns can't come apart."""
    box = F.struct("seq", "vehicle_id", "boot_id", "category", "center_x", "center_y", "size_w", "size_l", "rot_z", "visibility", "num_lidar_pts", "track_id")
    frames = boxes.groupBy("vehicle_id", "sample_id", "sensor_time").agg(
        F.count(F.lit(1)).alias("n_objects"), F.count(F.when(F.col("num_lidar_pts") == 0, 1)).alias("n_zero_lidar"), F.sort_array(F.collect_list(box)).alias("b")
    )
    shown = F.transform("b", lambda b: F.struct(
        b["seq"].alias("seq"), F.array(round_half_up(b["center_x"]), round_half_up(b["center_y"])).alias("center"), F.array(round_half_up(b["size_w"]), round_half_up(b["size_l"])).alias("size"),
        round_half_up(yaw_approx(b["rot_z"])).alias("yaw"), short_category(b["category"]).alias("class"), b["num_lidar_pts"].alias("lidar"), b["visibility"].alias("visibility"),
    ))
    frames = frames.withColumn("boxes", shown)
    return frames.withColumn("classes", _first_class_counts(F.transform("boxes", lambda b: b["class"]))).drop("b")


def keyframe_summary(boxes: DataFrame, classes: int = 6, most_boxes: int = 60) -> DataFrame:
    """The exported variant: second part of the category, six largest classes, sixty boxes, two places, true yaw. All in one shuffle and one sort of the boxes."""
    box = boxes.select("*", second_category(F.col("category")).alias("class"), round_half_up(yaw_true(*map(F.col, ("rot_w", "rot_x", "rot_y", "rot_z"))), 2).alias("yaw"))
    rank = W.partitionBy("vehicle_id", "sample_id").orderBy("seq", "track_id", "center_x")
    kept = box.withColumn("_n", F.row_number().over(rank))
    shown = F.struct("_n", F.array(round_half_up(F.col("center_x"), 2), round_half_up(F.col("center_y"), 2)).alias("center"), "yaw", "class")
    counts = kept.groupBy("vehicle_id", "sample_id", "class").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("_n") <= most_boxes, shown)).alias("boxes"))
    top = W.partitionBy("vehicle_id", "sample_id").orderBy(F.desc("n"), "class")
    ranked = counts.withColumn("_r", F.row_number().over(top))
    best = F.collect_list(F.when(F.col("_r") <= classes, F.struct("_r", "class", "n")))
    return ranked.groupBy("vehicle_id", "sample_id").agg(F.sum("n").alias("n_objects"), F.sort_array(F.flatten(F.collect_list("boxes"))).alias("boxes"), F.sort_array(best).alias("classes"))


def vehicle_progress(signals: DataFrame) -> DataFrame:
    """Per boot: first, last and received sequence numbers. Pass one layer for the historic meaning, all layers for true gaps."""
    expected = F.col("last_seq") - F.col("first_seq") + 1
    counted = signals.groupBy("vehicle_id", "boot_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("received"))
    return counted.withColumn("expected", expected).withColumn("missing", expected - F.col("received")).orderBy("vehicle_id", "boot_id")


def duplicate_pressure(tables: dict[str, DataFrame], keys: tuple[str, ...] = ("vehicle_id", "boot_id", "seq")) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_raw"), F.count(F.lit(1)).alias("rows_distinct"))
        row = row.select(F.lit(name).alias("table"), "rows_raw", "rows_distinct", (F.col("rows_raw") - F.col("rows_distinct")).alias("pending_dupes"))
        out = row if out is None else out.unionByName(row)
    return out


def layer_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, a count per layer: each branch is reduced to a row before they meet."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias(name))
        out = row if out is None else out.crossJoin(row)  # one row on either side
    return out


def clips(segments: DataFrame, limit: int = 100) -> DataFrame:
    """Latest recordings first; at least 1 and at most 1000 of them."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    duration = F.coalesce(millis_between(F.col("t_start"), F.col("t_end")) / 1000, F.lit(0.0))
    newest = segments.orderBy(F.desc("t_start"), "vehicle_id", "boot_id", "seq").limit(min(limit, 1000))
    return newest.select(F.col("segment_id").alias("clip_id"), "vehicle_id", F.col("scene_id").alias("scene_name"), "blob_uri", duration.alias("duration_s"), "size_bytes", "sample_count", "state", "sensor_channels")


def percentile_nearest(value: str, q: float) -> Column:
    """sorted[ceil(n q) - 1]"""
    return F.expr(f"percentile_disc({q}) within group (order by {value})")


def percentile_floor(df: DataFrame, value: str, q: float, keys: list[str]) -> DataFrame:
    """sorted[floor(n q)] per key, by rank: no list of all values is held."""
    by = W.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(by.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    return ranked.where(F.col("_i") == F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1)).select(*keys, value)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value; the total is a window over already reduced rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", round_half_up(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def channel_profile(signals: DataFrame, total_s: float) -> DataFrame:
    """Per channel: rows, rate, and sorted keys of its numbers."""
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("values_num")))))
    size = F.length(F.to_json(F.struct("values_num", "values_vec", "values_str")))
    return signals.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), round_half_up(F.count(F.lit(1)) / F.lit(total_s), 6).alias("hz"), F.avg(size).alias("mean_json"), keys.alias("keys"))


def tag_histogram(df: DataFrame, text: str) -> DataFrame:
    """Comma- or semicolon-separated tags: lower case, trimmed, counted."""
    tag = F.explode(F.split(F.replace(F.lower(F.col(text)), F.lit(";"), F.lit(",")), ","))
    return df.select(tag.alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def signal_json() -> Column:
    """A signal as clients read it: t (epoch ms), channel and one map of values. Texts override vectors, which override numbers; a place is there only if both its parts are."""
    num = F.map_filter("values_num", lambda k, _: ~F.array_contains(F.map_keys("values_vec"), k) & ~F.array_contains(F.map_keys("values_str"), k))
    vec = F.map_filter("values_vec", lambda k, _: ~F.array_contains(F.map_keys("values_str"), k))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    pair = lambda k, v: F.concat(quoted(k), F.lit(":"), v)
    members = F.concat(
        F.transform(F.map_entries(num), lambda e: pair(e["key"], F.coalesce(e["value"].cast("string"), F.lit("null")))),
        F.transform(F.map_entries(vec), lambda e: pair(e["key"], F.coalesce(F.to_json(e["value"]), F.lit("null")))),
        F.transform(F.map_entries("values_str"), lambda e: pair(e["key"], quoted(e["value"]))),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array(F.concat(F.lit('"lat":'), F.col("lat").cast("string")), F.concat(F.lit('"lon":'), F.col("lon").cast("string")))).otherwise(F.array().cast("array<string>")),
    )
    head = F.concat(F.lit('{"t":'), F.unix_millis("sensor_time").cast("string"), F.lit(',"channel":'), quoted(F.col("channel")))
    return F.concat(head, F.lit(',"values":{'), F.array_join(members, ","), F.lit("}}"))


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps' entries; the second's override."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)


def same_channels(a: Column, b: Column) -> Column:
    """Whether two lists name the same channels, in any order and number."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def raw_channels(recorded: DataFrame, total_s: float) -> DataFrame:
    """Per channel of recorded files: number, rate, mean size, MiB a second, the keyframes' share by number and size, and its place by bandwidth."""
    key = F.col("is_key_frame")
    size = F.sum("size_bytes")
    per = recorded.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), size.alias("bytes"), (F.count(F.when(key, 1)) / F.count(F.lit(1))).alias("key_ratio"), (F.coalesce(F.sum(F.when(key, F.col("size_bytes"))), F.lit(0)) / size).alias("key_byte_ratio")
    )
    shown = per.withColumns({"hz": F.col("n") / F.lit(total_s), "mean_bytes": F.col("bytes") / F.col("n"), "mib_s": F.col("bytes") / F.lit(total_s) / 1048576})
    return shown.withColumn("place", F.row_number().over(W.orderBy(F.desc("bytes"), "channel")))  # a row a channel


def perception_stats(boxes: DataFrame) -> DataFrame:
    """One row: mean time between a scene's keyframes, boxes a keyframe, and how many boxes no lidar or radar point hit."""
    frames = boxes.groupBy("scene_id", "sample_id", "sensor_time").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("num_lidar_pts") == 0, 1)).alias("no_lidar"), F.count(F.when(F.col("num_radar_pts") == 0, 1)).alias("no_radar"))
    gap = F.unix_micros("sensor_time") - F.lag(F.unix_micros("sensor_time")).over(W.partitionBy("scene_id").orderBy("sensor_time", "sample_id"))
    row = frames.withColumn("gap", gap / 1e6).agg(
        F.avg("gap").alias("mean_interval_s"), F.avg("n").alias("objects_mean"), F.min("n").alias("objects_min"), F.max("n").alias("objects_max"), F.sum("n").alias("n_annotations"),
        (F.sum("no_lidar") / F.sum("n")).alias("lidar_zero_ratio"), (F.sum("no_radar") / F.sum("n")).alias("radar_zero_ratio"),
    )
    return row.crossJoin(boxes.agg(F.countDistinct("category").alias("n_categories")))  # one row on either side


def scene_sets(signals: DataFrame) -> DataFrame:
    """One row: the scenes' summed length, and the vehicles and places that occur."""
    lengths = signals.groupBy("scene_id").agg(((F.max("t_us") - F.min("t_us")) / 1e6).alias("s")).agg(F.sum("s").alias("total_s"))
    sets = signals.agg(F.array_sort(F.collect_set("vehicle_id")).alias("vehicles"), F.array_sort(F.collect_set("location")).alias("locations"))
    return lengths.crossJoin(sets)  # one row on either side


def clip_counts(boxes: DataFrame, poses: DataFrame) -> DataFrame:
    """Per scene: boxes, boxes without lidar points, and the mean place of its poses."""
    n = boxes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_objects"), F.count(F.when(F.col("num_lidar_pts") == 0, 1)).alias("n_zero_lidar"))
    return n.join(poses.groupBy("scene_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")), "scene_id", "left")


def storage_usage(segments: DataFrame) -> DataFrame:
    """Number and size by state, of pinned ones too; deleted recordings don't count."""
    size = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pin = F.col("pinned")
    return segments.where("state <> 'DELETED'").groupBy("state").agg(F.count(F.lit(1)).alias("n"), size(F.col("size_bytes")).alias("bytes"), F.count(F.when(pin, 1)).alias("pinned"), size(F.when(pin, F.col("size_bytes"))).alias("pinned_bytes"))


def health(signals: DataFrame, signals_raw: DataFrame, perception: DataFrame, segments: DataFrame) -> DataFrame:
    """One row of what an operator looks at first. Every part is reduced to a row before they meet."""
    counts = layer_counts({"signals": signals, "perception": perception, "segments": segments})
    seen = signals.agg(F.countDistinct("vehicle_id").alias("vehicles"), F.max(F.unix_micros("sensor_time")).alias("newest_us"))
    dupes = duplicate_pressure({"signals": signals_raw}).select("pending_dupes")
    missing = vehicle_progress(signals).agg(F.sum("missing").alias("missing"))
    return counts.crossJoin(seen).crossJoin(dupes).crossJoin(missing)
