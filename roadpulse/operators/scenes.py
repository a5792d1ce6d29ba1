"""Scenes as tables: chains of records that name their next one, lookups by token, native channels and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import norm
from ..session import cut

#: Channels of a vehicle's own bus, beside its pose.
NATIVE = ("zoesensors", "ms_imu", "zoe_veh_info", "steeranglefeedback", "pose", "vehicle_monitor")


def walked(nodes: DataFrame, token: str = "token", following: str = "next", most_rounds: int = 40) -> DataFrame:
    """Adds chain_end, the last token of a row's chain, and to_end, the number of steps to it.

    Each round doubles the step, so a chain of n records takes log2(n) joins on the token and no pointer is chased
    one by one. A `next` that no row has ends the chain; a ring is an error. Tokens must be unique.
    """
    bare = nodes.select(F.col(token).alias("t"), F.col(following).alias("n"))
    known = bare.select("t").withColumnRenamed("t", "n").withColumn("there", F.lit(True))
    state = cut(bare.join(known.hint("merge"), "n", "left").select("t", F.when(F.col("there"), F.col("n")).alias("n")).select("t", "n", F.when(F.col("n").isNull(), F.col("t")).alias("end"), F.when(F.col("n").isNull(), 0).otherwise(1).cast("long").alias("d")))
    for _ in range(most_rounds):
        if state.where("n is not null").isEmpty():
            break
        ahead = state.select(F.col("t").alias("n"), F.col("n").alias("n2"), F.col("end").alias("end2"), F.col("d").alias("d2"))
        state = cut(state.join(ahead.hint("merge"), "n", "left").select("t", F.col("n2").alias("n"), F.coalesce("end", "end2").alias("end"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
    else:
        raise ValueError("a chain has no end")
    return nodes.join(state.select(F.col("t").alias(token), F.col("end").alias("chain_end"), F.col("d").alias("to_end")), token)


def until(walk: DataFrame, scenes: DataFrame, first: str, end_time: str, time: str) -> DataFrame:
    """The rows of each scene's chain from its first token on, up to the first one later than its end. Adds at, from 0. Scenes: scene_id, first, end_time."""
    heads = walk.select(F.col("token").alias(first), F.col("chain_end"), F.col("to_end").alias("_from"))
    named = scenes.join(heads, first).select("scene_id", "chain_end", "_from", F.col(end_time).alias("_end"))
    rows = walk.join(named, "chain_end").withColumn("at", F.col("_from") - F.col("to_end")).where("at >= 0")
    stops = rows.where(F.col(time) > F.col("_end")).groupBy("scene_id").agg(F.min("at").alias("_stop"))
    return rows.join(stops, "scene_id", "left").where(F.col("_stop").isNull() | (F.col("at") < F.col("_stop"))).drop("_from", "_end", "_stop")


def native_channels(channels: dict[str, DataFrame], poses: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every message of the native channels that are there, and the poses, in order of time within a scene: scene_id, channel, t_us, values (JSON text). A missing channel is left out."""
    out = poses.select("scene_id", F.lit("ego_pose").alias("channel"), "t_us", "values")
    for name in NATIVE:
        if name in channels:
            out = out.unionByName(channels[name].select("scene_id", F.lit(name).alias("channel"), "t_us", "values"))
    return out.join(scenes.select("scene_id"), "scene_id", "left_semi").orderBy("scene_id", "t_us", "channel")


def joined_signal(pose: str, imu: str, steering: str) -> dict[str, Column]:
    """Speed, acceleration, yaw rate and steering of the samples that stand nearest in time. Vectors of another length than three give null."""
    three = lambda v, i: F.when(F.size(v) == 3, F.get(v, F.lit(i)))
    velocity = F.col(f"{pose}.vel")
    return {
        "speed_mps": F.when(F.size(velocity) > 0, norm(velocity)),
        **{f"accel_{axis}": three(F.col(f"{pose}.accel"), i) for i, axis in enumerate("xyz")},
        "yaw_rate": three(F.col(f"{imu}.rotation_rate"), 2),
        "steering_rad": F.col(f"{steering}.value"),
    }


def first_attribute(names: Column) -> Column:
    return F.get(names, F.lit(0))


def keyframes_only(files: DataFrame, include_sweeps: bool = True, key: str = "is_key_frame") -> DataFrame:
    return files if include_sweeps else files.where(F.col(key))
