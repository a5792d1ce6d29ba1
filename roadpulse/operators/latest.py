"""Latest version of each key, as a replacing table's final view shows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDENTITY = ("vehicle_id", "boot_id", "seq")


def final_view(raw: DataFrame, keys: tuple[str, ...] = IDENTITY, version: str = "ingest_time", tie: tuple[str, ...] = (), key_filter: Column | None = None) -> DataFrame:
    """One row per key, that of the greatest version; `tie` decides between equal ones.

    Only filters on keys may go below the choice (`key_filter`): an older version
    may have another time or value, so other filters belong after it. A ranked
    window with a limit of one is pre-reduced on the map side.
    """
    if key_filter is not None:
        raw = raw.where(key_filter)
    order = W.partitionBy(*keys).orderBy(F.desc(version), *[F.desc(t) for t in tie])
    return raw.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def time_window(df: DataFrame, start, end, column: str = "sensor_time") -> DataFrame:
    """Half-open: start < t <= end. Reaches the Parquet scan on raw tables."""
    return df.where((F.col(column) > F.lit(start)) & (F.col(column) <= F.lit(end)))


def of_vehicle(df: DataFrame, vehicle: str | None) -> DataFrame:
    """Blank or none means all vehicles."""
    return df if not vehicle or not vehicle.strip() else df.where(F.col("vehicle_id") == vehicle)


def append_new(stored: DataFrame, arrived: DataFrame, keys: list[str]) -> DataFrame:
    """What a table holds after an append that may be repeated: stored rows and those that arrived under keys it lacks, once each."""
    fresh = arrived.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh)
