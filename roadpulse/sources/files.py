"""Sources: broker-shaped records, recordings in binary frames, point clouds, JSON alerts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frame_digest
from ..schemas import ALERTS, ENVELOPE

MAGIC_V2 = b"FSMQ\x02"


def broker_stream(spark: SparkSession, servers: str, topic: str, group: str | None = None, starting: str = "earliest", most_per_trigger: int | None = None) -> DataFrame:
    """Records with headers. The checkpoint holds the offsets that are done; `starting` (earliest, latest, or offsets by partition as JSON, such as a group's committed ones) counts for a first start alone. Needs the Kafka package."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": "true", "startingOffsets": starting}
    if group:
        options["kafka.group.id"] = group
    if most_per_trigger:
        options["maxOffsetsPerTrigger"] = str(most_per_trigger)
    return spark.readStream.format("kafka").options(**options).load()


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Records of the same shape from Parquet files."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def alerts_from_json(records: DataFrame) -> DataFrame:
    """Alerts of a topic, under the names that the monitors give them; a record that is no alert, or whose key isn't its vehicle, is skipped."""
    a = records.withColumn("a", F.from_json(F.decode("value", "UTF-8"), ALERTS))
    fine = F.col("a.eventId").isNotNull() & F.col("a.type").isNotNull() & F.col("a.vehicleId").isNotNull() & (F.col("key").isNull() | (F.decode("key", "UTF-8") == F.col("a.vehicleId")))
    own = ("event_id", "type", "severity", "vehicle_id", "boot_id", "seq", "event_ms", "detected_ms", "location", "lat", "lon", "message")
    return a.where(fine).select(*[F.col("a." + f.strip().split(" ")[0]).alias(n) for n, f in zip(own, ALERTS.split(","))])


def frame_check(wire: Column) -> Column:
    """Why a binary batch frame is refused, or null: magic, 32-byte digest over magic and body, body."""
    n = len(MAGIC_V2)
    body = F.substring(wire, n + 33, F.length(wire))
    return (
        F.when((F.length(wire) <= n + 32) | (F.substring(wire, 1, n) != F.lit(MAGIC_V2)), "unsupported version or truncated")
        .when(frame_digest(body, MAGIC_V2) != F.lower(F.hex(F.substring(wire, n + 1, 32))), "digest mismatch")
    )


def wal_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of write-ahead logs: path, seq, kind, payload, up to the first torn or damaged one.

    A frame is length and CRC-32 (u32), seq (u64), kind (u8), payload, little-endian; the CRC covers seq, kind and payload.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = struct.Struct("<IIQB")
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                at = 0
                while at + head.size <= len(data):
                    size, crc, seq, kind = head.unpack_from(data, at)
                    end = at + head.size + size
                    if end > len(data) or zlib.crc32(data[at + 8 : end]) != crc:
                        break
                    rows.append((path, seq, kind, data[at + head.size : end]))
                    at = end
            yield pd.DataFrame(rows, columns=["path", "seq", "kind", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, seq long, kind int, payload binary")


def lidar_points(spark: SparkSession, path: str, most: int = 40_000) -> DataFrame:
    """Points of float32 x 5 blobs, thinned evenly to `most` a file, intensity / 64 cut to [0, 1]: path, x, y, z, intensity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                p = np.frombuffer(data[: len(data) // 20 * 20], dtype="<f4").reshape(-1, 5)
                if len(p) > most:
                    p = p[np.linspace(0, len(p) - 1, most).astype(int)]
                yield pd.DataFrame({"path": path, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "intensity": np.clip(p[:, 3] / 64, 0, 1)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x float, y float, z float, intensity float")


def json_lines(df: DataFrame) -> DataFrame:
    """`line`: each row as JSON, fields in the columns' order, nulls written out; to be written as text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def merged_timeline(signals: DataFrame, perception: DataFrame, time: str = "t_us") -> DataFrame:
    """Both kinds on one axis, signals first at equal times."""
    a = signals.withColumn("_kind", F.lit(0))
    b = perception.withColumn("_kind", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).orderBy(time, "_kind").drop("_kind")
