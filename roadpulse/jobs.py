"""Command line of the two jobs: `python -m roadpulse.jobs storage ...` or `alerts ...`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .functions.geo import parse_bounds
from .session import session
from .sources import files
from .streaming import pipelines
from .streaming.ledger import supervised


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="roadpulse.jobs", description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)
    for name in ("storage", "alerts"):
        j = jobs.add_parser(name)
        source = j.add_mutually_exclusive_group(required=True)
        source.add_argument("--path", help="folder of record files")
        source.add_argument("--bootstrap", help="servers of a message broker")
        j.add_argument("--topic", default="telemetry.records")
        j.add_argument("--group", help="consumer group at the broker")
        j.add_argument("--starting", default="earliest", help="offsets of a first start")
        j.add_argument("--per-trigger", type=int, help="files or offsets a micro-batch")
        j.add_argument("--checkpoint", required=True)
        j.add_argument("--out", required=True, help="root of the tables, or folder of the alerts")
        j.add_argument("--once", action="store_true", help="take what is there and end")
        j.add_argument("--interval", default="1 second", help="between micro-batches")
        j.add_argument("--failures", type=int, default=3, help="failures in a row after which the job is given up")
    jobs.choices["storage"].add_argument("--window", type=int, default=4096, help="sequence numbers that dedup remembers, a power of two")
    a = jobs.choices["alerts"]
    a.add_argument("--odd-bounds", required=True, type=parse_bounds, help="place=minLat,maxLat,minLon,maxLon, separated by semicolons")
    a.add_argument("--sustained-ms", type=int, default=30_000)
    a.add_argument("--stop-ms", type=int, default=30_000)
    a.add_argument("--stale-ms", type=int, default=5_000)
    return p


def records(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.path:
        return files.file_stream(spark, a.path, a.per_trigger or 1)
    return files.broker_stream(spark, a.bootstrap, a.topic, a.group, a.starting, a.per_trigger)


def start(spark: SparkSession, arguments: Sequence[str]) -> StreamingQuery:
    a = parser().parse_args(arguments)
    trigger = {"availableNow": True} if a.once else {"processingTime": a.interval}
    if a.job == "storage":
        return pipelines.storage_job(records(spark, a), a.out, a.checkpoint, a.window, **trigger)
    options = {"sustained_ms": a.sustained_ms, "stop_ms": a.stop_ms, "stale_ms": a.stale_ms}
    return pipelines.alert_job(records(spark, a), a.odd_bounds, a.out, a.checkpoint, timers=not a.once, trigger=trigger, **options)


if __name__ == "__main__":
    import sys

    spark = session("roadpulse")
    supervised(lambda: start(spark, sys.argv[1:]), parser().parse_args(sys.argv[1:]).failures)
