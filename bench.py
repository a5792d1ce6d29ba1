"""Times the headline queries and the storage job, and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each query runs once over the
smallest tables first, so that what is timed is work and not compilation.
"""

import json
import os
import shutil
import sys
import tempfile
import time

os.chdir(os.path.dirname(os.path.abspath(__file__)))

from roadpulse.plans import catalog, extracts, ingest, registry  # noqa: E402, F401
from roadpulse.plans.testbed import Testbed  # noqa: E402
from roadpulse.session import session  # noqa: E402
from roadpulse.sources import files  # noqa: E402
from roadpulse.streaming import pipelines  # noqa: E402

HEADLINE = [
    "fleet_roster", "signals_final", "dup_pressure", "vehicle_progress", "layer_counts", "signal_window", "keyframe_agg", "clip_catalog", "enu_to_wgs84", "box_footprint", "envelope_check", "validate_box",
    "dlq_by_class", "dedup_verdicts", "dedup_loss", "nearest_asof", "interval_overlap", "coverage_missing", "seq_gaps", "last_n_trail", "channel_profile", "tag_rules", "percentile_floor", "odd_transitions",
    "stop_runs", "active_alerts", "stream_dedup", "stream_monitor", "storage_by_kind", "dedup_routed", "wire_frames", "linked_walk",
]
SMALL = "/root/testdata/sf0.001"


def timed(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def storage(spark, sf_dir: str) -> dict:
    """The storage job over a stream of files: records a second, and whether every record that was sent is stored or dead."""
    root = tempfile.mkdtemp()
    try:
        ingest._signals(Testbed(spark, sf_dir)).repartition(8).write.parquet(f"{root}/in")
        sent = spark.read.parquet(f"{root}/in").count()
        began = time.perf_counter()
        job = pipelines.storage_job(files.file_stream(spark, f"{root}/in", 8), f"{root}/out", f"{root}/checkpoint", availableNow=True)
        job.awaitTermination()
        took = time.perf_counter() - began
        held = sum(spark.read.parquet(f"{root}/out/{n}").count() for n in ("signals", "dead_letters"))
        return {"seconds": round(took, 3), "records_per_sec": round(sent / took), "sent": sent, "stored_or_dead": held, "kept_all": held == sent}
    finally:
        shutil.rmtree(root, ignore_errors=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(SMALL) and os.path.abspath(SMALL) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            timed(spark, name, SMALL)
    took = {name: round(timed(spark, name, sf_dir), 3) for name in HEADLINE}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {n: round(events / took[n]) for n in ("signals_final", "dedup_verdicts", "stream_dedup", "stream_monitor")}
    out = {
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "events_per_sec": rates, "storage_job": storage(spark, sf_dir),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(out))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
