"""Batches that are repeated, and jobs that end between any two steps, store every row once."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException

from roadpulse.sources import files
from roadpulse.streaming import ledger, pipelines
from roadpulse.streaming.ledger import Ledger, supervised

from .test_machines import box, clip, record, table

TABLES = ("signals", "perception", "segments", "dead_letters")


class Stopped(Exception):
    pass


def test_a_batch_may_end_anywhere(spark, tmp_path, monkeypatch):
    """Every single step of a commit fails once; after the repeat each table holds the batch once."""
    steps = {"n": 0, "stop": None}

    def step():
        steps["n"] += 1
        if steps["n"] == steps["stop"]:
            raise Stopped

    def write(staged):
        for k, name in enumerate("ab"):
            step()
            spark.range(k * 10, k * 10 + 10, 1, 2).write.mode("append").parquet(f"{staged}/{name}")
            step()

    move, drop = Ledger._move, Ledger._drop
    monkeypatch.setattr(Ledger, "_move", lambda self, at, to: (step(), move(self, at, to), step()))
    monkeypatch.setattr(Ledger, "_drop", lambda self, place: (step(), drop(self, place)))
    stop, done = 1, False
    while not done:
        root = str(tmp_path / str(stop))
        account = Ledger(spark, root, "q")
        account.commit(0, write) if stop == 1 else None
        steps |= {"n": 0, "stop": stop}
        try:
            account.commit(7, write)
            done = True
        except Stopped:
            steps["stop"] = None
            again = account.commit(7, write)
            assert again or account.has(7)
        steps["stop"] = None
        assert account.commit(7, write) is False
        for k, name in enumerate("ab"):
            got = sorted(r[0] for r in spark.read.parquet(f"{root}/{name}").collect())
            assert got == sorted(list(range(k * 10, k * 10 + 10)) * (2 if stop == 1 else 1))
        stop += 1
    assert stop > 12
    assert Ledger(spark, root, "other").commit(7, write) and spark.read.parquet(f"{root}/a").count() == 20


def source(spark, tmp_path, n=60):
    rows = [record(i, i, "pose", 1, {"a": 1.0}) for i in range(n)] + [box(n), clip(n + 1), record(n + 2, n + 2, "pose", 1, {}, broken=True)] + [record(n + 3 + i, i, "pose", 1, {}) for i in range(5)]
    for k in range(4):
        table(spark, rows[k::4]).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    return lambda: files.file_stream(spark, str(tmp_path / "in" / "*"), 1)


def stored(spark, out):
    return {n: sorted(str(r) for r in spark.read.parquet(f"{out}/{n}").drop("ingest_time", "failed_at").collect()) for n in TABLES}


def test_a_job_that_dies_between_appends(spark, tmp_path, monkeypatch):
    """Killed after two of four tables, then between two moves, then before the ledger's entry: the tables are those of an undisturbed run."""
    read = source(spark, tmp_path)
    start = lambda name: pipelines.storage_job(read(), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"), availableNow=True)
    assert start("plain").awaitTermination(120)
    left = {"letters": 1, "moves": 2, "entry": 1}

    def failing(what, f):
        def run(*a):
            if what == "moves" and left[what] == 2:
                left[what] = 1
                return f(*a)
            if left[what]:
                left[what] = 0
                raise OSError(f"outage at {what}")
            return f(*a)

        return run

    monkeypatch.setattr(pipelines, "dead_letters", failing("letters", pipelines.dead_letters))
    monkeypatch.setattr(Ledger, "_move", failing("moves", Ledger._move))
    monkeypatch.setattr(Ledger, "_entry", failing("entry", Ledger._entry))
    told = []
    assert supervised(lambda: start("hurt"), tolerated=3, pause_s=0.1, on_failure=told.append) == 3 == len(told)
    assert stored(spark, tmp_path / "hurt") == stored(spark, tmp_path / "plain")
    assert len(os.listdir(tmp_path / "hurt" / "_ledger" / os.listdir(tmp_path / "hurt" / "_ledger")[0])) >= 4
    assert not [f for _, _, fs in os.walk(tmp_path / "hurt" / "_staged") for f in fs if f.endswith(".parquet")]


def test_the_failure_budget(spark, tmp_path, monkeypatch):
    """An outage of the sink that lasts is given up after the tolerated failures; when it ends, nothing is missing."""
    read = source(spark, tmp_path, 8)
    start = lambda: pipelines.storage_job(read(), str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True)
    write, tries = pipelines.write_batch, []

    def down(batch, root):
        tries.append(root)
        raise OSError("sink is down")

    monkeypatch.setattr(pipelines, "write_batch", down)
    with pytest.raises(StreamingQueryException):
        supervised(start, tolerated=3, pause_s=0.1)
    assert len(tries) == 4 and len(set(tries)) == 1
    monkeypatch.setattr(pipelines, "write_batch", write)
    assert supervised(start, pause_s=0.1) == 0
    assert {n: len(r) for n, r in stored(spark, tmp_path / "out").items()} == {"signals": 8, "perception": 1, "segments": 1, "dead_letters": 1}
    query = json.loads((tmp_path / "checkpoint" / "metadata").read_text())["id"]
    assert ledger.Ledger.of_checkpoint(spark, str(tmp_path / "out"), str(tmp_path / "checkpoint")).query == query
