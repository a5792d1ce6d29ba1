"""Scans in two levels give what windows over whole keys give, and cut a busy key evenly."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import dedup, joins, marks, sequences
from roadpulse.operators.scans import Running, dealt, following, previous, running


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_every_kind_of_running_value(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.randrange(40), i, rng.choice([None, *range(-5, 6)])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    whole = F.struct("v", "i")
    for peers in (False, True):
        kinds = {f"{how}{strict}{back}": Running(how, F.col("v") if how == "sum" else whole, strict, peers, back) for how in ("sum", "min", "max") for strict in (False, True) for back in (False, True)}
        order = ["t"] if peers else ["t", "i"]
        assert rows_of(running(df, ["k"], order, kinds, ranges)) == rows_of(running(df, ["k"], order, kinds))
    near = {"before": previous(["t", "i"], "v"), "after": following(["t", "i"], "v")}
    got = running(df, ["k"], ["t", "i"], near, ranges).selectExpr("k", "i", "before.value as b", "after.value as a", "before is null as first", "after is null as last")
    want = spark.sql("select k, i, lag(v) over w as b, lead(v) over w as a, lag(i) over w is null as first, lead(i) over w is null as last from {df} window w as (partition by k order by t, i)", df=df)
    assert rows_of(got) == rows_of(want)
    assert running(df.where("false"), ["k"], ["t"], {"s": Running("sum", F.col("v"))}, ranges).count() == 0


def test_operators_in_ranges(spark):
    rng = random.Random(2)
    samples = spark.createDataFrame([(rng.choice("ab"), rng.randrange(300), i) for i in range(400)], "k string, t long, id long")
    probes = spark.createDataFrame([(rng.choice("abc"), rng.randrange(300), i) for i in range(400)], "k string, t long, id long")
    assert rows_of(joins.nearest_asof(probes, samples, ["k"], "t", ["id"], "id", 9)) == rows_of(joins.nearest_asof(probes, samples, ["k"], "t", ["id"], "id"))
    arrivals = spark.createDataFrame([(rng.choice("aab"), f"b{o // 150}", max(0, o % 150 + rng.randrange(-40, 5)), o) for o in range(900)], "dedup_key string, boot_id string, seq long, offset long")
    one, two = dedup.verdicts(arrivals, window=16), dedup.verdicts(arrivals, window=16, ranges=11)
    order = ["dedup_key", "boot_id", "seq", "offset", "run", "verdict"]
    assert rows_of(one.select(order)) == rows_of(two.select(order))
    assert rows_of(dedup.loss(one, window=16)) == rows_of(dedup.loss(two, window=16, ranges=7))
    spans = spark.createDataFrame([("r", 0, 5000, a, a + rng.randrange(1, 30)) for a in rng.choices(range(-20, 5000), k=300)], "r string, s long, e long, a long, b long").where("b > s and a < e")
    covered = joins.coverage(spans, ["r"], "s", "e", "a", "b")
    assert rows_of(joins.coverage(spans, ["r"], "s", "e", "a", "b", 8)) == rows_of(covered)
    asked = spark.createDataFrame([("r", 0, 5000), ("none", 3, 9)], "r string, s long, e long")
    assert rows_of(joins.missing(asked, covered, ["r"], "s", "e", 8)) == rows_of(joins.missing(asked, covered, ["r"], "s", "e"))
    sizes = spark.createDataFrame([(rng.choice("ab"), rng.randrange(90), i, rng.randrange(9), i % 11 == 0) for i in range(500)], "k string, t long, i long, size long, pin boolean")
    for budget in (0, 400, 10**6):
        assert rows_of(sequences.ring_budget(sizes, ["k"], ["t", "i"], "size", budget, "pin", 6)) == rows_of(sequences.ring_budget(sizes, ["k"], ["t", "i"], "size", budget, "pin"))


def test_one_busy_key_is_cut_evenly(spark):
    """Half a million rows of one key, most of them in a hundredth of its time: no range holds three times the median."""
    df = spark.range(500_000).selectExpr("'v' as k", "if(id % 10 < 8, 10000000 + id div 10, id * 40) as t", "id as v")
    sizes = [r["count"] for r in dealt(df, ["k"], ["t", "v"], 32).groupBy("_range").count().collect()]
    assert len(sizes) == 32 and max(sizes) <= 3 * median(sizes)
    got = running(df, ["k"], ["t", "v"], {"s": Running("sum", F.col("v"))}, 32).agg(F.max("s"), F.count(F.lit(1))).first()
    assert tuple(got) == (500_000 * 499_999 // 2, 500_000)


def test_marks_in_ranges(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randrange(500), i) for i in range(400)], "k string, t long, i long")
    assert rows_of(marks.backward_time(df, "k", "t", ["i"], 7)) == rows_of(marks.backward_time(df, "k", "t", ["i"]))
    states = [*marks.STEPS["UPLOADING"], "LEASED", "OTHER", None]
    log = spark.createDataFrame([(rng.randrange(3), i, rng.choice(states), rng.choice([None, i // 20, i // 20 - 1])) for i in range(300)], "job_id long, offset long, state string, token long")
    order = ["job_id", "offset", "state", "token", "fenced", "before", "legal"]
    assert rows_of(marks.upload_log(log, ranges=9).select(order)) == rows_of(marks.upload_log(log).select(order))


def test_upload_steps(spark):
    """A worker whose lease is over changes nothing; a step that isn't in the table is told."""
    rows = [("REQUESTED", None), ("LEASED", 1), ("LEASED", 2), ("UPLOADING", 1), ("UPLOADING", 2), ("UPLOADED", 2), ("FAILED", 2)]
    log = marks.upload_log(spark.createDataFrame([(7, i, s, t) for i, (s, t) in enumerate(rows)], "job_id long, offset long, state string, token long"))
    got = [(r["before"], r["fenced"], r["legal"]) for r in log.orderBy("offset").collect()]
    assert got == [("", False, True), ("REQUESTED", False, True), ("LEASED", False, True), ("LEASED", True, None), ("LEASED", False, True), ("UPLOADING", False, True), ("UPLOADED", False, False)]
    assert tuple(marks.upload_states(log).first()) == (7, "FAILED", 2, 1, 1)


def test_counters_of_any_split(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(99), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, size long")
    whole = rows_of(marks.merged(marks.deltas(df, ["k"], "t", F.col("size")), ["k"]))
    for n in (1, 7, 300):
        parts = marks.deltas(df.withColumn("batch", F.expr(f"size % {n}")), ["batch", "k"], "t", F.col("size"))
        assert rows_of(marks.merged(parts, ["k"])) == whole == rows_of(marks.merged(marks.merged(parts, ["k", "batch"]).drop("batch"), ["k"]))


def test_sensor_masks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b"), (2, "a"), (2, "a"), (3, None), (3, "z")], "frame long, sensor string")
    got = {r["frame"]: (r["sensors"], r["wanting"], r["complete"]) for r in marks.sensor_mask(df, ["frame"], "sensor", ["a", "b", "c"], ["a", "b"]).collect()}
    assert got == {1: (5, 2, False), 2: (3, 0, True), 3: (0, 3, False)}
    with pytest.raises(ValueError):
        marks.sensor_mask(df, ["frame"], "sensor", ["a", "a"], [])
