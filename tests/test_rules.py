"""Edge semantics that a plain translation would miss."""

import hashlib
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from roadpulse.functions import geo, text
from roadpulse.operators import aggregates, dedup, joins, latest, sequences, validate

NAN = float("nan")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def quaternion(spark, q):
    df = spark.createDataFrame([({"vehicle_speed": 0.0}, {"rotation": q})], "values_num map<string,double>, values_vec map<string,array<double>>")
    return df.select(validate.signal_error().alias("e")).first()["e"]


@pytest.mark.parametrize("speed, bad", [(-1.0, True), (0.0, False), (NAN, False)])
def test_speed_rule(spark, speed, bad):
    df = spark.createDataFrame([({"vehicle_speed": speed}, {})], "values_num map<string,double>, values_vec map<string,array<double>>")
    assert (df.select(validate.signal_error().alias("e")).first()["e"] is not None) == bad


def test_quaternion_rule(spark):
    assert quaternion(spark, [1.0, 1.0, 1.0, 1.0])
    assert quaternion(spark, [1.0, 0.0, 0.0, 0.0]) is None
    assert quaternion(spark, [0.5720320396729045, -0.0016977771610471074, 0.011798001930183783, -0.8201446642457809]) is None
    assert quaternion(spark, [NAN, 0.0, 0.0, 0.0]) is None
    assert quaternion(spark, [9.0, 0.0, 0.0]) is None
    assert quaternion(spark, [1.0, None, 0.0, 0.0])


@pytest.mark.parametrize("size, bad", [(0.0, True), (NAN, True), (None, True), (2.0, False)])
def test_box_rule(spark, size, bad):
    df = spark.createDataFrame([(size, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)], "size_w double, size_l double, size_h double, rot_w double, rot_x double, rot_y double, rot_z double")
    assert (df.select(validate.box_error().alias("e")).first()["e"] is not None) == bad


def test_rounding_and_clamp(spark):
    r = one(spark, a=geo.round_half_up(F.lit(-1.23455)), b=geo.yaw_approx(F.lit(1.5)), c=geo.yaw_approx(F.lit(NAN)))
    assert r["a"] == -1.2345 and r["b"] == math.pi and math.isnan(r["c"])


def test_millis_are_boundaries(spark):
    r = one(spark, d=text.millis_between(F.timestamp_micros(F.lit(999)), F.timestamp_micros(F.lit(1001))))
    assert r["d"] == 1


@pytest.mark.parametrize("place", geo.ORIGINS)
def test_round_trip(spark, place):
    points = [(0.0, 0.0), (500.0, 1200.0), (1935.3, 870.2), (-30.0, 42.5)]
    df = spark.createDataFrame(points, "x double, y double").withColumn("p", geo.enu_to_wgs84(F.col("x"), F.col("y"), F.lit(place)))
    for r in df.withColumn("q", geo.wgs84_to_enu(F.col("p.lat"), F.col("p.lon"), F.lit(place))).collect():
        assert math.hypot(r["q"]["x"] - r["x"], r["q"]["y"] - r["y"]) < 1e-2


def test_unknown_place_is_null(spark):
    p = one(spark, p=geo.enu_to_wgs84(F.lit(1.0), F.lit(2.0), F.lit("nowhere")))["p"]
    assert p["lat"] is None and p["lon"] is None


@pytest.mark.parametrize("spec", ["", "a=1,2,3", "a=2,1,3,4", "a=1,95,3,4", "a=1,2,3,4;a=1,2,3,4", "a=x,2,3,4"])
def test_bad_bounds(spec):
    with pytest.raises(ValueError):
        geo.parse_bounds(spec)


def test_bounds():
    assert geo.parse_bounds("a=1,2,3,4; b=-1,1,-2,2") == {"a": (1, 2, 3, 4), "b": (-1, 1, -2, 2)}


def test_tags(spark):
    df = spark.createDataFrame([("Night, after rain, peds",), ("Heavy rain, turn",), ("Rainy day, parking  lot",)], "d string")
    assert [r["t"] for r in df.select(text.tags(F.col("d")).alias("t")).collect()] == [["after_rain", "night", "peds"], ["day_inferred", "rain", "turn"], ["day_inferred", "parked", "rain"]]


def test_uuid5(spark):
    space = uuid.NAMESPACE_URL
    r = one(spark, u=text.uuid5(F.lit(str(space)), F.lit("v1/b1")))
    assert r["u"] == str(uuid.uuid5(space, "v1/b1"))


def test_keys_and_identities(spark):
    r = one(
        spark, a=text.object_key("p", F.lit("v1"), F.timestamp_micros(F.lit(0)), F.lit("c1")), b=text.object_key("p", F.lit("v/1"), F.timestamp_micros(F.lit(0)), F.lit("c1")),
        c=text.spiffe_vehicle(F.array(F.lit("spiffe://fleet/vehicle/v7"), F.lit("https://x"))), d=text.spiffe_vehicle(F.array(F.lit("spiffe://f/vehicle/a"), F.lit("spiffe://f/vehicle/b"))),
        e=text.frame_digest(F.lit(b"body"), b"M"),
    )
    assert (r["a"], r["b"], r["c"], r["d"]) == ("p/vehicle_id=v1/date=1970-01-01/c1.mcap", None, "v7", None)
    assert r["e"] == hashlib.sha256(b"Mbody").hexdigest()


def headers(**h):
    return [(k, v.encode()) for k, v in h.items()]


def test_envelope(spark):
    ident = {"vehicle_id": "v", "boot_id": "b", "seq": "1", "kind": "RECORD_KIND_SIGNAL"}
    mqtt = ident | {"stream_id": "status", "source_boot_id": "s", "report_interval_ms": "500"}
    clip = ident | {"kind": "RECORD_KIND_SEGMENT_REF", "producer_origin": "clip-upload", "boot_id": "clip-one", "seq": "0"}
    cases = [
        (ident, b"v", None), (ident | {"vehicle_id": " "}, None, "missing"), (ident, b"w", "key"), (ident | {"seq": "x"}, None, "number"), (ident | {"seq": "-1"}, None, "negative"),
        (mqtt, None, None), (mqtt | {"stream_id": "other"}, None, "unknown"), (mqtt | {"report_interval_ms": "99"}, None, "interval"), ({k: v for k, v in mqtt.items() if k != "source_boot_id"}, None, "source_boot_id"),
        (clip, None, None), (clip | {"kind": "RECORD_KIND_SIGNAL"}, None, "clip"), (clip | {"boot_id": "other"}, None, "clip"), (clip | {"seq": "1"}, None, "clip"),
    ]
    df = spark.createDataFrame([(i, "t", 0, k, headers(**h)) for i, (h, k, _) in enumerate(cases)], "offset long, topic string, partition int, key binary, headers array<struct<key string, value binary>>")
    for r in validate.envelope(df).collect():
        want = cases[r["offset"]][2]
        assert (r["validation_error"] is None) if want is None else want in r["validation_error"], r
        assert (r["vehicle_id"] is None) == (want is not None)
    twice = spark.createDataFrame([(0, "t", 0, None, headers(**ident) + [("seq", b"9")])], df.schema)
    assert validate.envelope(twice).first()["seq"] == 9


def bitmap(records, window):
    """Independent restatement with sets: verdicts and, at the end, lost and contiguous."""
    boot, out = None, []
    for b, s in records:
        verdict = "ACCEPT"
        if b != boot:
            verdict = "ACCEPT" if boot is None else "BOOT_RESET"
            boot, last, seen, first = b, s - 1, set(), s
        if s > last:
            last = s
        elif s <= last - window:
            out.append("TOO_OLD")
            continue
        elif s in seen:
            out.append("DUPLICATE")
            continue
        else:
            verdict = "LATE"
        seen.add(s)
        out.append(verdict)
    lost = sum(n not in seen for n in range(first, last - window + 1))
    at = max(first - 1, last - window)
    while at + 1 in seen:
        at += 1
    return out, lost, at, last


@pytest.mark.parametrize("seed", range(4))
def test_dedup_closed_form(spark, seed):
    r = random.Random(seed)
    rows = []
    for v in range(20):
        seq, boot, offset = r.randrange(5), 0, 0
        for _ in range(80):
            if r.random() < 0.03:
                boot, seq = boot + r.choice([1, 1, -1]), r.randrange(4)
            seq += r.choice([1, 1, 1, 1, 2, 0, -1, -5, 30, -20])
            rows.append((f"v{v}", f"b{boot}", max(0, seq), offset))
            offset += 1
    df = spark.createDataFrame(rows, "k string, boot_id string, seq long, offset long")
    judged = dedup.verdicts(df, "k", window=16)
    got = {(x["k"], x["offset"]): x["verdict"] for x in judged.collect()}
    loss = {(x["k"], x["run"]): x for x in dedup.loss(judged, "k", window=16).collect()}
    for v in {x[0] for x in rows}:
        mine = [(b, s) for k, b, s, _ in rows if k == v]
        want, lost, at, last = bitmap(mine, 16)
        assert [got[v, i] for i in range(len(mine))] == want
        end = loss[v, max(run for k, run in loss if k == v)]
        assert (end["lost"], end["contiguous"], end["last_seen"]) == (lost, at, last)


@pytest.mark.parametrize("seqs, lost, contiguous, holes", [([0, 1000], 936, 936, 63), ([0, 500], 436, 436, 63), ([0, *range(2, 200)], 1, 199, 0), (list(range(200)), 0, 199, 0)])
def test_loss_vectors(spark, seqs, lost, contiguous, holes):
    df = spark.createDataFrame([("v", "b", s, i) for i, s in enumerate(seqs)], "k string, boot_id string, seq long, offset long")
    r = dedup.loss(dedup.verdicts(df, "k", window=64), "k", window=64).first()
    assert (r["lost"], r["contiguous"], r["pending_holes"]) == (lost, contiguous, holes)


def test_window_must_be_power_of_two():
    for w in (0, 100):
        with pytest.raises(ValueError):
            dedup.check_window(w)


def test_nearest_asof(spark):
    r = random.Random(5)
    probes = [("v", r.randrange(40), i) for i in range(60)]
    samples = [("v", r.randrange(0, 40, 3), i) for i in range(25)]
    p, s = spark.createDataFrame(probes, "k string, t long, id long"), spark.createDataFrame(samples, "k string, t long, id long")
    got = {x["id"]: (x["sample"]["t"], x["sample"]["id"]) for x in joins.nearest_asof(p, s, ["k"], "t", ["id"], "id").collect()}
    ordered = sorted((t, i) for _, t, i in samples)
    for _, t, i in probes:
        before = [x for x in ordered if x[0] < t]
        after = [x for x in ordered if x[0] >= t]
        want = after[0] if not before else before[-1] if not after or t - before[-1][0] <= after[0][0] - t else after[0]
        assert got[i] == want
    none = joins.nearest_asof(p, s.where("false"), ["k"], "t", ["id"], "id")
    assert none.where("sample is not null").count() == 0 and none.count() == 60


@pytest.mark.parametrize("files, request_, covered, gaps", [([(10, 20), (20, 30)], (0, 30), [(10, 30)], [(0, 10)]), ([(10, 20), (20, 30)], (10, 35), [(10, 30)], [(30, 35)]), ([(0, 10), (20, 30)], (0, 30), [(0, 10), (20, 30)], [(10, 20)]), ([], (0, 5), [], [(0, 5)])])
def test_coverage(spark, files, request_, covered, gaps):
    f = spark.createDataFrame([("v", a, b) for a, b in files], "v string, a long, b long")
    q = spark.createDataFrame([("v", "r", *request_)], "v string, r string, lo0 long, hi0 long")
    pairs = joins.interval_overlap(f, q, ["v"], 7, ("a", "b"), ("lo0", "hi0"))
    assert pairs.count() == len(files)
    c = joins.coverage(pairs, ["r"], "lo0", "hi0", "a", "b")
    assert sorted((x["lo"], x["hi"]) for x in c.collect()) == covered
    assert sorted((x["gap_start"], x["gap_end"]) for x in joins.missing(q, c, ["r"], "lo0", "hi0").collect()) == gaps


def test_tumbling(spark):
    df = spark.createDataFrame([(t,) for t in (150000, 199999, 200000, -1)], "t long").select(sequences.tumbling(F.col("t")).alias("w"))
    assert [r["w"] for r in df.collect()] == [100000, 100000, 200000, -100000]
    with pytest.raises(ValueError):
        sequences.tumbling(F.col("t"), 0)


def test_roster_fixture(spark):
    start = 1_793_059_200_123_456
    rows = [(1, 0, 1.5, 0.0, 103.0), (3, 1_000_000, 2.5, 1.0, 104.0), (3, 1_000_000, 2.5, 1.0, 104.0), (5, 500_000, None, 2.0, 105.0)]
    df = spark.createDataFrame([("v1", "b", s, "scene", start + t, {"location": "test"}, lat, lon) for s, t, _, lat, lon in rows], "vehicle_id string, boot_id string, seq long, scene_id string, t long, values_str map<string,string>, lat double, lon double")
    df = df.withColumn("sensor_time", F.timestamp_micros("t")).withColumn("ingest_time", F.timestamp_micros("t"))
    r = aggregates.fleet_roster(latest.final_view(df)).first()
    assert (r["n_records"], r["recorded_ms"], r["home"], r["location"]) == (3, 1000, [1.0, 104.0], "test")
    assert aggregates.vehicle_progress(latest.final_view(df)).first()["missing"] == 2
    empty = df.where("false")
    assert aggregates.fleet_roster(empty).count() == 0
    assert aggregates.layer_counts({"signals": empty}).first()["signals"] == 0


def test_final_view_filters_after(spark):
    df = spark.createDataFrame([("v", "b", 1, 10, 1), ("v", "b", 1, 20, 2)], "vehicle_id string, boot_id string, seq long, t long, ingest_time long")
    assert latest.final_view(df).where("t = 10").count() == 0


def test_clip_limit(spark):
    with pytest.raises(ValueError):
        aggregates.clips(spark.range(1), 0)


def test_active_alerts(spark):
    def active(kinds):
        df = spark.createDataFrame([(i, "v", k, n) for n, (i, k) in enumerate(kinds)], "event_id string, vehicle_id string, type string, offset long")
        return {r["family"] for r in sequences.active_alerts(df).collect()}

    assert active([("1", "SENSOR_FAULT"), ("2", "TELEMETRY_STALE"), ("3", "TELEMETRY_RECOVERED")]) == {"sensor"}
    assert active([("1", "ODD_EXITED"), ("2", "ODD_RETURNED"), ("1", "ODD_EXITED")]) == set()


def test_filters_reach_the_scan(spark):
    from roadpulse.plans.testbed import Testbed

    plan = Testbed(spark, "/root/testdata/sf0.001").table("events").where("event_id > 5").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,5)]" in plan and "ReadSchema: struct<event_id:bigint>" in plan
