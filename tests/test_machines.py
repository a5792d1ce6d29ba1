"""The state machines on the vectors of their contract, and the same machines over tables and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from roadpulse import jobs, schemas
from roadpulse.plans.replay import AlertHub, Replay
from roadpulse.sources import avro, files
from roadpulse.streaming import machines as M
from roadpulse.streaming import pipelines
from roadpulse.streaming.runner import over_table


def run(machine, rows, close=None):
    out = [e for r in rows for e in machine.step(r)]
    return out + (machine.advance(close) if close is not None else [])


def kinds(events):
    return [e["type"] for e in events]


def status(seq, t, now=None, speed=0.0, planned=0.0, healthy=1.0, **more):
    return {"vehicle_id": "v", "boot_id": "b", "seq": seq, "event_ms": t, "received_ms": t if now is None else now, "speed": speed, "mission_active": 1.0, "planned_stop": planned, "sensor_healthy": healthy, "mission_id": "m"} | more


@pytest.mark.parametrize("records, verdicts, last, base, lost", [
    ([("a", s) for s in range(200)], None, 199, 199, 0),
    ([("a", s) for s in (0, 1, 1, 1, 0)], "A A D D D", 1, 1, 0),
    ([("a", s) for s in (0, 5, 3, 3, 1, 2)], "A A L D L L", 5, 3, 0),
    ([("a", s) for s in [*range(200), 10]], None, 199, 199, 0),
    ([("a", s) for s in [0, *range(2, 200)]], None, 199, 199, 1),
    ([("a", 0), ("a", 1000)], "A A", 1000, 936, 936),
    ([("a", s) for s in range(100)] + [("b", 0), ("b", 1)], None, 1, 1, 0),
])
def test_sequence_window(records, verdicts, last, base, lost):
    m = M.SequenceWindow(window=64)
    got = [m.verdict(b, s) for b, s in records]
    if verdicts:
        assert [v[0] for v in got] == verdicts.split()
    assert (m.state["last"], m.state["base"], m.state["lost"]) == (last, base, lost)
    assert len(json.dumps(m.freeze())) < 200


def test_sequence_window_edges():
    assert M.SequenceWindow(window=64).verdict("a", 5) == "ACCEPT"
    m = M.SequenceWindow(window=64)
    assert [m.verdict(*x) for x in [("a", s) for s in range(200)] + [("a", 10)]][-1] == "TOO_OLD"
    assert [m.verdict("b", 0), m.verdict("b", 1)] == ["BOOT_RESET", "ACCEPT"]
    for w in (0, 100):
        with pytest.raises(ValueError):
            M.SequenceWindow(window=w)


def test_stop():
    def case(speed, planned):
        m = M.VehicleMonitor(stop_ms=3000, stale_ms=2000)
        return kinds(run(m, [status(i, 1000 * i, speed=speed, planned=planned) for i in range(1, 6)])), m

    assert case(3.0, 0.0)[0] == [] and case(0.0, 1.0)[0] == []
    found, m = case(0.0, 0.0)
    assert found == ["UNPLANNED_STOP"]
    assert kinds(m.step(status(6, 6000, speed=2.0))) == ["STOP_CLEARED"]


def test_stale_and_recovery():
    m = M.VehicleMonitor(stop_ms=3000, stale_ms=2000)
    assert kinds(run(m, [status(1, 1000, speed=3.0), status(2, 900, 2500, speed=3.0)], 6000)) == ["TELEMETRY_STALE"]
    assert kinds(m.step(status(3, 7000, speed=3.0))) == ["TELEMETRY_RECOVERED"]


def test_sensor():
    m = M.VehicleMonitor(stop_ms=3000, stale_ms=2000)
    rows = [status(1, 1000, 0, 9.0, healthy=0.0), status(2, 2000, 0, 9.0, healthy=0.0), status(3, 3000, 0, 9.0), status(4, 4000, 1500, float("nan"))]
    assert kinds(run(m, rows, 3000)) == ["SENSOR_FAULT", "SENSOR_RECOVERED", "TELEMETRY_STALE"]


def test_gap_breaks_a_stop():
    assert kinds(run(M.VehicleMonitor(stop_ms=3000, stale_ms=2000), [status(1, 1000, 0), status(2, 10000, 0), status(3, 11000, 0)])) == []


def test_restore():
    m = M.VehicleMonitor(stop_ms=3000, stale_ms=2000)
    run(m, [status(1, 1000), status(2, 2000)])
    again = M.VehicleMonitor(json.loads(json.dumps(m.freeze())), stop_ms=3000, stale_ms=2000)
    assert kinds(run(again, [status(i, 1000 * i) for i in (3, 4, 5)])) == ["UNPLANNED_STOP"]


def pose(t, lat, lon, now=None, place="test-map"):
    return {"vehicle_id": "v", "boot_id": "b", "seq": t, "event_ms": t, "received_ms": t if now is None else now, "location": place, "lat": lat, "lon": lon}


def area():
    return M.AreaMonitor(bounds={"test-map": (1, 2, 3, 4)})


def test_area():
    m = area()
    assert kinds(run(m, [pose(1000, 1.5, 3.5), pose(2000, 2.1, 3.5), pose(3000, 2.2, 3.5)])) == ["ODD_EXITED"]
    later = run(m, [pose(1000 * i, 2.2, 3.5) for i in range(4, 33)])
    assert kinds(later) == ["ODD_SUSTAINED"] and later[0]["detected_ms"] == 32000
    assert kinds(m.step(pose(33000, 1.5, 3.5))) == ["ODD_RETURNED"]


def test_area_late_silent_unknown():
    m = area()
    assert kinds(run(m, [pose(3000, 2.5, 3.5), pose(2000, 1.5, 3.5, 3100)])) == ["ODD_EXITED"]
    assert kinds(run(area(), [pose(1000, 2.5, 3.5)], 40_000)) == ["ODD_EXITED"]
    assert run(area(), [pose(1000, 2.5, 3.5, place="x"), pose(1000, None, 3.5)]) == []


def sample(t, v=1.0, channel="ego_pose", **more):
    return {"vehicle_id": "v", "channel": channel, "received_ms": t, "event_us": t * 1000, "values_num": {"speed": v}, "values_str": {}} | more


def test_sampling():
    m = M.SamplingPolicy(normal_ms=1000, min_ms=200, thresholds={"speed": 1.0})
    got = [bool(m.step(r)) for r in (sample(1000), sample(1100, 1.1), sample(1300, 3.0), sample(2300, 3.0), sample(2300, channel="other"))]
    assert got == [True, False, True, True, False]


def test_anomaly_episodes():
    m = M.SamplingPolicy()
    a, b, c = (m.step(sample(t, anomaly=True))[0] for t in (1000, 5000, 40_000))
    assert a["history_from_ms"] == -29_000 and b["history_from_ms"] is None
    assert a["episode"] == b["episode"] == 1_000_000 and c["episode"] == 40_000_000


def test_debounce_compares_with_the_newest_kept():
    e = lambda i, t, kind="k": {"id": str(i), "t": t, "vehicle_id": "v", "kind": kind}
    got = run(M.Debounce(), [e(1, 0), e(2, 400), e(3, 600), e(4, 700, "x"), e(5, 800), e(5, 9000)])
    assert [x["id"] for x in got] == ["1", "3", "4", "5"]


def test_greedy_cut_and_ack():
    rows = [{"key": "k", "t": t, "size": s} for t, s in ((0, 5), (1, 5), (2, 1), (9, 1), (30, 1))]
    assert [e["group"] for e in run(M.GreedyCut(span=10, budget=10), rows)] == [0, 0, 1, 1, 2]
    ack = M.AckTracker(every=2, every_ms=1000)
    assert [e["ack"] for e in run(ack, [{"key": "k", "seq": s, "at_ms": 0} for s in (1, 0, 3, 2, 0)])] == [1, 3]
    ack = M.AckTracker(every=100, every_ms=1000)
    assert run(ack, [{"key": "k", "seq": s, "at_ms": 0} for s in (0, 1, 5)]) == [] and ack.advance(999) == []
    assert [e["ack"] for e in ack.advance(1000)] == [1] and ack.advance(5000) == []
    assert run(ack, [{"key": "k", "seq": 2, "at_ms": 1001}]) == [] and [e["ack"] for e in ack.drain(1002)] == [2] and ack.drain(1003) == []


def test_table_runner_orders_rows(spark):
    rows = [(f"v{v}", "b", s, o) for v in range(5) for o, s in enumerate((0, 5, 3, 3, 1, 2))]
    df = spark.createDataFrame(rows[::-1], "vehicle_id string, boot_id string, seq long, offset long")
    got = over_table(df, M.SequenceWindow, "vehicle_id", ["offset"], window=64)
    assert {r["verdict"]: r["count"] for r in got.groupBy("verdict").count().collect()} == {"ACCEPT": 10, "DUPLICATE": 5, "LATE": 15}


def record(offset, seq, channel, t_ms, nums, place="boston-seaport", xy=(0.0, 0.0), broken=False, kind="SIGNAL", value=None, **more):
    if value is None:
        value = avro.encode({"record": avro.SIGNAL}, {"scene_id": "s", "channel": channel, "sensor_time": t_ms * 1000, "log_time": t_ms * 1000, "values_num": nums, "values_vec": {"translation": [*xy, 0.0]}, "values_str": {"location": place, "mission_id": "m"}})
    headers = [(k, str(v).encode()) for k, v in ({"vehicle_id": "v", "boot_id": "b", "seq": seq, "kind": f"RECORD_KIND_{kind}"} | more).items()]
    return ("telemetry.records", 0, offset, b"v", value[:5] if broken else value, headers, t_ms)


def box(seq, **more):
    v = {n: 1.0 for n, t in avro.PERCEPTION if t == "double"} | {n: "x" for n, t in avro.PERCEPTION if t == "string"} | {"sensor_time": 5_000_000, "attribute": None, "rot_x": 0.0, "rot_y": 0.0, "rot_z": 0.0, "num_lidar_pts": 0, "num_radar_pts": 3}
    return record(seq, seq, "", 1, {}, kind="PERCEPTION", value=avro.encode({"record": avro.PERCEPTION}, v | more))


def clip(seq, **more):
    v = {"segment_id": f"seg{seq}", "scene_id": None, "blob_uri": "s3://x", "t_start": 1_000_000, "t_end": 2_000_000, "sensor_channels": ["CAM_FRONT"], "size_bytes": 5, "checksum": "a" * 64, "sample_count": 1, "state": "DROPPED", "drop_reason": "queue_full", "calibration": {"k": "{}"}}
    return record(seq, seq, "", 1, {}, kind="SEGMENT_REF", value=avro.encode({"record": avro.SEGMENT}, v | more))


def table(spark, rows):
    return spark.createDataFrame(rows, "topic string, partition int, offset long, key binary, value binary, headers array<struct<key string, value binary>>, t long").withColumn("timestamp", F.timestamp_millis("t")).drop("t")


def test_jobs_over_a_stream(spark, tmp_path):
    good = {"speed_mps": 0.0, "mission_active": 1.0, "planned_stop": 0.0, "sensor_healthy": 1.0}
    rows = [record(i, i, "fleet_status", 1000 * (i + 1), good) for i in range(6)]
    rows += [record(10 + i, 10 + i, "ego_pose", 1000 * (i + 1), {}, xy=(x, 10.0)) for i, x in enumerate((10.0, 5000.0, 10.0))]
    rows += [record(20, 20, "pose", 1, {"vehicle_speed": -1.0}), record(21, 21, "pose", 1, {}, broken=True), record(22, -1, "pose", 1, {})]
    rows += [box(30), box(31, size_w=0.0), clip(40), clip(41, size_bytes=0), record(42, 42, "", 1, {}, kind="OTHER"), record(43, 0, "", 1, {}, kind="SEGMENT_REF", value=clip(43)[4], boot_id="clip-1", producer_origin="clip-upload")]
    copies = [record(50, 5, "pose", 1, {}), box(30)[:2] + (51,) + box(30)[3:], record(52, 7000, "pose", 1, {}), record(53, 1, "pose", 1, {})]  # the last is too old
    late = [record(54 + k, s, "pose", 1, {}, boot_id="m", stream_id="status", source_boot_id="b", report_interval_ms=1000) for k, s in enumerate((7000, 1))]  # too old, of a named stream
    sent = rows + copies + late
    for k in range(2):
        table(spark, sent[k::2]).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = lambda: files.file_stream(spark, str(tmp_path / "in" / "*"), 10)
    bounds = {"boston-seaport": (42.3, 42.4, -71.06, -71.05)}
    jobs = [
        pipelines.storage_job(source(), str(tmp_path / "out"), str(tmp_path / "c1"), availableNow=True),
        pipelines.alert_job(source(), bounds, str(tmp_path / "alerts"), str(tmp_path / "c2"), timers=False, trigger={"availableNow": True}, stop_ms=3000, stale_ms=2000),
    ]
    for j in jobs:
        assert j.awaitTermination(120)
    read = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in ("signals", "perception", "segments", "dead_letters")}
    counts = {n: d.count() for n, d in read.items()}
    assert counts == {"signals": 12, "perception": 1, "segments": 2, "dead_letters": 6}
    assert sum(counts.values()) == len(sent) - 3  # two copies and one that is too old without a named stream
    assert read["signals"].where("channel = 'ego_pose' and lat is not null").count() == 3 and read["signals"].where("channel <> 'ego_pose' and lat is not null").isEmpty()
    assert [len(read[n].columns) for n in ("signals", "perception", "segments")] == [12 + 2, 24 + 2, 15 + 2]
    one = read["segments"].where("segment_id = 'seg40'").first()
    assert (one["scene_id"], one["state"], one["calibration"], one["sensor_channels"], one["t_end"].timestamp()) == (None, "DROPPED", {"k": "{}"}, ["CAM_FRONT"], 2.0)
    dead = {r["source_offset"]: (r["error_class"], r["error_step"], r["vehicle_id"]) for r in read["dead_letters"].collect()}
    assert dead == {
        20: ("BUSINESS_RULE_FAILURE", "validate-signal", "v"), 21: ("PARSE_FAILURE", "decode", "v"), 22: ("SCHEMA_VALIDATION_FAILURE", "envelope", None),
        31: ("BUSINESS_RULE_FAILURE", "validate-perception", "v"), 41: ("BUSINESS_RULE_FAILURE", "validate-segment", "v"), 42: ("SCHEMA_VALIDATION_FAILURE", "route", "v"),
    }
    assert {n for n, _ in (c.strip().split(" ", 1) for c in schemas.DEAD_LETTER.replace("struct<key string, value binary>", "x").split(","))} == set(read["dead_letters"].columns)
    packed = [avro.from_container(bytes(r["value"]), avro.DEAD_LETTER)[0] for r in pipelines.dead_letter_values(read["dead_letters"]).collect()]
    assert {(p["source_offset"], p["error_class"], p["pipeline_step"], p["vehicle_id"]) for p in packed} == {(o, c, s, v) for o, (c, s, v) in dead.items()}
    assert all(p["original_payload"] == sent_value and p["attempt"] == 1 for p in packed for sent_value in [next(r[4] for r in sent if r[2] == p["source_offset"])])
    alerts = files.alerts_from_json(spark.read.parquet(str(tmp_path / "alerts"))).collect()
    assert sorted(a["type"] for a in alerts) == ["ODD_EXITED", "ODD_RETURNED", "UNPLANNED_STOP"]
    assert all(a["event_id"] and a["vehicle_id"] == "v" and a["message"] for a in alerts) and {a["location"] for a in alerts} == {"boston-seaport", None}


def test_jobs_from_the_command_line(spark, tmp_path):
    good = {"speed_mps": 0.0, "mission_active": 1.0, "planned_stop": 0.0, "sensor_healthy": 1.0}
    table(spark, [record(i, i, "fleet_status", 1000 * (i + 1), good) for i in range(6)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    common = ["--path", str(tmp_path / "in"), "--once"]
    assert jobs.start(spark, ["storage", *common, "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "c1"), "--window", "64"]).awaitTermination(120)
    assert jobs.start(spark, ["alerts", *common, "--out", str(tmp_path / "alerts"), "--checkpoint", str(tmp_path / "c2"), "--odd-bounds", "boston-seaport=42,43,-72,-71", "--stop-ms", "3000", "--stale-ms", "2000"]).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "signals")).count() == 6
    assert [r["type"] for r in files.alerts_from_json(spark.read.parquet(str(tmp_path / "alerts"))).collect()] == ["UNPLANNED_STOP"]
    for bad in (["storage"], ["alerts", *common, "--out", "x", "--checkpoint", "y", "--odd-bounds", "z"], ["other"]):
        with pytest.raises(SystemExit):
            jobs.parser().parse_args(bad)


def test_dedup_stream(spark, tmp_path):
    rows = [record(o, s, "pose", 1, {}) for o, s in enumerate((0, 5, 3, 3, 1))]
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = pipelines.dedup_stream(files.file_stream(spark, str(tmp_path / "in")), 64).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["verdict"] for r in spark.table("verdicts").collect()) == ["ACCEPT", "ACCEPT", "DUPLICATE", "LATE", "LATE"]


def test_avro_round_trip_and_damage():
    v = {"scene_id": "é", "channel": "", "sensor_time": -5, "log_time": 2**62, "values_num": {"a": float("-inf")}, "values_vec": {"v": [1.0, 2.0], "w": []}, "values_str": {}}
    raw = avro.encode({"record": avro.SIGNAL}, v)
    assert avro.Reader(raw + b"more").value({"record": avro.SIGNAL}) == v
    for cut in range(len(raw)):
        with pytest.raises((ValueError, UnicodeDecodeError)):
            avro.Reader(raw[:cut]).value({"record": avro.SIGNAL})
    batch = {"vehicle_id": "v", "boot_id": "b", "stream": "event", "records": [{"seq": 1, "kind": "signal", "payload": b"\x00\xff", "report_interval_ms": 1000}]}
    assert avro.Reader(avro.encode({"record": avro.BATCH}, batch)).value({"record": avro.BATCH}) == batch


def damaged(rng, value):
    """Bytes changed, cut out, doubled, or made into long numbers."""
    value = bytearray(value)
    for _ in range(rng.randrange(1, 4)):
        at = rng.randrange(len(value))
        kind = rng.randrange(4)
        if kind == 0:
            value[at] = rng.randrange(256)
        elif kind == 1:
            del value[at : at + rng.randrange(1, 9)]
        elif kind == 2:
            value[at:at] = bytes([255] * rng.randrange(1, 10)) + bytes([rng.randrange(128)])
        else:
            value[at:at] = value[at : at + rng.randrange(1, 20)]
        if not value:
            value = bytearray(b"\0")
    return bytes(value)


def test_damaged_records_never_stop_a_batch():
    """100,000 damaged payloads of all kinds: each is a row or null, and what is sound beside them stays."""
    import pyarrow as pa

    rng = random.Random(4)
    kinds = {"signal": record(1, 1, "pose", 1, {"a": 1.0})[4], "perception": box(1)[4], "segment": clip(1)[4]}
    for name, value in kinds.items():
        fields, of = avro.KINDS[name], avro.arrow_type({"record": avro.KINDS[name]})
        sound = avro._read(value, fields)
        for _ in range(34):
            values = [damaged(rng, value) for _ in range(1000)]
            values[500] = value
            got = avro._column([avro._read(v, fields) for v in values], of)
            assert len(got) == 1000 and got[500].as_py() == pa.array([sound], of)[0].as_py()


def test_numbers_beyond_64_bits():
    for raw in (b"\xff" * 9 + b"\x02", b"\xff" * 9 + b"\x7f", b"\x80" * 10 + b"\0"):
        with pytest.raises(ValueError):
            avro.Reader(raw).number()
    assert [avro.Reader(b"\xff" * 9 + b"\x01").number(), avro.Reader(b"\xfe" + b"\xff" * 8 + b"\x01").number()] == [-(2**63), 2**63 - 1]
    # what Arrow itself refuses is null alone
    import pyarrow as pa

    assert avro._column([{"x": 1}, {"x": 2**70}, {"x": "y"}, {"x": 2}], pa.struct([("x", pa.int64())])).to_pylist() == [{"x": 1}, None, None, {"x": 2}]


def test_storage_job_over_damaged_records(spark, tmp_path):
    """Every damaged record ends as a row or a dead letter, down to the files and their dates."""
    rng = random.Random(9)
    values = [record(1, 1, "pose", 1, {"a": 1.0})[4], box(1)[4], clip(1)[4]]
    kinds = ["SIGNAL", "PERCEPTION", "SEGMENT_REF"]
    rows = [record(i, i, "", 1, {}, kind=kinds[i % 3], value=damaged(rng, values[i % 3])) for i in range(3000)]
    far = avro.encode({"record": avro.SIGNAL}, {"scene_id": "s", "channel": "pose", "sensor_time": 2**62, "log_time": -(2**62), "values_num": {}, "values_vec": {}, "values_str": {}})
    rows.append(record(3000, 3000, "", 1, {}, value=far))
    table(spark, rows).coalesce(2).write.parquet(str(tmp_path / "in"))
    assert pipelines.storage_job(files.file_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True).awaitTermination(180)
    read = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in ("signals", "perception", "segments", "dead_letters")}
    assert sum(d.count() for d in read.values()) == len(rows) and all(d.schema["date"].dataType.simpleString() == "date" for n, d in read.items() if n != "dead_letters")
    assert read["dead_letters"].where("source_offset = 3000").first()["error_class"] == "PARSE_FAILURE"


def test_frames_and_blobs(spark, tmp_path):
    import hashlib
    import struct
    import zlib

    body = b"body"
    wire = files.MAGIC_V2 + hashlib.sha256(files.MAGIC_V2 + body).digest() + body
    df = spark.createDataFrame([(0, wire), (1, wire + b"x"), (2, b"FSMQ"), (3, b"XXXX" + wire[4:])], "i int, w binary").select("i", files.frame_check(F.col("w")).alias("e"))
    assert [(r["e"] or "ok").split(" ")[0] for r in df.orderBy("i").collect()] == ["ok", "digest", "unsupported", "unsupported"]

    def frame(seq, payload):
        rest = struct.pack("<QB", seq, 1) + payload
        return struct.pack("<II", len(payload), zlib.crc32(rest)) + rest

    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.wal").write_bytes(frame(1, b"x") + frame(2, b"yy") + frame(3, b"zzz")[:-1])
    assert [r["seq"] for r in files.wal_frames(spark, str(tmp_path / "w")).collect()] == [1, 2]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.bin").write_bytes(struct.pack("<5f", 1, 2, 3, 640, 0) * 10 + b"rest")
    p = files.lidar_points(spark, str(tmp_path / "l"), 4).collect()
    assert len(p) == 4 and p[0]["intensity"] == 1.0


def test_replay_wraps_and_jumps(spark):
    df = spark.createDataFrame([("v", t, t) for t in (0, 100, 1_000_000)], "vehicle_id string, seq long, t_us long")
    steps = [(a, b, rows.count()) for a, b, rows in Replay(df, 250).frames(4)]
    assert steps == [(-1, 249, 2), (999_999, 1_000_000, 1), (-1, 249, 2), (999_999, 1_000_000, 1)]
    assert Replay(df.where("false")).push() is None


def test_replay_with_keyframes(spark):
    df = spark.createDataFrame([(v, t, t) for v in "ab" for t in (0, 100, 1_000_000)], "vehicle_id string, seq long, t_us long")
    box = "seq long, vehicle_id string, boot_id string, sample_id string, t_us long, category string, center_x double, center_y double, size_w double, size_l double, rot_z double, visibility string, num_lidar_pts int, track_id string"
    boxes = spark.createDataFrame([(i, "a", "b", f"k{i % 2}", 100 * (i % 2), "x.car", 1.0, 1.0, 1.0, 1.0, 0.0, "v", i % 3, "t") for i in range(6)], box).withColumn("sensor_time", F.timestamp_micros("t_us"))
    replay = Replay(df, 250, boxes=boxes)
    one, two, three = replay.push_all(), replay.push_all("a"), replay.push_all()
    assert [(s["epoch"], s["new_epoch"], s["from"], s["to"]) for s in (one, two, three)] == [(0, True, -1, 249), (0, False, 999_999, 1_000_000), (1, True, -1, 249)]
    assert {(r["vehicle_id"], r["t_us"], r["n"]) for r in one["batches"].collect()} == {("a", 0, 2), ("b", 0, 2)} and two["signals"].count() == 1
    assert [(r["sample_id"], r["n_objects"], r["n_zero_lidar"]) for r in one["keyframes"].collect()] == [("k0", 3, 1), ("k1", 3, 1)] and two["keyframes"].count() == 0


def test_hub():
    hub = AlertHub(2)
    assert [hub.publish({"event_id": i, "vehicle_id": "v"}) for i in "aabc"] == [True, False, True, True]
    assert [a["event_id"] for a in hub.after("b")] == ["c"] and len(hub.after("gone")) == 2 and hub.after("b", "w") == []
