"""Wire frames, recordings, chains, receipts: the contracts that a query's SQL doesn't reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import control, joins, scenes
from roadpulse.sources import avro, frames, mcap


def batch(first=3, n=3, **more):
    return {"vehicle_id": "v", "boot_id": "b", "stream": "status", "records": [{"seq": first + i, "kind": "signal", "payload": bytes([i, 255]), "report_interval_ms": 1000} for i in range(n)]} | more


@pytest.mark.parametrize("version", [1, 2])
def test_frames_round_trip_and_refuse_every_changed_byte(version):
    wire = frames.frame(batch(), version)
    got = frames.read_frame(wire, "fleet/v1/v/up/status")
    assert got["version"] == version and {k: got[k] for k in batch()} == batch() and frames.frame(got, version) == wire
    for at in range(len(wire)):
        changed = wire[:at] + bytes([wire[at] ^ 1]) + wire[at + 1 :]
        try:
            assert (frames.read_frame(changed), version) == (got, 1)  # base64 has bits that stand for nothing
        except frames.Refused:
            pass
    for bad in (wire[:-1], wire + b"\0", b"", wire[:40]):
        with pytest.raises(frames.Refused):
            frames.read_frame(bad)
    with pytest.raises(frames.Refused, match="topic"):
        frames.read_frame(wire, "fleet/v1/w/up/status")


def test_frames_contract():
    for bad in (batch(n=0), batch(n=129), batch(vehicle_id="a b"), batch(stream="other"), batch(first=-1)):
        with pytest.raises(frames.Refused):
            frames.frame(bad)
    gap = batch()
    gap["records"][2]["seq"] = 9
    with pytest.raises(frames.Refused, match="gap"):
        frames.frame(gap)
    loose = json.loads(frames.frame(batch(), 1))
    assert frames.read_frame(json.dumps(loose, indent=1).encode())["batch_id"] == loose["batch_id"]  # the digest is of the canonical body
    assert frames.canonical({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}'


def recording(n=50, chunk=200):
    w = mcap.Writer(chunk)
    for i in range(n):
        w.add("/a" if i % 2 else "/b", "json", i, i * 10, b"x" * i)
    return w.close()


def test_recordings_survive_a_torn_end():
    data, summary = recording()
    whole = list(mcap.messages(data))
    assert len(whole) == summary["n_messages"] == 50 and summary["n_channels"] == 2 and summary["n_chunks"] > 5
    before = 0
    for end in range(0, len(data), 37):
        part = list(mcap.messages(data[:end]))
        assert part == whole[: len(part)] and len(part) >= before
        before = len(part)
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 255
    part = list(mcap.messages(bytes(damaged)))
    assert part == whole[: len(part)] and len(part) < 50
    assert list(mcap.messages(b"no recording")) == [] and list(mcap.messages(mcap.Writer().close()[0])) == []
    with pytest.raises(ValueError):
        w = mcap.Writer()
        w.add("/a", "json", 0, 5, b"")
        w.add("/a", "json", 1, 4, b"")


def test_recordings_by_topic_and_time(spark, tmp_path):
    data, _ = recording()
    (tmp_path / "one.mcap").write_bytes(data)
    (tmp_path / "torn.mcap").write_bytes(data[: len(data) // 2])
    got = mcap.read_messages(spark, str(tmp_path / "one.mcap"), ["/a"], 100, 200).select("topic", "sequence", "log_time").collect()
    assert [(r[1], r[2]) for r in got] == [(i, i * 10) for i in range(11, 20, 2)] and {r[0] for r in got} == {"/a"}
    by = {r["n"]: r["c"] for r in mcap.read_messages(spark, str(tmp_path)).groupBy(F.regexp_extract("path", r"(\w+)\.mcap", 1).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    assert by["one"] == 50 and 0 < by["torn"] < 50


def test_chains(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "gone"), ("one", None)], "token string, next string")
    assert {(r["token"], r["chain_end"], r["to_end"]) for r in scenes.walked(nodes).collect()} == {("a", "c", 2), ("b", "c", 1), ("c", "c", 0), ("x", "x", 0), ("one", "one", 0)}
    assert scenes.walked(nodes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scenes.walked(spark.createDataFrame([("a", "b"), ("b", "a")], "token string, next string"), most_rounds=6)


def test_receipts(spark):
    now = 1000
    rows = [("v", "a", "w", "diagnostic", None, now + 1, now, 0), ("v", "a", "w", "diagnostic", None, now + 1, now, 1), ("v", "a", "x", "diagnostic", None, now + 1, now, 2), ("v", "b", "w", "collection_policy", 5, now + 1, now, 3), ("v", "c", "w", "collection_policy", 5, now + 1, now, 4), ("v", "d", "w", "collection_policy", 9, now, now, 5), ("v", "e", "w", "collection_policy", 6, now + 300_001, now, 6), ("v", "f", "w", "collection_policy", 6, now + 1, now, 7), ("v", "g", "w", "x", None, now + 1, now, 8)]
    got = control.receipts(spark.createDataFrame(rows, "vehicle_id string, command_id string, wire string, type string, version long, expires_ms long, now_ms long, order long"))
    assert [(r["status"], r["reason"]) for r in got.orderBy("order").collect()] == [
        ("applied", None), ("applied", None), ("rejected", "id reused"), ("applied", None), ("rejected", "stale policy version"), ("expired", "expired"), ("rejected", "command lifetime exceeds five minutes"), ("applied", None), ("rejected", "unsupported command type"),
    ]


def test_overlap_of_spans_of_all_lengths(spark):
    r = random.Random(4)
    spans = lambda n: [(r.choice("ab"), i, lo, lo + r.choice([0, 1, 5, 90, 3000, 70_000, 10**7])) for i in range(n) for lo in [r.randrange(-5000, 100_000)]]
    one, two = spans(120), spans(120)
    left, right = spark.createDataFrame(one, "k string, i long, a long, b long"), spark.createDataFrame(two, "k string, j long, c long, d long")
    got = sorted((x["i"], x["j"]) for x in joins.interval_overlap(left, right, ["k"], 4, ("a", "b"), ("c", "d")).collect())
    assert got == sorted((i, j) for k, i, a, b in one for q, j, c, d in two if k == q and a < d and b > c and a < b and c < d)


def test_overlap_of_open_ends(spark):
    """Spans as long as longs go, beside short ones: no level explodes, and a side is copied to levels of the other alone."""
    top = (1 << 63) - 1
    one = [("a", 0, -(1 << 63), top), ("a", 1, 5, 1 << 62), ("a", 2, 10, 12), ("b", 3, -(1 << 62), 0), ("a", 4, top - 1, top), ("a", 5, 7, 7)]
    two = [("a", 0, 11, 13), ("a", 1, -(1 << 63), -(1 << 63) + 1), ("a", 2, 0, top), ("b", 3, -1, 1), ("a", 4, 12, 10**16), ("b", 5, 0, 9)]
    left, right = spark.createDataFrame(one, "k string, i long, a long, b long"), spark.createDataFrame(two, "k string, j long, c long, d long")
    for width in (1, 1000, 10**6):
        got = sorted((x["i"], x["j"]) for x in joins.interval_overlap(left, right, ["k"], width, ("a", "b"), ("c", "d")).collect())
        assert got == sorted((i, j) for k, i, a, b in one for q, j, c, d in two if k == q and a < d and b > c and a < b and c < d)
    same = left.where("i = 2")
    assert joins.interval_overlap(same, right.where("false"), ["k"], 4, ("a", "b"), ("c", "d")).isEmpty()
    with pytest.raises(ValueError):
        joins.interval_overlap(left, right, ["k"], 0, ("a", "b"), ("c", "d"))


def test_columns_are_coded_as_records_are():
    """Whole columns at once give what `encode` and `_read` give record by record, damaged ones among them."""
    import random

    import pyarrow as pa

    r = random.Random(7)

    def some(kind):
        if isinstance(kind, str):
            return {"long": lambda: r.choice([0, -1, 63, 64, -(2**63), 2**63 - 1, r.randrange(10**15)]), "double": r.random, "string": lambda: r.choice(["", "a", "äöü", "x" * 130]), "null": lambda: None}[kind]()
        ((shape, inner),) = kind.items()
        if shape == "array":
            return [some(inner) for _ in range(r.choice([0, 1, 3, 70]))]
        if shape == "map":
            return {f"{some('string')}{k}": some(inner) for k in range(r.randrange(4))}
        return r.choice(inner) if shape == "enum" else some(r.choice(inner))

    for fields in avro.KINDS.values():
        records = [{n: r.randrange(10**15) if n in avro.TIMES and r.random() < 0.95 else some(of) for n, of in fields} for _ in range(600)]
        plain = [avro.encode({"record": fields}, x) for x in records]
        raw, lengths = avro._joined([avro.write_all(of, pa.array([x[n] for x in records], avro.arrow_type(of))) for n, of in fields])
        ends = lengths.cumsum()
        assert [raw[b - n : b].tobytes() for b, n in zip(ends, lengths)] == plain
        cut = [p[: r.randrange(len(p) + 1)] if k % 3 == 0 else p[: k % len(p)] + bytes([r.randrange(256)]) + p[k % len(p) + 1 :] if k % 3 == 1 else p + b"xx" for k, p in enumerate(plain)]
        read = avro.read_all(cut, fields)
        wanted = [avro._read(c, fields) for c in cut]
        assert repr(read.to_pylist()) == repr(avro._column(wanted, read.type).to_pylist())
        assert 100 < sum(w is None for w in wanted) < 500


def test_messages_of_many_recordings_are_held_in_bounded_numbers(spark):
    rows = spark.range(40).selectExpr("concat('s', id % 4) as segment", "'t' as topic", "'json' as encoding", "id as sequence", "id as log_time", "encode(cast(id as string), 'UTF-8') as data")
    files = mcap.write_segments(rows).select(F.col("segment").alias("path"), "content").coalesce(1)
    read = mcap.read_contents(files, lambda s: None if s != "s3" else {"other"}, 0, 32, most=3)
    assert sorted(r["sequence"] for r in read.collect()) == [k for k in range(32) if k % 4 != 3]


def test_a_reader_of_one_kind_decodes_only_that_kind_and_once(spark, sf_dir="/root/testdata/sf0.001"):
    """Boxes: records of other kinds are gone before anything is coded, and each box is encoded once and decoded once."""
    import __spark_entry__

    for name, table in (("stored_boxes", "lineitem"), ("stored_clips", "orders")):
        plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2 and f"{table}.parquet" in plan and "events.parquet" not in plan


def test_last_header_of_a_name(spark):
    """Of several headers the last counts, even if it has no value; other names, no headers and null ones are nothing."""
    from pyspark.sql import functions as F

    from roadpulse.operators import validate

    cases = [[("a", b"1"), ("b", b"2"), ("a", b"3")], [("a", b"1"), ("a", None)], [("b", b"2")], [(None, b"9"), ("a", b"4"), None], [None], [], None]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, headers array<struct<key string, value binary>>").repartition(2)
    got = {r["i"]: r["h"] for r in d.select("i", validate.header("a").alias("h")).collect()}
    assert got == {0: "3", 1: None, 2: None, 3: "4", 4: None, 5: None, 6: None}
    mine = F.filter("headers", lambda h: h["key"] == "a")  # the form with a lambda
    assert got == {r["i"]: r["h"] for r in d.select("i", F.decode(F.try_element_at(mine, F.lit(-1))["value"], "UTF-8").alias("h")).collect()}
