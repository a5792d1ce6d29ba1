"""Batch frames of the uplink: version 1 is JSON with payloads in base64, version 2 binary; both carry a digest of their body."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uuid5
from . import avro

# Fixed values of the wire: magic, streams, kinds, limits, and the name that a relayed boot is derived from.
MAGIC = b"FSMQ\x02"
STREAMS = ("event", "status", "history")
KINDS = ("signal", "perception")
MOST_BYTES, MOST_RECORDS, INTERVALS = 65_536, 128, (100, 60_000)
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
BOOT_NAME = "fleet:v1:"

FRAME = "error string, version int, batch_id string, vehicle_id string, boot_id string, stream string, records array<struct<seq:bigint,kind:string,payload:binary,report_interval_ms:bigint>>"


class Refused(ValueError):
    """Why a frame isn't taken."""


def canonical(value) -> bytes:
    """JSON with sorted keys and no spaces; numbers that JSON lacks are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def checked(batch: dict) -> dict:
    """The batch if it keeps the contract: names, stream, 1 to 128 records in unbroken sequence, each of a known kind."""

    def hold(fact: bool, why: str) -> None:
        if not fact:
            raise Refused(why)

    whole = lambda v, lo, hi: type(v) is int and lo <= v <= hi
    for name in ("vehicle_id", "boot_id"):
        hold(isinstance(batch[name], str) and re.fullmatch("[a-zA-Z0-9_-]{1,80}", batch[name]) is not None, "invalid identity")
    hold(batch["stream"] in STREAMS and 1 <= len(batch["records"]) <= MOST_RECORDS, "invalid stream or record count")
    first = batch["records"][0]["seq"]
    for k, r in enumerate(batch["records"]):
        hold(whole(r["seq"], 0, 2**63 - 1), "invalid sequence")
        hold(r["seq"] == first + k, "sequence has a gap")
        hold(r["kind"] in KINDS, "unsupported kind")
        hold(whole(r["report_interval_ms"], *INTERVALS), "invalid report interval")
    return batch


def body_of(batch: dict, version: int) -> bytes:
    plain = {k: batch[k] for k in ("vehicle_id", "boot_id", "stream")}
    if version == 2:
        return avro.encode({"record": avro.BATCH}, plain | {"records": batch["records"]})
    records = [r | {"payload": base64.b64encode(r["payload"]).decode()} for r in batch["records"]]
    return canonical(plain | {"records": records, "version": 1})


def digest_of(body: bytes, version: int) -> str:
    return hashlib.sha256((MAGIC if version == 2 else b"") + body).hexdigest()


def frame(batch: dict, version: int = 2) -> bytes:
    """The bytes of a batch on the wire."""
    body = body_of(checked(batch), version)
    digest = digest_of(body, version)
    return MAGIC + bytes.fromhex(digest) + body if version == 2 else canonical(json.loads(body) | {"batch_id": digest})


def read_frame(data: bytes, topic: str | None = None) -> dict:
    """Version, batch_id and fields of a frame; `Refused` says what is wrong. Only the one canonical form of a batch is taken."""
    if len(data) > MOST_BYTES:
        raise Refused("frame is too long")
    try:
        if data[:4] == MAGIC[:4]:
            version, start = 2, len(MAGIC) + 32
            if data[: len(MAGIC)] != MAGIC or len(data) <= start:
                raise Refused("unsupported version or truncated")
            told, body = data[len(MAGIC) : start].hex(), data[start:]
            if digest_of(body, 2) != told:
                raise Refused("digest mismatch")
            reader = avro.Reader(body)
            batch = reader.value({"record": avro.BATCH})
            if reader.at != len(body):
                raise Refused("trailing bytes")
        else:
            version, value = 1, json.loads(data)
            if type(value["version"]) is not int or value["version"] != 1:
                raise Refused("unsupported version or truncated")
            told, batch = value["batch_id"], {k: value[k] for k in ("vehicle_id", "boot_id", "stream")}
            batch["records"] = [{k: r[k] for k in ("seq", "kind", "report_interval_ms")} | {"payload": base64.b64decode(r["payload"], validate=True)} for r in value["records"]]
        checked(batch)
        if digest_of(body_of(batch, version), version) != told:
            raise Refused("digest mismatch" if version == 1 else "not canonical")
        if topic is not None and topic != f"fleet/v1/{batch['vehicle_id']}/up/{batch['stream']}":
            raise Refused("topic names another vehicle or stream")
    except Refused:
        raise
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        raise Refused("malformed") from e
    return {"version": version, "batch_id": told} | batch


def frames(wires: DataFrame, wire: str = "wire", topic: str | None = "topic") -> DataFrame:
    """Adds frame: a struct of FRAME, whose error says why the bytes were refused; it is null for a good frame."""
    names = [c.strip().split(" ")[0] for c in FRAME.split(", ")]

    def run(data: pd.Series, topics: pd.Series) -> pd.DataFrame:
        out = []
        for d, t in zip(data, topics):
            try:
                out.append({"error": None} | read_frame(bytes(d) if d is not None else b"", t))
            except Refused as e:
                out.append({"error": str(e)})
        return pd.DataFrame({n: pd.Series([o.get(n) for o in out], dtype=object) for n in names})

    named = F.col(topic) if topic else F.lit(None).cast("string")
    return wires.withColumn("frame", F.pandas_udf(run, FRAME)(F.col(wire), named))


def relayed(framed: DataFrame) -> DataFrame:
    """One broker record (key, value, headers) for each record of the good frames. A batch's boot becomes a name of its own for each stream."""
    good = framed.where("frame.error is null").select("frame.*", F.posexplode("frame.records").alias("at", "r"))
    boot = uuid5(F.lit(NAMESPACE_URL), F.concat(F.lit(BOOT_NAME), F.concat_ws(":", "vehicle_id", "boot_id", "stream")))
    named = {"vehicle_id": F.col("vehicle_id"), "boot_id": boot, "source_boot_id": F.col("boot_id"), "stream_id": F.col("stream"), "seq": F.col("r.seq").cast("string"), "kind": F.concat(F.lit("RECORD_KIND_"), F.upper("r.kind")), "report_interval_ms": F.col("r.report_interval_ms").cast("string")}
    headers = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value")) for k, v in named.items()])
    return good.select("batch_id", "at", F.encode("vehicle_id", "UTF-8").alias("key"), F.col("r.payload").alias("value"), headers.alias("headers"))


def acknowledged(batches: DataFrame, completions: DataFrame, keys: list[str], at: str = "at", order: str = "order") -> DataFrame:
    """Batches (keys, n) all of whose n records were written: the first completion of a record counts, later ones are ignored. Completions: keys, at, order, ok."""
    first = completions.groupBy(*keys, at).agg(F.min_by("ok", order).alias("ok"))
    done = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("done"), F.min(F.col("ok").cast("int")).alias("all_ok"))
    return batches.join(done, keys).where((F.col("done") == F.col("n")) & (F.col("all_ok") == 1)).select(*batches.columns)


def canonical_json(column: Column) -> Column:
    """JSON text as its canonical form: sorted keys, no spaces, ASCII."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: None if x is None else canonical(json.loads(x)).decode())

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(column)
