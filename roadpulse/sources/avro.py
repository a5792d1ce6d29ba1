"""Schemaless Avro decoding of the record layers in Arrow batches, for clusters without an Avro data source."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of the three record kinds, in order of their encoding.
SIGNAL = [("scene_id", "string"), ("channel", "string"), ("sensor_time", "long"), ("log_time", "long"), ("values_num", {"map": "double"}), ("values_vec", {"map": {"array": "double"}}), ("values_str", {"map": "string"})]
PERCEPTION = [
    ("scene_id", "string"), ("sample_id", "string"), ("sensor_time", "long"), ("track_id", "string"), ("category", "string"), ("attribute", {"union": ["null", "string"]}),
    ("center_x", "double"), ("center_y", "double"), ("center_z", "double"), ("size_w", "double"), ("size_l", "double"), ("size_h", "double"),
    ("rot_w", "double"), ("rot_x", "double"), ("rot_y", "double"), ("rot_z", "double"), ("visibility", "string"), ("num_lidar_pts", "long"), ("num_radar_pts", "long"),
]
SEGMENT = [
    ("segment_id", "string"), ("scene_id", {"union": ["null", "string"]}), ("blob_uri", "string"), ("t_start", "long"), ("t_end", "long"), ("sensor_channels", {"array": "string"}), ("size_bytes", "long"),
    ("checksum", "string"), ("sample_count", "long"), ("state", {"enum": ["UPLOADED", "DROPPED"]}), ("drop_reason", {"union": ["null", "string"]}), ("calibration", {"map": "string"}),
]
BATCH = [
    ("vehicle_id", "string"), ("boot_id", "string"), ("stream", {"enum": ["event", "status", "history"]}),
    ("records", {"array": {"record": [("seq", "long"), ("kind", {"enum": ["signal", "perception"]}), ("payload", "bytes"), ("report_interval_ms", "long")]}}),
]
DEAD_LETTER = [
    ("original_payload", {"union": ["bytes", "null"]}), ("error_class", {"enum": ["PARSE_FAILURE", "SCHEMA_VALIDATION_FAILURE", "BUSINESS_RULE_FAILURE", "SINK_WRITE_FAILURE"]}), ("error_detail", "string"),
    ("source_subscription", "string"), ("pipeline_step", "string"), ("processing_time", "long"), ("attempt", "long"), ("format_version", "long"), ("source_partition", {"union": ["null", "long"]}),
    ("source_offset", {"union": ["null", "long"]}), ("source_key", {"union": ["null", "bytes"]}), ("source_headers", {"array": {"record": [("key", "string"), ("value", {"union": ["null", "bytes"]})]}}),
    ("vehicle_id", {"union": ["null", "string"]}), ("boot_id", {"union": ["null", "string"]}), ("source_boot_id", {"union": ["null", "string"]}), ("seq", {"union": ["null", "long"]}),
    ("kind", {"union": ["null", "string"]}), ("stream_id", {"union": ["null", "string"]}), ("report_interval_ms", {"union": ["null", "long"]}),
]
KINDS = {"signal": SIGNAL, "perception": PERCEPTION, "segment": SEGMENT}
#: Fields that count microseconds.
TIMES = {"sensor_time", "log_time", "t_start", "t_end"}
#: Times that the tables take, in microseconds: the years 1900 to 2299. Beyond them no file format agrees with another on what a time is.
FIRST_TIME, END_TIME = -2_208_988_800_000_000, 10_413_792_000_000_000


class Reader:
    """Walks one encoded value."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("value ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        shift = out = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                if out >> 64:
                    raise ValueError("number has more than 64 bits")
                return out >> 1 ^ -(out & 1)
            shift += 7
            if shift > 63:
                raise ValueError("number is too long")

    def blocks(self) -> Iterator[int]:
        """Once for each item of an array or map."""
        while n := self.number():
            if n < 0:
                n = -n
                self.number()
            yield from range(n)

    def value(self, kind):
        if kind == "null":
            return None
        if kind == "long":
            return self.number()
        if kind == "double":
            return struct.unpack("<d", self.take(8))[0]
        if kind == "bytes":
            return self.take(self.number())
        if kind == "string":
            return self.take(self.number()).decode()
        ((shape, inner),) = kind.items()
        if shape == "array":
            return [self.value(inner) for _ in self.blocks()]
        if shape == "map":
            return {self.value("string"): self.value(inner) for _ in self.blocks()}
        if shape == "record":
            return {name: self.value(of) for name, of in inner}
        at = self.number()
        if not 0 <= at < len(inner):
            raise ValueError("no such branch")
        return inner[at] if shape == "enum" else self.value(inner[at])


def encode(kind, v) -> bytes:
    """Inverse of `Reader.value`, for sinks and tests."""

    def number(n: int) -> bytes:
        n, out = n << 1 ^ n >> 63, bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if kind == "null":
        return b""
    if kind == "long":
        return number(v)
    if kind == "double":
        return struct.pack("<d", v)
    if kind in ("bytes", "string"):
        raw = v.encode() if kind == "string" else v
        return number(len(raw)) + raw
    ((shape, inner),) = kind.items()
    if shape == "array":
        return (number(len(v)) + b"".join(encode(inner, x) for x in v) if v else b"") + b"\0"
    if shape == "map":
        return (number(len(v)) + b"".join(encode("string", k) + encode(inner, x) for k, x in v.items()) if v else b"") + b"\0"
    if shape == "record":
        return b"".join(encode(of, v[name]) for name, of in inner)
    if shape == "enum":
        return number(inner.index(v))
    at = next(i for i, b in enumerate(inner) if (b == "null") == (v is None))
    return number(at) + encode(inner[at], v)


def arrow_type(kind) -> pa.DataType:
    """Arrow's type of a value as `Reader` gives it."""
    if isinstance(kind, str):
        return {"long": pa.int64(), "double": pa.float64(), "bytes": pa.binary(), "string": pa.string()}[kind]
    ((shape, inner),) = kind.items()
    if shape == "array":
        return pa.list_(arrow_type(inner))
    if shape == "map":
        return pa.map_(pa.string(), arrow_type(inner))
    if shape == "record":
        return pa.struct([(n, pa.timestamp("us", "UTC") if n in TIMES else arrow_type(of)) for n, of in inner])
    return pa.string() if shape == "enum" else arrow_type(next(b for b in inner if b != "null"))


def sql_type(kind) -> str:
    if isinstance(kind, str):
        return {"long": "bigint", "double": "double", "bytes": "binary", "string": "string"}[kind]
    ((shape, inner),) = kind.items()
    if shape == "array":
        return f"array<{sql_type(inner)}>"
    if shape == "map":
        return f"map<string,{sql_type(inner)}>"
    if shape == "record":
        return "struct<" + ",".join(f"{n}:{'timestamp' if n in TIMES else sql_type(of)}" for n, of in inner) + ">"
    return "string" if shape == "enum" else sql_type(next(b for b in inner if b != "null"))


def _read(data: bytes, fields: list) -> dict | None:
    """A record, or None where its bytes are damaged or a time is one that no table takes. Trailing bytes are ignored."""
    try:
        record = Reader(data).value({"record": fields})
    except (ValueError, TypeError, OverflowError, struct.error):
        return None
    return record if all(FIRST_TIME <= record[n] < END_TIME for n, _ in fields if n in TIMES) else None


def _column(records: list[dict | None], of: pa.DataType) -> pa.Array:
    """An Arrow column; records that Arrow won't take become null one by one, so that one of them never stops the others."""
    try:
        return pa.array(records, of)
    except (pa.ArrowException, OverflowError, TypeError, ValueError):
        if len(records) == 1:
            return pa.nulls(1, of)
    half = len(records) // 2
    return pa.concat_arrays([_column(records[:half], of), _column(records[half:], of)])


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all bytes of pieces that start at `starts`."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Columns:
    """Walks many encoded records at once, field by field. What isn't plain (damage, negative or further blocks, repeated keys) is marked `bad` and left to `_read`."""

    #: Items of a map or list that are walked in steps of their own.
    MOST = 64

    def __init__(self, values: list[bytes]):
        self.data = np.frombuffer(b"".join([*values, b"\0" * 16]), dtype=np.uint8)
        lengths = np.array([len(v) for v in values], dtype=np.int64)
        self.end = np.cumsum(lengths)
        self.at = self.end - lengths
        self.bad = np.zeros(len(values), dtype=bool)

    def number(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.uint64)
        left = np.flatnonzero(~self.bad[rows])
        for k in range(10):
            here = rows[left]
            b = self.data[self.at[here]]
            wrong = (self.at[here] >= self.end[here]) | (b > 1 if k == 9 else False)
            self.bad[here[wrong]] = True
            left, here, b = left[~wrong], here[~wrong], b[~wrong]
            self.at[here] += 1
            out[left] |= (b & 127).astype(np.uint64) << np.uint64(7 * k)
            left = left[b > 127]
            if not len(left):
                break
        out[self.bad[rows]] = 0
        return (out >> np.uint64(1)).view(np.int64) ^ -(out & np.uint64(1)).view(np.int64)

    def take(self, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the next n bytes."""
        wrong = self.bad[rows] | (n < 0) | (n > self.end[rows] - self.at[rows])
        self.bad[rows[wrong]] = True
        n = np.where(wrong, 0, n)
        start = self.at[rows]
        self.at[rows] += n
        return start, n

    def value(self, kind, rows: np.ndarray) -> pa.Array:
        if kind == "long":
            return pa.array(self.number(rows))
        if kind == "double":
            start, n = self.take(rows, np.full(len(rows), 8))
            start = np.where(n == 8, start, 0)
            return pa.array(self.data[np.minimum(start[:, None] + np.arange(8), len(self.data) - 1)].view("<f8").ravel())
        if kind in ("string", "bytes"):
            start, n = self.take(rows, self.number(rows))
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum(n, out=offsets[1:])
            text = pa.Array.from_buffers(pa.binary() if kind == "bytes" else pa.string(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[_places(start, n)])])
            if kind == "bytes":
                return text
            try:
                text.validate(full=True)
                return text
            except pa.ArrowInvalid:
                return pa.array([self._text(r, v) for r, v in zip(rows, text.cast(pa.binary()).to_pylist())], pa.string())
        ((shape, inner),) = kind.items()
        if shape == "enum":
            at = self.number(rows)
            self.bad[rows[(at < 0) | (at >= len(inner))]] = True
            return pa.array(inner).take(pa.array(np.clip(at, 0, len(inner) - 1)))
        if shape == "union":
            at = self.number(rows)
            self.bad[rows[(at < 0) | (at >= len(inner))]] = True
            full = inner.index(next(b for b in inner if b != "null"))
            has = at == full
            where = np.where(has, np.cumsum(has) - 1, 0)
            return self.value(inner[full], rows[has]).take(pa.array(where, mask=~has))
        return self.items(inner, rows, shape == "map")

    def _text(self, row: int, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            self.bad[row] = True
            return ""

    def items(self, inner, rows: np.ndarray, named: bool) -> pa.Array:
        """Lists, or maps: the items of one block, the first of all rows, then the second of all that have one."""
        n = self.number(rows)
        self.bad[rows[(n < 0) | (n > self.MOST)]] = True
        n = np.where(self.bad[rows], 0, n)
        keys, parts, order = [], [], []
        offsets = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum(n, out=offsets[1:])
        for k in range(int(n.max(initial=0))):
            has = np.flatnonzero(n > k)
            if named:
                keys.append(self.value("string", rows[has]))
            parts.append(self.value(inner, rows[has]))
            order.append(offsets[has] + k)
        some = rows[n > 0]
        self.bad[some[self.number(some) != 0]] = True
        place = np.argsort(np.concatenate(order)) if order else np.zeros(0, dtype=np.int64)
        of = lambda found, kind: (pa.concat_arrays(found) if found else pa.array([], kind)).take(pa.array(place))
        offsets, items = pa.array(offsets, pa.int32()), of(parts, arrow_type(inner))
        if not named:
            return pa.ListArray.from_arrays(offsets, items)
        names = of(keys, pa.string())
        if len(names):
            row, code = np.repeat(np.arange(len(rows)), n), names.dictionary_encode().indices.to_numpy()
            pair = np.sort(row * (int(code.max()) + 1) + code)
            self.bad[rows[np.unique(pair[1:][pair[1:] == pair[:-1]] // (int(code.max()) + 1))]] = True
        return pa.MapArray.from_arrays(offsets, names, items)


def read_all(values: list[bytes], fields: list) -> pa.Array:
    """Records as `_read` gives them, null where it gives none."""
    of = arrow_type({"record": fields})
    if not values:
        return pa.array([], of)
    c, every = Columns(values), np.arange(len(values))
    found = [c.value(kind, every) for _, kind in fields]
    for (name, _), column in zip(fields, found):
        if name in TIMES:
            t = column.to_numpy()
            c.bad |= (t < FIRST_TIME) | (t >= END_TIME)
    whole = pa.StructArray.from_arrays([f.cast(of.field(i).type) for i, f in enumerate(found)], fields=list(of))
    if not c.bad.any():
        return whole
    odd = np.flatnonzero(c.bad)
    place = every.copy()
    place[odd] = len(values) + np.arange(len(odd))
    return pa.concat_arrays([whole, _column([_read(values[i], fields) for i in odd], of)]).take(pa.array(place))


def decoded(routed: Column, value: Column) -> Column:
    """Struct signal, perception, segment: the one that `routed` names is decoded, null where that fails; the others are null. One pass over the bytes, Arrow to Arrow.

    Spark is told not to repeat it: a filter on the result would otherwise be pushed below and decode every record once more.
    """
    types = [pa.field(k, arrow_type({"record": fields})) for k, fields in KINDS.items()]

    def run(kinds: pa.Array, values: pa.Array) -> pa.Array:
        named, columns = np.array(kinds.to_pylist(), dtype=object), []
        given = values.is_valid().to_numpy(zero_copy_only=False)
        for f in types:
            mine = (named == f.name) & given
            if not mine.any():
                columns.append(pa.nulls(len(values), f.type))
                continue
            read = read_all(values.filter(pa.array(mine)).to_pylist(), KINDS[f.name])
            columns.append(read.take(pa.array(np.where(mine, np.cumsum(mine) - 1, 0), mask=~mine)))
        return pa.StructArray.from_arrays(columns, fields=types)

    shape = "struct<" + ",".join(f"{k}:{sql_type({'record': fields})}" for k, fields in KINDS.items()) + ">"
    run.__annotations__ = {"kinds": pa.Array, "values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, shape).asNondeterministic()(routed, value)


def decode_signals(records: DataFrame, column: str = "value") -> DataFrame:
    """Adds `signal`, a struct of the decoded record, null where decoding fails."""
    return records.withColumn("_d", decoded(F.lit("signal"), F.col(column))).withColumn("signal", F.col("_d.signal")).drop("_d")


def _joined(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (bytes of all rows, lengths by row) put behind each other row by row."""
    lengths = sum(n for _, n in pieces)
    at = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), dtype=np.uint8)
    for raw, n in pieces:
        out[_places(at, n)] = raw
        at = at + n
    return out, lengths


def _numbers(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = v.astype(np.int64)
    u = ((v << 1) ^ (v >> 63)).view(np.uint64)
    parts = (u[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))).astype(np.uint64)
    parts[:, 1:] = np.where(np.arange(1, 10) * 7 < 64, parts[:, 1:], 0)
    has = parts > 0
    has[:, 0] = True
    raw = (parts & np.uint64(127)).astype(np.uint8) | (np.append(has[:, 1:], np.zeros((len(v), 1), dtype=bool), axis=1) * np.uint8(128))
    return raw[has], has.sum(1)


def write_all(kind, v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`encode` of a column: bytes of all rows, and lengths by row."""
    if v.null_count and "union" not in kind:
        raise ValueError(f"a null has no encoding as {kind}")
    if kind == "long":
        return _numbers(v.to_numpy(zero_copy_only=False))
    if kind == "double":
        return np.ascontiguousarray(v.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype="<f8").view(np.uint8), np.full(len(v), 8)
    if kind in ("string", "bytes"):
        v = pa.concat_arrays([v.cast(pa.binary())])
        ends = np.frombuffer(v.buffers()[1], dtype=np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64)
        raw = np.frombuffer(v.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if v.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        return _joined([_numbers(np.diff(ends)), (raw, np.diff(ends))])
    ((shape, inner),) = kind.items()
    if shape == "enum":
        return _numbers(pa.compute.index_in(v, pa.array(inner)).to_numpy(zero_copy_only=False))
    if shape == "union":
        null, full = inner.index("null"), next(i for i, b in enumerate(inner) if b != "null")
        has = v.is_valid().to_numpy(zero_copy_only=False)
        raw, some = write_all(inner[full], v.drop_null())
        lengths = np.zeros(len(v), dtype=np.int64)
        lengths[has] = some
        return _joined([_numbers(np.where(has, full, null)), (raw, lengths)])
    if shape == "record":
        return _joined([write_all(of, v.field(n)) for n, of in inner])
    ends = np.asarray(v.offsets.to_numpy(), dtype=np.int64)
    flat = lambda a: a.slice(ends[0], ends[-1] - ends[0])
    raw, each = _joined([write_all("string", flat(v.keys)), write_all(inner, flat(v.items))]) if shape == "map" else write_all(inner, flat(v.values))
    before = np.append(0, np.cumsum(each))
    n = np.diff(ends)
    count, width = _numbers(n)
    some = n > 0
    told = (count[np.repeat(some, width)], np.where(some, width, 0))
    return _joined([told, (raw, np.diff(before[ends - ends[0]])), (np.zeros(len(v), dtype=np.uint8), np.ones(len(v), dtype=np.int64))])


def encoded(fields: list, columns: dict[str, Column] | None = None) -> Column:
    """Bytes of records whose fields are columns of the fields' names, or those of `columns`: signals, boxes, and references to clips."""
    columns = columns or {}

    def run(*given: pa.Array) -> pa.Array:
        raw, lengths = _joined([write_all(of, v) for (_, of), v in zip(fields, given)])
        ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(raw)])

    run.__annotations__ = {"given": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(*[columns.get(n, F.col(n)) for n, _ in fields])


def _declared(kind, named: set) -> object:
    """JSON of a schema as the container's header holds it."""
    if isinstance(kind, str):
        return kind
    ((shape, inner),) = kind.items()
    if shape == "array":
        return {"type": "array", "items": _declared(inner, named)}
    if shape == "map":
        return {"type": "map", "values": _declared(inner, named)}
    if shape == "union":
        return [_declared(b, named) for b in inner]
    name = f"{shape}{len(named)}"
    named.add(name)
    if shape == "enum":
        return {"type": "enum", "name": name, "symbols": inner}
    return {"type": "record", "name": name, "fields": [{"name": n, "type": _declared(of, named)} for n, of in inner]}


def container(fields: list, record: dict) -> bytes:
    """An object container file of one record, which holds its own schema."""
    body, schema = encode({"record": fields}, record), json.dumps(_declared({"record": fields}, set())).encode()
    sync = hashlib.md5(body).digest()
    head = encode({"map": "bytes"}, {"avro.schema": schema, "avro.codec": b"null"})
    return b"Obj\x01" + head + sync + encode("long", 1) + encode("long", len(body)) + body + sync


def from_container(data: bytes, fields: list) -> list[dict]:
    """The records of a container file written with the same fields."""
    if data[:4] != b"Obj\x01":
        raise ValueError("no container file")
    r = Reader(data)
    r.at = 4
    r.value({"map": "bytes"})
    sync, out = r.take(16), []
    while r.at < len(data):
        n, _ = r.number(), r.number()
        out += [r.value({"record": fields}) for _ in range(n)]
        if r.take(16) != sync:
            raise ValueError("sync marker differs")
    return out
