"""Recordings in the open MCAP container format: a writer of one segment, and a scan that survives a crash's torn end."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: magic and the record types that are used here.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, STATISTICS, DATA_END = 1, 2, 3, 4, 5, 6, 11, 15

MESSAGES = "path string, topic string, encoding string, sequence long, log_time long, publish_time long, data binary"


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(body)) + body


class Writer:
    """Messages of one segment, in order of time, in chunks. `close` gives the file's bytes and its summary."""

    def __init__(self, chunk_bytes: int = 1 << 20):
        self.chunk_bytes = chunk_bytes
        self.out = [MAGIC, _record(HEADER, _text("") + _text("roadpulse"))]
        self.channels: dict[tuple[str, str], int] = {}
        self.held: list[bytes] = []
        self.size = 0
        self.first = self.last = self.opened = None
        self.counts: dict[int, int] = {}
        self.chunks = 0

    def add(self, topic: str, encoding: str, sequence: int, log_time: int, data: bytes, publish_time: int | None = None) -> None:
        if self.last is not None and log_time < self.last:
            raise ValueError("messages must come in order of time")
        channel = self.channels.get((topic, encoding))
        if channel is None:
            channel = self.channels[topic, encoding] = len(self.channels) + 1
            self._hold(_record(CHANNEL, struct.pack("<HH", channel, 0) + _text(topic) + _text(encoding) + struct.pack("<I", 0)))
        self.first = log_time if self.first is None else self.first
        self.opened = log_time if self.opened is None else self.opened
        self.last = log_time
        self._hold(_record(MESSAGE, struct.pack("<HIQQ", channel, sequence, log_time, log_time if publish_time is None else publish_time) + data))
        self.counts[channel] = self.counts.get(channel, 0) + 1
        if self.size >= self.chunk_bytes:
            self._flush()

    def _hold(self, record: bytes) -> None:
        self.held.append(record)
        self.size += len(record)

    def _flush(self) -> None:
        if not self.held:
            return
        body = b"".join(self.held)
        head = struct.pack("<QQQI", self.opened or 0, self.last or 0, len(body), zlib.crc32(body)) + _text("")
        self.out.append(_record(CHUNK, head + struct.pack("<Q", len(body)) + body))
        self.held, self.size, self.opened = [], 0, None
        self.chunks += 1

    def close(self) -> tuple[bytes, dict]:
        self._flush()
        counts = b"".join(struct.pack("<HQ", c, n) for c, n in self.counts.items())
        total = sum(self.counts.values())
        stats = struct.pack("<QHIIIIQQ", total, 0, len(self.channels), 0, 0, self.chunks, self.first or 0, self.last or 0) + struct.pack("<I", len(counts)) + counts
        data = b"".join([*self.out, _record(DATA_END, struct.pack("<I", 0)), _record(STATISTICS, stats), _record(FOOTER, struct.pack("<QQI", 0, 0, 0)), MAGIC])
        return data, {"n_messages": total, "n_channels": len(self.channels), "n_chunks": self.chunks, "first": self.first, "last": self.last, "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


class Torn(ValueError):
    """The bytes end or go wrong here."""


def _records(data: memoryview, at: int) -> Iterator[tuple[int, memoryview]]:
    while at < len(data):
        if at + 9 > len(data):
            raise Torn("record ends early")
        kind, size = struct.unpack_from("<BQ", data, at)
        if kind == 0 or at + 9 + size > len(data):
            raise Torn("record ends early")
        yield kind, data[at + 9 : at + 9 + size]
        if kind == FOOTER:
            return
        at += 9 + size


def _string(body: memoryview, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", body, at)
    if at + 4 + n > len(body):
        raise Torn("text ends early")
    return bytes(body[at + 4 : at + 4 + n]).decode(), at + 4 + n


def _chunk(body: memoryview, lo: int, hi: int) -> memoryview | None:
    """The records of a chunk, or None if it lies outside the time range and nothing of it need be read."""
    first, last, size, crc = struct.unpack_from("<QQQI", body, 0)
    codec, at = _string(body, 28)
    (n,) = struct.unpack_from("<Q", body, at)
    if (last < lo or first >= hi) and last:
        return None
    raw = body[at + 8 : at + 8 + n]
    if codec == "zstd":
        import zstandard

        raw = memoryview(zstandard.ZstdDecompressor().decompress(bytes(raw), max_output_size=size))
    elif codec:
        raise ValueError(f"chunks compressed by {codec} aren't supported")
    if crc and zlib.crc32(raw) != crc:
        raise Torn("chunk is damaged")
    return raw


def messages(content: bytes, topics: set[str] | None = None, lo: int = 0, hi: int = 1 << 63) -> Iterator[tuple]:
    """(topic, encoding, sequence, log_time, publish_time, data) up to the first torn or damaged record. Whole chunks outside [lo, hi) are skipped, but for their channels."""
    channels: dict[int, tuple[str, str]] = {}
    data = memoryview(content)

    def read(kind: int, body: memoryview) -> Iterator[tuple]:
        if kind == CHANNEL:
            (number,) = struct.unpack_from("<H", body, 0)
            topic, at = _string(body, 4)
            channels[number] = (topic, _string(body, at)[0])
        elif kind == MESSAGE:
            number, sequence, log_time, publish_time = struct.unpack_from("<HIQQ", body, 0)
            topic, encoding = channels[number]
            if lo <= log_time < hi and (topics is None or topic in topics):
                yield topic, encoding, sequence, log_time, publish_time, bytes(body[22:])

    try:
        if bytes(data[:8]) != MAGIC:
            return
        for kind, body in _records(data, 8):
            if kind == CHUNK:
                inner = _chunk(body, lo, hi)
                if inner is None:  # later chunks may use channels that this one declares
                    inner = _chunk(body, 0, 1 << 63)
                    for k, b in _records(inner, 0):
                        if k == CHANNEL:
                            yield from read(k, b)
                    continue
                for k, b in _records(inner, 0):
                    yield from read(k, b)
            else:
                yield from read(kind, body)
    except (Torn, struct.error, KeyError, UnicodeDecodeError):
        return


def read_messages(spark: SparkSession, path: str, topics: Iterable[str] | None = None, start: int = 0, end: int = 1 << 63) -> DataFrame:
    """Messages of recordings: MESSAGES, of the given topics and in [start, end). A file is one task's; rotation bounds its size. Torn files give their whole records."""
    wanted = None if topics is None else set(topics)
    return read_contents(spark.read.format("binaryFile").load(path).select("path", "content"), lambda _: wanted, start, end)


def read_contents(files: DataFrame, topics: Callable[[str], set[str] | None] = lambda _: None, start: int = 0, end: int = 1 << 63, most: int = 1000) -> DataFrame:
    """(path, content) -> MESSAGES; `topics` gives those wanted of a path. Contents are read where Arrow holds them, and `most` messages are held at a time, however many files a batch has."""
    names = [c.strip().split(" ")[0] for c in MESSAGES.split(",")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.strip().split(" ")[1]] for c in MESSAGES.split(",")]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for where, content in zip(b["path"], b["content"]):
                where = where.as_py()
                for m in messages(content.as_buffer(), topics(where), start, end):
                    rows.append((where, *m))
                    if len(rows) == most:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return files.select("path", "content").mapInArrow(run, MESSAGES)


def write_segments(rows: DataFrame, segment: str = "segment", chunk_bytes: int = 1 << 20) -> DataFrame:
    """(segment, topic, encoding, sequence, log_time, data) -> one recording per segment: segment, content, and its manifest.

    Rows are dealt by segment, sorted by time and streamed past the writer; a segment, which rotation bounds, is held as its file's bytes alone.
    """
    manifest = "segment string, content binary, n_messages long, n_channels long, n_chunks long, first long, last long, size_bytes long, sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, writer = None, None

        def closed() -> pd.DataFrame:
            content, summary = writer.close()
            return pd.DataFrame([{"segment": at, "content": content} | summary])

        for b in batches:
            for s, *m in zip(b["segment"], b["topic"], b["encoding"], b["sequence"], b["log_time"], b["data"]):
                if writer is None or s != at:
                    if writer is not None:
                        yield closed()
                    at, writer = s, Writer(chunk_bytes)
                writer.add(m[0], m[1], int(m[2]), int(m[3]), bytes(m[4]))
        if writer is not None:
            yield closed()

    plain = rows.select(F.col(segment).cast("string").alias("segment"), "topic", "encoding", "sequence", "log_time", "data")
    return plain.repartition("segment").sortWithinPartitions("segment", "log_time", "topic", "sequence").mapInPandas(run, manifest)
