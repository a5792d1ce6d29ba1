"""Bounded-space online best-fit packing of tokenised documents.

Texts are tokenised where they are read. Their pieces, a short row each, are then dealt to as few packing tasks as
hold TASK_PIECES each, so that bins left part-filled at a task's end don't grow with the number of files. In a task a fixed number of bins is
open, an integer used as a bitset tells which amounts of free space occur among
them, and the lowest set bit at or above a piece's length is the best fit. When
no open bin has room and all are taken, the fullest is closed. Within a batch of
the stream longer pieces come first, which leaves short ones to fill the gaps: a departure
from packing one by one, for fewer sequences.

Defined cases: a null or empty text is the end id alone; null and repeated ids
are packed like any other row; text of any length is tokenised whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .chat import load_encoding
from .common import cut, long_ids, read_table, tokenizer_file, whole_texts

CAPACITY = 1024
OPEN_BINS = 4096
END_ID = 2
#: Pieces that one packing task takes.
TASK_PIECES = 1 << 18
SCHEMA = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Open bins by free space. `add` returns (bin number, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return at

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to those of the whole-text encoder.

    The pre-tokeniser's pattern always breaks before a space that stands between
    two characters that aren't white space, so a text without other uses of the
    space can be cut there and the pieces looked up. Other texts are encoded whole.
    """

    def __init__(self, ranks_file: str, remembered: int = 400_000):
        self.coding = load_encoding(ranks_file, special=True)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.odd = re.compile(r" \s")

    def encode(self, text: str) -> bytes:
        return self.coding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        known = self.known
        out = [self.encode(first)]
        for word in rest:
            got = known.get(word)
            if got is None:
                got = self.encode(" " + word)
                if len(known) < self.remembered and len(word) < 64:
                    known[word] = got
            out.append(got)
        return b"".join(out)


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, ranks_file: str | None = None) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ranks_file = ranks_file or tokenizer_file("byte_bpe_50k.tiktoken")
    end = END_ID.to_bytes(4, "little")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ChunkEncoder(ranks_file)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = encode(text) + end
                for k, (start, length) in enumerate(pieces(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            b = b.sort_values("length", ascending=False, kind="stable")
            placed = [bins.add(length) for length in b["length"].tolist()]
            yield b.assign(sequence_id=[base + at for at, _ in placed], offset=[offset for _, offset in placed])

    found = cut(whole_texts(documents).mapInPandas(split, SCHEMA.rsplit(", ", 2)[0]))
    return long_ids(found.repartition(max(1, -(-found.count() // TASK_PIECES))).mapInPandas(pack, SCHEMA))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
