"""SentencePiece encoding and decoding with the N best segmentations.

A text is a lattice of the model's pieces. The forward Viterbi score of a
position is the exact value of the best way to it, so a backward A* search that
adds it to the score of what it already holds pops whole segmentations in order,
best first. No piece has a space mark after another character, so the lattice
falls apart at spaces; each stretch is searched once and remembered, and the N best of
the text are found by the same search over the stretches whose second-best is nearest.

Scores are the model's own, added up, held as exact integers with the number of ids as their lowest
digits. A character without a piece becomes its bytes, at a cost below all others. Defined cases: null text is empty and has one
segmentation without pieces; of equal scores the one with fewer pieces comes first, and of these the one that departs from the
best earlier in the text; the first ranks are the same whatever N; a text with fewer than N segmentations has
fewer rows; a literal space mark (U+2581) is kept apart from spaces as bytes; texts of any length are
segmented whole.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import long_ids, read_table, tokenizer_file, whole_texts

MARK = "▁"
UNKNOWN = -2e9
#: A cost above all others: no way.
FAR = 1 << 200
BEST = 3
#: Models that this process has read, by file.
KEPT: dict[str, Pieces] = {}


class Pieces:
    """A piece model: `pieces` maps text to (id, score), `bytes_at` is the id of byte 0."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_at: int, remembered: int = 800_000):
        self.pieces, self.bytes_at = pieces, bytes_at
        #: Beginnings of pieces, character by character: [id or -1, cost, how it goes on].
        self.begun: dict[str, list] = {}
        for p, (i, score) in pieces.items():
            on = self.begun
            for c in p:
                node = on.setdefault(c, [-1, 0, {}])
                on = node[2]
            node[:2] = i, self.cost(score, 1)
        self.longest = max(map(len, pieces), default=1)
        self.touching = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        #: What each id stands for, in UTF-8: ids of bytes are joined with the others before any is read as text.
        self.raw: list[bytes] = [b""] * max([bytes_at + 256, *(i + 1 for i, _ in pieces.values())])
        self.raw[bytes_at : bytes_at + 256] = [bytes([b]) for b in range(256)]
        for p, (i, _) in pieces.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        self.known: dict[str, tuple[int, bytes, int]] = {}
        self.remembered = remembered
        self.stretch = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """One model for each worker process: what a task has searched, the next ones there remember."""
        if model_file not in KEPT:
            KEPT[model_file] = cls.read(model_file)
        return KEPT[model_file]

    @classmethod
    def read(cls, model_file: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        plain = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        return cls(plain, next(i for i in range(size) if sp.is_byte(i)))

    def byte_ids(self, text: str) -> tuple[int, ...]:
        return tuple(self.bytes_at + b for b in text.encode("utf-8", "surrogatepass"))

    def lattice(self, s: str) -> tuple[list[int], list[list]]:
        """Least cost of a way to each position, and the edges (start, cost, id or byte ids) by end."""
        size, begun = len(s), self.begun
        forward = [0] + [FAR] * size
        edges: list[list] = [[] for _ in range(size + 1)]
        for start in range(size):
            here = forward[start]
            on, end = begun, start
            for c in s[start : start + self.longest]:
                end += 1
                node = on.get(c)
                if node is None or node[0] < 0:
                    if end > start + 1:
                        if node is None:
                            break  # no piece goes on like this
                        on = node[2]
                        continue
                    own = self.byte_ids(c)
                    cost = self.cost(UNKNOWN, len(own))
                else:
                    own, cost, _ = node
                edges[end].append((start, cost, own))
                forward[end] = min(forward[end], here + cost)
                if node is None:
                    break
                on = node[2]
        return forward, edges

    def search(self, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (cost, ids) of a stretch: A* from the end, the forward costs being what is left to the start."""
        forward, edges = self.lattice(s)
        size = len(s)
        # (cost of the whole way at best, position, serial) and the way from here to the end; of equal costs the way that
        # has come furthest goes on, else all equal ways of a long repetition would be built side by side
        push, pop, serial = heapq.heappush, heapq.heappop, 0
        heap: list = [(forward[size], 0, 0, 0, size, None)]
        out: list[tuple[int, tuple[int, ...]]] = []
        while heap:
            total, _, _, behind, at, way = pop(heap)
            if not at:
                ids: list[int] = []
                while way is not None:
                    own, way = way
                    ids += own if type(own) is tuple else (own,)
                out.append((total, tuple(ids)))
                if len(out) == n:
                    break
                continue
            for start, cost, own in edges[at]:
                serial += 1
                held = behind + cost
                push(heap, (held + forward[start], start, serial, held, start, (own, way)))
        return out

    @staticmethod
    def cost(score: float, ids: int) -> int:
        """Costs are exact integers; the number of ids breaks ties."""
        return (round(-score * 1024) << 24) + ids

    @staticmethod
    def score(cost: int) -> float:
        return -(cost >> 24) / 1024

    def first(self, s: str | None) -> tuple[int, bytes, int]:
        """Cost and ids (four bytes each) of the best segmentation of a stretch, and what the second-best costs beyond it: one pass forward with the two least costs of each position."""
        if s is None:
            own = self.byte_ids(MARK)
            return self.cost(UNKNOWN, len(own)), array("I", own).tobytes(), FAR
        touching, size = self.touching, len(s)
        at = next((k for k in range(size - 1, 0, -1) if s[k - 1 : k + 1] not in touching), 0) if size < 64 else 0
        if at:  # no piece has these two characters side by side: the lattice falls apart here
            one, two = (self.known.get(x) or self.first(x) for x in (s[:at], s[at:]))
            got = (one[0] + two[0], one[1] + two[1], min(one[2], two[2]))
        else:
            least, second, last = [0] + [FAR] * size, [FAR] * (size + 1), [None] * (size + 1)
            begun, longest = self.begun, self.longest
            for start in range(size):
                here, next_here = least[start], second[start]
                on, end = begun, start
                for c in s[start : start + longest]:
                    end += 1
                    node = on.get(c)
                    if node is None or node[0] < 0:
                        if end > start + 1:
                            if node is None:
                                break  # no piece goes on like this
                            on = node[2]
                            continue
                        own = self.byte_ids(c)
                        cost = self.cost(UNKNOWN, len(own))
                    else:
                        own, cost, _ = node
                    held, old = here + cost, least[end]
                    if held < old:
                        least[end], last[end] = held, (start, own)
                        held = next_here + cost
                        second[end] = old if old < held else held
                    elif held < second[end]:
                        second[end] = held
                    if node is None:
                        break
                    on = node[2]
            ids: list[int] = []
            at = size
            while at:
                at, own = last[at]
                ids += reversed(own) if type(own) is tuple else (own,)
            got = (least[size], array("I", ids[::-1]).tobytes(), min(FAR, second[size] - least[size]))
        if size < 64 and len(self.known) < self.remembered:
            self.known[s] = got
        return got

    def marked(self, text: str) -> list[str | None]:
        """Stretches of the text with a space in front and spaces as marks; None is a literal mark."""
        out: list[str | None] = []
        for k, part in enumerate((" " + text).split(MARK) if text else ()):
            out += ([None] if k else []) + self.stretch.findall(part.replace(" ", MARK))
        return out

    def spelled(self, ids) -> bytes:
        """What ids stand for, in UTF-8."""
        return b"".join(map(self.raw.__getitem__, ids))

    def packed(self, text: str, n: int = 1, alike: list | None = None) -> list[tuple[float, bytes]]:
        """The n best segmentations: (score, ids of four bytes each), best first. `alike` gets of each but the best whether its ids spell what the best one's do: only stretches that differ need be spelled for that."""
        known = self.known.get
        stretches = self.marked(text)
        if not stretches:
            return [(0.0, b"")]
        costs, ways, gaps = zip(*[known(s) or self.first(s) for s in stretches])
        total = sum(costs)
        out = [(self.score(total), b"".join(ways))]
        # only the n - 1 stretches whose second-best costs least can differ in the n best; of equal ones the earlier
        near = sorted(k for k in least_places(gaps, n - 1) if gaps[k] < FAR)
        if not near:
            return out
        choices = [self.search(stretches[k], n) for k in near]
        # the same search over these: what stands before a place is at its best, so its exact cost beyond the best is zero
        heap, taken = [(0, ())], []
        while heap and len(taken) < n:
            beyond, picks = heapq.heappop(heap)
            if len(picks) == len(near):
                taken.append((beyond, picks[::-1]))
                continue
            options = choices[len(near) - 1 - len(picks)]
            for j, (cost, _) in enumerate(options):
                heapq.heappush(heap, (beyond + cost - options[0][0], (*picks, j)))
        for beyond, picks in taken[1:]:
            other, same = list(ways), True
            for k, c, j in zip(near, choices, picks):
                if j:
                    other[k] = array("I", c[j][1]).tobytes()
                    same = same and self.spelled(c[j][1]) == self.spelled(memoryview(ways[k]).cast("I"))
            out.append((self.score(total + beyond), b"".join(other)))
            if alike is not None:
                alike.append(same)
        return out

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The n best segmentations: (score, ids), best first."""
        return [(score, array("I", ids).tolist()) for score, ids in self.packed(text, n)]

    def decode(self, ids) -> str:
        """The text of any segmentation that `encode` gives."""
        return self.spelled(ids).decode("utf-8", "replace")[1:]


def least_places(values: tuple, n: int) -> list[int]:
    """Places of the n least values, of equal ones the first."""
    if n > 8:
        return sorted(range(len(values)), key=values.__getitem__)[:n]
    left, out = list(values), []
    for _ in range(min(n, len(left))):
        out.append(left.index(min(left)))
        left[out[-1]] = FAR + 1
    return out


def segment(documents: DataFrame, n: int = BEST, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, rank (from 1), score, ids."""
    model_file = model_file or tokenizer_file("piece_bpe_32k.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Pieces.load(model_file)
        for b in batches:
            for at in range(0, len(b), 500):  # ids are several times as large as the text
                part = b[at : at + 500]
                rows = [(doc, k, score, ids) for doc, text in zip(part["doc_id"], part["text"]) for k, (score, ids) in enumerate(model.encode(text, n), 1)]
                yield pd.DataFrame(rows, columns=["doc_id", "rank", "score", "ids"])

    return long_ids(whole_texts(documents).mapInPandas(run, "doc_id string, rank int, score double, ids array<int>"))


def unsegment(segmented: DataFrame, model_file: str | None = None) -> DataFrame:
    """Adds `decoded`, the text that the ids stand for."""
    from pyspark.sql import functions as F

    model_file = model_file or tokenizer_file("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Pieces.load(model_file)
        for i in ids:
            yield i.map(lambda x: model.decode(x.tolist()))

    return segmented.withColumn("decoded", decode("ids"))


def segment_digests(documents: DataFrame, n: int = BEST, model_file: str | None = None) -> DataFrame:
    """As `segment`, with digests in place of ids, and whether they decode to the text: n_pieces, ids_crc32, round_trip."""
    model_file = model_file or tokenizer_file("piece_bpe_32k.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Pieces.load(model_file)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                alike: list[bool] = []
                best, *others = model.packed(text, n, alike)
                back = model.decode(memoryview(best[1]).cast("I")) == text
                for k, ((score, ids), same) in enumerate(zip([best, *others], [True, *alike]), 1):
                    rows.append((doc, k, score, len(ids) // 4, zlib.crc32(ids), back and same))
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip"])

    return long_ids(whole_texts(documents).mapInPandas(run, "doc_id string, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_digests(read_table(spark, sf_dir, "documents"))
