"""Exact Jaccard join of documents on word n-grams by their rarest ones.

A document is the set of its n-grams. All sets are in one global order, rarest first: an n-gram's weight is the sum of its words'
logarithmic counts over all documents (words fall into a table of fixed size, which can change the order but no result), ties by
hash. Equal sets are one node.

Two sets of the wanted similarity share one of the rarest tenth of their n-grams, so these are keys. The sizes that a key's sets have
fall into classes; classes next to each other form a chain, and the smallest node of a chain is the head of all its sets. What
may be similar therefore meets under one head at least, and a family of near copies under few. Under a head a probe meets the sets that hold
one of its keys, found by lists, and only those are counted against the overlap that they need; sets without a common key cost nothing. This is
done with the rarest n-grams alone first, which drops most sets and joins the others into clusters, and then with the whole sets of each cluster,
so that a set moves once. Two sets that earlier links connect needn't be compared: a family costs one probe, that of its first set, not all pairs.

A cluster too large for a task is taken apart again by heads, and what is still too large is dealt to parts that all hold one set, the first. Only what isn't connected with it in its own part, then
meets the other parts, block by block.

Words, n-grams and sets are compared by hashes of 64, 64 and 128 bits.

Defined cases: null text is empty; a text without words is linked with nothing, and its component is its own id; with fewer words than `n` the
whole sequence is the one n-gram; a null id takes its component's name but never gives one (null if no row has an id); repeated rows stay;
an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, long_ids, read_table, small_batches
from .components import connected_components

WORDS = 3
#: Least similarity as a fraction.
LEAST = (9, 10)
#: Entries of the table of word counts.
SLOTS = 1 << 18
#: A set's rarest n-grams that clusters are made by are one in so many of all, its keys at the least: the more, the fewer sets seem alike that aren't.
CLUSTERED = 5
#: Words, 64 bits each, of the bitmap that texts must pass before they are moved.
BITMAP = 1 << 18
#: N-grams, eight bytes each, that one task holds of a group.
PART = 4_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class WordHashes:
    """Hashes of a text's words: of each word's bytes a polynomial, by differences of one running sum over the text, then mixed."""

    BASE = 0x9FB21C651E98DF25
    LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
    SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        """Powers of BASE and of its inverse, modulo 2 ** 64."""
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            steps = [np.full(size, b, dtype=np.uint64) for b in (self.BASE, pow(self.BASE, -1, 1 << 64))]
            for s in steps:
                s[0] = 1
            self.up, self.down = map(np.cumprod, steps)

    def of(self, text: str) -> np.ndarray:
        data = self.LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~self.SPACE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        self.powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.down[starts]
        for mix in _MIX[:2]:
            found = (found ^ (found >> np.uint64(32))) * mix
        return found ^ (found >> np.uint64(29))


def ngrams(words: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct n-grams of hashed words, the lightest first."""
    if not len(words):
        return words
    if len(words) < n:
        size, weight = len(words), np.zeros(1, dtype=np.int64)
    else:
        size, of_word = n, weights[words & np.uint64(SLOTS - 1)].astype(np.uint16 if n < 256 else np.int64)
        weight = of_word[: len(words) - n + 1].copy()
        for k in range(1, n):
            weight += of_word[k : len(words) - n + 1 + k]
    count = len(words) - size + 1
    found = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        found = (found ^ (found >> np.uint64(29))) * _MIX[k % 2] + words[k : k + count]
    found = (found ^ (found >> np.uint64(32))) * _MIX[2]
    order = np.argsort(found)
    found = found[order]
    new = np.ones(count, dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    found, order = found[new], order[new]
    return found[np.argsort(weight[order], kind="stable")]  # short numbers, which numpy sorts by their digits


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id as text, text, and mark, which tells rows of another id or text apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("mark"), text.alias("text"))


def word_weights(documents: DataFrame) -> np.ndarray:
    """Logarithmic counts of all words of all documents, by the low bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(SLOTS, dtype=np.int64)
        held, size = [], 0
        for b in batches:
            for text in b["text"]:  # one text at a time leaves Arrow's memory
                held.append((hashes.of(text.as_py()) & np.uint64(SLOTS - 1)).astype(np.int32))
                size += len(held[-1])
                if size >= SLOTS:  # counted together, as a count reads the whole table
                    counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SLOTS)
        used = np.flatnonzero(counts)
        yield pa.record_batch({"slot": used, "n": counts[used]})

    counted = texts_of(documents).select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    weights = np.zeros(SLOTS, dtype=np.uint8)
    weights[counted["slot"].to_numpy(dtype=np.int64)] = np.round(4 * np.log2(1.0 + counted["n"].to_numpy(dtype=np.float64))).astype(np.uint8)
    return weights


def key_count(size: int, least: tuple[int, int] = LEAST) -> int:
    """The number of rarest n-grams of which a similar set has one: all but the least overlap, and one more."""
    return size - -(-size * least[0] // least[1]) + 1


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    bits = (np.unpackbits(hashes[at : at + 65_535].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16) for at in range(0, len(hashes), 65_535))
    return np.packbits(sum(bits, np.zeros(64, dtype=np.int64)) * 2 > len(hashes), bitorder="little").view(np.int64)[0]


def sets_of(documents: DataFrame, weights: np.ndarray, n: int = WORDS, least: tuple[int, int] = LEAST, prints: bool = True) -> DataFrame:
    """-> doc_id, mark, size, h1, h2 (the set's digest), keys (its rarest n-grams, eight bytes each, the first of which are keys), fp (bits that more than half of its hashes have; zero without `prints`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for b in batches:
            rows = []
            for text in b["text"]:
                found = ngrams(hashes.of(text.as_py()), weights, n)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64)
                fp = majority(found) if prints else 0
                rows.append((len(found), digest[0], digest[1], found[: max(key_count(len(found), least), len(found) // CLUSTERED + 2)].tobytes() if len(found) else b"", fp))
            size, h1, h2, keys, fp = zip(*rows) if rows else [()] * 5
            long = lambda x: np.array(x, dtype=np.int64)
            yield pa.record_batch({"doc_id": b["doc_id"], "mark": b["mark"], "size": long(size), "h1": long(h1), "h2": long(h2), "keys": pa.array(keys, pa.binary()), "fp": long(fp)})

    return long_ids(texts_of(documents).mapInArrow(run, "doc_id string, mark long, size long, h1 long, h2 long, keys binary, fp long"))


def passing(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose mark may be among `marks`: those that a bitmap of BITMAP words, sent to every task, doesn't rule out. So most texts that nobody asks for stay where they are."""
    word = lambda c: F.expr(f"cast(pmod({c}, {BITMAP}) as int)")
    bit = "shiftleft(1L, cast(pmod(shiftright(mark, 32), 64) as int))"
    bitmap = marks.groupBy(word("mark").alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits"))  # BITMAP rows at most
    return rows.withColumn("word", word("mark")).join(F.broadcast(bitmap), "word").where(F.expr(f"bits & {bit} <> 0")).drop("word", "bits")


def with_texts(documents: DataFrame, seats: DataFrame) -> DataFrame:
    """(mark, ..) -> the same columns without mark, and the text that the mark belongs to. A text moves in place of its n-grams, which are several times as long and can't be compressed."""
    rest = [c for c in seats.columns if c != "mark"]
    of_mark = seats.groupBy("mark").agg(F.collect_list(F.struct(*rest)).alias("seats"))  # one a set, but for the seats of what a large cluster shares
    texts = passing(texts_of(documents).select("mark", "text"), seats.select("mark"))
    met = texts.join(of_mark.hint("merge"), "mark")
    once = met.groupBy("mark").agg(F.first("text").alias("text"), F.first("seats").alias("seats"))  # a row may be repeated
    return once.select("text", F.explode("seats").alias("seat")).select("seat.*", "text")


def trie_of(texts: Iterable[pa.StringScalar], hashes: WordHashes, weights: np.ndarray, n: int, least: tuple[int, int]) -> Trie:
    sets = [ngrams(hashes.of(t.as_py()), weights, n) for t in texts]
    return Trie(sets, [len(s) for s in sets], least)


def shared_heads(nodes: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(node, size, keys) -> distinct (head, node) pairs, heads with themselves included, under which all sets that may be similar meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["size"].to_numpy()
            parts = [k[: key_count(size, least)] if size else k for size, k in zip(sizes.tolist(), _sequences(b["keys"], np.int64))]
            counts = [len(p) for p in parts]
            if sum(counts):
                yield pa.record_batch({"key": np.concatenate(parts), "node": np.repeat(b["node"].to_numpy(), counts), "size": np.repeat(sizes, counts)})

    keyed = nodes.select("node", "size", "keys").mapInArrow(run, "key long, node long, size long")
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).where("n > 1").select("key", "lo", "hi")
    ratio = least[1] / least[0]
    # sizes of similar sets are within `ratio`, so in one class or in two next to each other; the small term keeps rounding on the safe side
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(ratio * (1 + 1e-9)))).cast("int")
    rows = cut(keyed.join(often.hint("merge"), "key").select("key", "node", band.alias("band")))
    cells = rows.groupBy("key", "band").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n"))
    by_band = W.partitionBy("key").orderBy("band")  # as many rows as there are classes of sizes
    chained = cells.withColumn("gap", F.when(F.col("band") - F.lag("band").over(by_band) <= 1, 0).otherwise(1)).withColumn("chain", F.sum("gap").over(by_band))
    chain = W.partitionBy("key", "chain")
    heads = chained.select("key", "band", F.min("low").over(chain).alias("head"), F.sum("n").over(chain).alias("n")).where("n > 1")
    return rows.join(heads.hint("merge"), ["key", "band"]).select("head", "node").distinct()


class Trie:
    """Index of a group: its sets as ids, and by each of their keys the sets that have it; `sizes` are those of the whole sets, whose first n-grams the sequences may be.

    A probe reads the lists of its own keys, so sets that share none of them cost it nothing, however many the group has. What is left of
    them is counted at once, by a table of the probe's n-grams.
    """

    def __init__(self, sequences: list[np.ndarray], sizes: list[int], least: tuple[int, int] = LEAST):
        self.p, self.q = least
        self.sizes, self.lengths = np.array(sizes, dtype=np.int64), np.array([len(s) for s in sequences], dtype=np.int64)
        self.whole = bool((self.sizes == self.lengths).all())
        dense, count = self._ids(np.concatenate(sequences))
        self.has = np.zeros(count, dtype=np.uint8)
        ends = np.append(0, np.cumsum(self.lengths))
        self.sets = [dense[a:b][::-1] for a, b in zip(ends, ends[1:])]  # the commonest first
        keys = np.minimum(self.sizes - -(-self.sizes * self.p // self.q) + 1, self.lengths)
        self.keys = np.append(0, np.cumsum(keys))
        of = np.concatenate([dense[a : a + k] for a, k in zip(ends, keys)])
        order = np.argsort(of, kind="stable").astype(np.int32)
        edge = np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), len(of)).astype(np.int32)
        self.start, self.many = np.empty(len(of), dtype=np.int32), np.empty(len(of), dtype=np.int32)
        self.start[order], self.many[order] = np.repeat(edge[:-1], np.diff(edge)), np.repeat(np.diff(edge), np.diff(edge))
        self.holders = np.repeat(np.arange(len(sequences), dtype=np.int32), keys)[order]

    @staticmethod
    def _ids(every: np.ndarray) -> tuple[np.ndarray, int]:
        """Ranks of the values among all different ones, and how many these are."""
        order = np.argsort(every)
        every = every[order]
        new = np.ones(len(every), dtype=bool)
        np.not_equal(every[1:], every[:-1], out=new[1:])
        del every
        ids = np.cumsum(new, dtype=np.int32) - np.int32(1)
        dense = np.empty(len(ids), dtype=np.int32)
        dense[order] = ids
        return dense, int(ids[-1]) + 1 if len(ids) else 0

    def needed(self, x, size):
        """Overlap of whole sets of these sizes that are similar."""
        return -(-self.p * (x + size) // (self.p + self.q))

    def like(self, i: int, keep=None) -> list[int]:
        """Sets that are similar to set i or, where sequences are a part of their sets, may be; of those that `keep` lets through, a mask of an array of sets."""
        a, b = self.keys[i], self.keys[i + 1]
        start, many = self.start[a:b], self.many[a:b]
        some = many > 1
        if not some.any():
            return []
        near = np.unique(self.holders[_places(start[some].astype(np.int64), many[some])])
        x = self.sizes[i]
        size = self.sizes[near]
        fine = (near != i) & (np.minimum(x, size) * self.q >= self.p * np.maximum(x, size))
        if keep is not None:
            fine &= keep(near)
        near, size = near[fine], size[fine]
        if not len(near):
            return []
        need = self.needed(x, size)
        if not self.whole:
            # of the first n-grams of both, those that come before the end of either
            need = np.minimum(self.lengths[i], self.lengths[near]) - (np.maximum(x, size) - need)
        return near[self._shared(i, near) >= need].tolist()

    def _shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """N-grams that set i shares with each of the others, of which a bounded number is read at once."""
        self.has[self.sets[i]] = 1
        before = np.append(0, np.cumsum(self.lengths[others]))
        out, at = np.empty(len(others), dtype=np.int64), 0
        while at < len(others):
            end = max(at + 1, int(np.searchsorted(before, before[at] + PART // 16, "right")) - 1)
            read = np.concatenate([self.sets[j] for j in others[at:end]])
            out[at:end] = np.add.reduceat(self.has[read], before[at:end] - before[at], dtype=np.int64)
            at = end
        self.has[self.sets[i]] = 0
        return out


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all items of lists that start at `starts`."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]))


class Joined:
    """Components of a group's sets: `of` has the first of each set's component."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, others: list[int]) -> None:
        tops = np.unique(self.of[[i, *others]])
        if len(tops) > 1:
            self.of[np.isin(self.of, tops)] = tops[0]


def forest(trie: Trie, first: int, all_pairs: bool = False) -> tuple[list[tuple[int, int]], Joined]:
    """Links of the trie's sets whose components are those of all links, or all links; from `first`, then from every set that isn't connected with it."""
    joined, links = Joined(len(trie.sets)), []
    asked = np.zeros(len(trie.sets), dtype=bool)
    for i in [first, *(j for j in range(len(trie.sets)) if j != first)]:
        if not all_pairs and i != first and joined.of[i] == joined.of[first]:
            continue
        # what was asked before has met this set already
        found = trie.like(i, lambda js: ~asked[js] & (True if all_pairs else joined.of[js] != joined.of[i]))
        asked[i] = True
        if found:
            links += [(i, j) for j in found]
            joined.join(i, found)
    return links, joined


def groups_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Groups of rows that arrive sorted by `by`, as columns: numbers in arrays of numpy, texts and bytes in Arrow's. One is held at a time."""
    held: list[dict] = []
    key = None

    def whole() -> dict:
        if len(held) == 1:
            return held[0]
        return {c: np.concatenate([h[c] for h in held]) if isinstance(v, np.ndarray) else pa.chunked_array([h[c] for h in held]) for c, v in held[0].items()}

    for b in batches:
        if not b.num_rows:
            continue
        columns = {n: c if pa.types.is_string(c.type) or pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns)}
        marks = np.column_stack([columns[c] for c in by])
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for a, e in zip(edges, edges[1:]):
            now = tuple(marks[a].tolist())
            if now != key and held:
                yield key, whole()
                held = []
            key = now
            held.append({n: c[a:e] for n, c in columns.items()})
    if held:
        yield key, whole()


def sorted_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by)


def _sequences(column, of: type = np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=of) for x in column]


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows) if rows else [()] * len(names))})


def likely(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(head, node) pairs -> (head, top, node): under each head the sets that keys alone connect, called by the first of them. What no other set may be like is gone.

    Groups too large for one task are taken as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (head,), g in groups_of(batches, ["head"]):
            ids = g["node"]
            if len(ids) < 2:
                continue
            trie = Trie(_sequences(g["keys"]), g["size"].tolist(), least)
            trie.whole = False
            _, joined = forest(trie, int(np.flatnonzero(ids == head)[0]))
            tops = joined.of
            kept = np.bincount(tops)[tops] > 1
            yield pa.record_batch({"head": np.full(int(kept.sum()), head), "top": ids[tops[kept]], "node": ids[kept]})

    sized = pairs.join(nodes.select("node", "size").hint("merge"), "node")
    large = cut(sized.groupBy("head").agg(F.sum("size").alias("load")).where(F.col("load") * max(1 - least[0] / least[1], 1 / CLUSTERED) > PART).select("head"))
    calm = pairs.join(large.hint("merge"), "head", "left_anti").join(nodes.select("node", "size", "keys").hint("merge"), "node").select("head", "node", "size", "keys")
    whole = pairs.join(large.hint("merge"), "head", "left_semi").select("head", F.col("head").alias("top"), "node")
    return sorted_by(calm, "head").mapInArrow(run, "head long, top long, node long").union(whole)


def clusters(local: DataFrame, nodes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(head, top, node) -> the same, and mark, size and parts: groups that all possible links stand in, `top` being one of each.

    Groups that share a set become one, so that a set moves once, as long as one task holds the whole; else they stay apart. `more` are
    further pairs (a, b) that may be similar.
    """
    edges = local.where("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b"))
    named = cut(connected_components(edges if more is None else edges.union(more)).select("node", F.col("component").alias("cluster")))
    known = nodes.select("node", "mark", "size")
    member = cut(named.join(known.hint("merge"), "node"))
    loads = cut(member.groupBy("cluster").agg(F.sum("size").alias("load")).where(F.col("load") > PART).select("cluster"))
    small = member.join(loads.hint("merge"), "cluster", "left_anti").select(F.col("cluster").alias("head"), F.col("cluster").alias("top"), "node", "mark", "size", F.lit(1).alias("parts"))
    of_large = member.join(loads.hint("merge"), "cluster", "left_semi").select("node", "mark", "size")
    apart = cut(local.join(of_large.hint("merge"), "node").select("head", "top", "node", "mark", "size"))
    parts = apart.groupBy("head", "top").agg(F.ceil(F.sum("size") / PART).cast("int").alias("parts"))
    return small.union(apart.join(parts.hint("merge"), ["head", "top"]).select(*small.columns))


def set_links(documents: DataFrame, nodes: DataFrame, weights: np.ndarray, n: int = WORDS, least: tuple[int, int] = LEAST, all_pairs: bool = False, more: DataFrame | None = None) -> DataFrame:
    """(node, mark, size, keys), one row a set -> links (a, b): all of them, or as many as connect what all of them connect. `more` are candidates (a, b) from elsewhere."""
    local = cut(likely(cut(shared_heads(nodes, least)), nodes, least))
    dealt = cut(clusters(local, nodes, more).withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)")))
    # every part holds the group's first set
    columns = ["head", "top", "node", "mark", "part", "parts"]
    seats = dealt.where("node <> top").select(*columns).union(dealt.where("node = top").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for (head, top, _), g in groups_of(batches, ["head", "top", "part"]):
            ids, several = g["node"].tolist(), int(g["parts"][0]) > 1
            trie, first = trie_of(g["text"], hashes, weights, n, least), ids.index(top)
            links, joined = forest(trie, first, all_pairs=all_pairs)
            rows = [(ids[i], ids[j], None, None) for i, j in links]
            if several:
                rows += [(i, None, head, top) for k, i in enumerate(ids) if i != top and (all_pairs or joined.of[k] != joined.of[first])]
            yield _rows(rows, "a", "b", "head", "top")

    met = sorted_by(with_texts(documents, seats), "head", "top", "part")
    found = cut(met.mapInArrow(run, "a long, b long, head long, top long"))
    links = found.where("b is not null").select("a", "b")
    loose = found.where("b is null").select("head", "top", F.col("a").alias("node"))
    if not loose.isEmpty():
        links = links.union(loose_links(documents, cut(loose), dealt, weights, n, least, all_pairs))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def loose_links(documents: DataFrame, loose: DataFrame, dealt: DataFrame, weights: np.ndarray, n: int, least: tuple[int, int], all_pairs: bool) -> DataFrame:
    """Links between sets that aren't connected with their group's first one in their own part, and sets of other parts: blocks of the former meet every part."""
    of = dealt.join(loose.hint("merge"), ["head", "top", "node"], "left_semi")
    blocks = cut(of.groupBy("head", "top").agg(F.ceil(F.sum("size") / PART).cast("int").alias("blocks")))
    columns = ["head", "top", "node", "mark", "part", "block", "probe"]
    placed = of.join(blocks.hint("merge"), ["head", "top"]).withColumns({"block": F.expr("cast(pmod(xxhash64(node, 1), blocks) as int)"), "probe": F.lit(True)})
    probes = placed.withColumn("part", F.explode(F.expr("filter(sequence(0, parts - 1), p -> p <> part)"))).select(*columns)
    members = dealt.join(blocks.hint("merge"), ["head", "top"]).withColumns({"block": F.explode(F.expr("sequence(0, blocks - 1)")), "probe": F.lit(False)}).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, g in groups_of(batches, ["head", "top", "part", "block"]):
            asks, ids = g["probe"], g["node"].tolist()
            if asks.all() or not asks.any():
                continue
            trie, joined, rows = trie_of(g["text"], hashes, weights, n, least), Joined(len(ids)), []
            for i in np.flatnonzero(asks).tolist():
                found = trie.like(i, lambda js: ~asks[js] & (True if all_pairs else joined.of[js] != joined.of[i]))
                rows += [(ids[i], ids[j]) for j in found]
                joined.join(i, found)
            yield _rows(rows, "a", "b")

    met = with_texts(documents, probes.union(members))
    return sorted_by(met, "head", "top", "part", "block").mapInArrow(run, "a long, b long")


def named_sets(documents: DataFrame, weights: np.ndarray, n: int = WORDS, least: tuple[int, int] = LEAST, prints: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, size, h1, h2), and one row per set, the empty one too: node, h1, h2, low (the smallest id), mark, size, keys, fp."""
    rows = cut(sets_of(documents, weights, n, least, prints))
    same = ["size", "keys", "fp"]
    groups = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.min("mark").alias("mark"), *[F.first(c).alias(c) for c in same])
    return rows.select("doc_id", "mark", "size", "h1", "h2"), cut(groups).withColumn("node", F.monotonically_increasing_id())


def similar_documents(documents: DataFrame, n: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id."""
    documents = documents.select("doc_id", "text")
    with small_batches(documents.sparkSession):
        weights = word_weights(documents)
        rows, nodes = named_sets(documents, weights, n, least, prints=False)
        found = connected_components(set_links(documents, nodes, weights, n, least))
    placed = cut(nodes.select("node", "h1", "h2", "low").join(found.hint("merge"), "node", "left").select("h1", "h2", "low", F.coalesce("component", "node").alias("component")))
    names = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    of_set = placed.join(names.hint("merge"), "component").select("h1", "h2", "component_id")
    out = rows.join(of_set.hint("merge"), ["h1", "h2"])
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_pairs(documents: DataFrame, n: int = WORDS, least: tuple[int, int] = LEAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> all links (a, b) between different sets, and membership (doc_id, node, size)."""
    documents = documents.select("doc_id", "text")
    with small_batches(documents.sparkSession):
        weights = word_weights(documents)
        rows, nodes = named_sets(documents, weights, n, least, prints=False)
        links = set_links(documents, nodes, weights, n, least, all_pairs=True)
    return links, rows.join(nodes.select("h1", "h2", "node").hint("merge"), ["h1", "h2"]).select("doc_id", "node", "size")


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))


OP12_SQL = """
with recursive words as (
    select row_number() over () as k, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
    from documents
), grams as (
    select k, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as g
    from words
), sizes as (
    select k, count(*) as n from grams group by k
), shared as (
    select a.k as a, b.k as b, count(*) as n from grams a join grams b on a.g = b.g and a.k < b.k group by a.k, b.k
), links as (
    select s.a, s.b from shared s join sizes x on x.k = s.a join sizes y on y.k = s.b where 100 * s.n >= 90 * (x.n + y.n - s.n)
), edges as (
    select a, b from links union all select b, a from links
), reached as (
    select k as a, k as b from words
    union
    select r.a, e.b from reached r join edges e on e.a = r.b
)
select any_value(w.doc_id) as doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(o.doc_id) as component_id
from words w left join sizes s on s.k = w.k join reached r on r.a = w.k join words o on o.k = r.b group by w.k
"""
