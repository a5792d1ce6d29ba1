"""SimHash near-duplicates by the pigeonring principle.

A fingerprint's 64 bits stand in a ring of eight segments. If two fingerprints
differ in at most four bits, some segment starts a chain whose differences stay
within the proportional budgets at every length: l segments hold at most l/2
differing bits. So a chain of 2z-1 segments has z equal ones, at least t of them
among the first 2t-1; the possible places of these are the join keys. z grows with the
number of distinct fingerprints, so that buckets stay small. A pair is compared
in the first key that it shares, along its chain and then in full.

Buckets with many members are never paired out: their members are keyed again
with one more equal segment, and what is still crowded at four goes through fixed-size
blocks that emit only a spanning forest. Every level is exact.

Defined cases: null text is empty; texts without words have fingerprint zero and
link like any other; equal fingerprints are one node; a null id takes its
fingerprint's component but never names one (the component is null if no row
of it has an id); repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard as ngrams
from .common import cut, long_ids, read_table, small_batches, whole_texts
from .components import connected_components

SHINGLE = 4
LINK_BITS = 4
SEED = 42
SEGMENTS, WIDTH = 8, 8
CROWDED = 64
#: Crowded buckets that may be broadcast: sixteen bytes each.
FEW = 10_000
BLOCK = 8192


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # both treat ASCII alone
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)})

    return long_ids(whole_texts(documents).mapInPandas(run, "doc_id string, fp long"))


def ring_mask(places, segments: int = SEGMENTS) -> int:
    """Signed 64-bit mask of the given segments."""
    width = 64 // segments
    mask = sum(((1 << width) - 1) << (width * (s % segments)) for s in places)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def chain_keys(equal: int, bits: int = LINK_BITS, segments: int = SEGMENTS) -> list[tuple[int, tuple[int, ...]]]:
    """(start, equal segments) of every shortest chain within budget that has `equal` equal segments; one of each set of segments.

    Of the first l segments of such a chain at most l * bits // segments differ, so all others are equal.
    """
    sure = [n - n * bits // segments for n in range(segments + 1)]  # equal ones among the first n
    length = next(n for n in range(1, segments + 1) if sure[n] >= equal)
    found: dict[frozenset, tuple[int, tuple[int, ...]]] = {}
    for start in range(segments):
        for rest in combinations(range(1, length), equal - 1):
            chain = (0, *rest)
            if all(sum(s < n for s in chain) >= sure[n] for n in range(1, length + 1)):
                places = tuple((start + s) % segments for s in chain)
                found.setdefault(frozenset(places), (start, places))
    return list(found.values())


def ring_test(x: str, bits: int = LINK_BITS, segments: int = SEGMENTS) -> str:
    """SQL: some chain of x, the differing bits, keeps its budget at each length. True of every pair with at most `bits`."""
    return "(" + " or ".join(
        "(" + " and ".join(f"bit_count({x} & {_literal(ring_mask(range(start, start + l), segments))}) <= {l * bits // segments}" for l in range(1, segments)) + ")"
        for start in range(segments)
    ) + ")"


def _literal(mask: int) -> str:
    return f"cast('{mask}' as bigint)" if mask == -(1 << 63) else f"({mask}L)"


def keyed_by(nodes: DataFrame, keys: list[tuple[int, tuple[int, ...]]], segments: int = SEGMENTS) -> DataFrame:
    """(node, fp) -> node, fp, k, v: one row for each key."""
    each = ", ".join(f"struct({i} as k, fp & {_literal(ring_mask(places, segments))} as v)" for i, (_, places) in enumerate(keys))
    return nodes.select("node", "fp", F.expr(f"inline(array({each}))"))


def pairs_of(keyed: DataFrame, keys: list[tuple[int, tuple[int, ...]]], bits: int = LINK_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) within the buckets (k, v), found through chains; each in the first key that it shares."""
    x = "(l.fp ^ r.fp)"
    masks = ",".join(str(ring_mask(places, segments)) for _, places in keys)  # one constant of the plan, however many keys there are
    first = f"array_position(transform(cast(split('{masks}', ',') as array<bigint>), m -> {x} & m = 0L), true) = l.k + 1"
    # with many segments the test of all chains is too long to be compiled; the keys are chains already, and the full count comes next
    ring = ring_test(x, bits, segments) if segments <= SEGMENTS else "true"
    on = F.expr(f"l.k = r.k and l.v = r.v and l.fp < r.fp and if({ring} and bit_count({x}) <= {bits}, {first}, false)")
    return keyed.alias("l").join(keyed.alias("r").hint("merge"), on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def forest(fps: np.ndarray, bits: int = LINK_BITS) -> list[tuple[int, int]]:
    """Spanning forest (positions) of the links among fps: a search that compares each fingerprint only with those not reached yet."""
    left = np.arange(len(fps))
    edges, front = [], []
    while len(left) or front:
        if not front:
            front, left = [left[0]], left[1:]
            continue
        at = front.pop()
        near = np.bitwise_count((fps[left] ^ fps[at]).view(np.uint64)) <= bits
        edges += [(int(at), int(i)) for i in left[near]]
        front += list(left[near])
        left = left[~near]
    return edges


def block_links(keyed: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """Links of crowded buckets: members fall into blocks of a bounded size by hash, and every two blocks of a bucket meet in one task, which emits a spanning forest."""
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = keyed.join(sizes.hint("merge"), ["k", "v"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    meet = placed.select("k", "v", "node", "fp", F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) as i, greatest(o, block) as j))")).alias("m"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        fps, nodes = g["fp"].to_numpy(np.int64), g["node"].to_numpy(np.int64)
        edges = forest(fps, bits)
        return pd.DataFrame({"a": [nodes[i] for i, _ in edges], "b": [nodes[j] for _, j in edges]}, dtype=np.int64)

    return meet.select("k", "v", "m.i", "m.j", "node", "fp").groupBy("k", "v", "i", "j").applyInPandas(run, "a long, b long")


def links(nodes: DataFrame, bits: int = LINK_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(node, fp), one row per fingerprint -> (a, b) links whose components are those of all links of at most `bits` bits."""
    n, width = nodes.count(), 64 // segments
    least, deepest = 16 // width, (32 if width >= 8 else 24) // width  # keys of 16 bits or more
    equal = next((z for z in range(least, deepest) if n <= 1 << (width * z + 2)), deepest)
    if segments > SEGMENTS:
        deepest = equal  # keys are so many that a crowd is cheaper in blocks than under more of them
    found = None
    while True:
        keys = chain_keys(equal, bits, segments)
        keyed = keyed_by(nodes, keys, segments)
        sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
        crowded = sizes.where(F.col("n") > CROWDED).select("k", "v")
        calm = sizes.where((F.col("n") > 1) & (F.col("n") <= CROWDED)).select("k", "v")
        pairs = pairs_of(keyed.join(calm.hint("merge"), ["k", "v"]), keys, bits, segments)
        found = pairs if found is None else found.union(pairs)
        crowded = cut(crowded)
        few = crowded.count()
        if not few:
            return found
        # a list of checked size goes to the rows; a longer one is met by key
        in_crowds = cut(keyed.join(F.broadcast(crowded) if few <= FEW else crowded.hint("merge"), ["k", "v"], "left_semi"))
        if equal >= deepest or segments - bits <= equal:
            return found.union(block_links(in_crowds, bits))
        nodes, equal = in_crowds.select("node", "fp").distinct(), equal + 1


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, bits: int = LINK_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, text) -> doc_id, fp, component_id. Shingles are of `shingle` words, links of `bits` bits at the most, found in a ring of `segments`."""
    marked = cut(fingerprints(documents, shingle))
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = connected_components(links(least.select(F.col("fp").alias("node"), "fp"), bits, segments))  # by fingerprint: rows without an id connect too
    placed = cut(least.join(named.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(names.hint("merge"), "component").select("fp", "component_id")
    return marked.join(of_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def jaccard(a: str, b: str, shingle: int) -> float:
    """Of the word shingles of two texts, as `fingerprint` takes them."""
    sets = []
    for text in (a, b):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        sets.append({tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def without_copies(documents: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row of each group of near copies, with all columns: that of the smallest id, rows without an id last.

    Texts are alike whose sets of shingles have a Jaccard similarity of at least `least`, and groups are what such pairs connect. Links between
    fingerprints are candidates, but few pairs at 0.8 have them; the n-gram join has every pair that is alike. Both are decided on the whole sets.
    Texts without words are all alike. Of equal rows one stays.
    """
    base = documents.select("doc_id", "text")
    with small_batches(documents.sparkSession):
        weights = ngrams.word_weights(base)
        rows, nodes = ngrams.named_sets(base, weights, shingle, least)
        prints = cut(nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("node")))  # sets of one fingerprint are candidates too
        of_print = nodes.where("size > 0").select("fp", F.col("node").alias("a")).join(prints.select("fp", F.col("node").alias("b")).hint("merge"), "fp").where("a <> b").select("a", "b")
        found = ngrams.set_links(base, nodes, weights, shingle, least, more=links(prints).union(of_print))
        named = connected_components(found)
    placed = nodes.select("node", "h1", "h2").join(named.hint("merge"), "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    of_row = cut(rows.join(placed.hint("merge"), ["h1", "h2"]).select("component", "mark", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark").alias("place")))
    stay = of_row.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.mark").alias("mark"))
    marked = documents.select(F.struct("*").alias("whole"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"))
    kept = marked.join(stay.hint("merge"), "mark", "left_semi")
    repeated = of_row.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    repeated = cut(repeated.join(stay.hint("merge"), "mark", "left_semi"))
    if not repeated.isEmpty():
        several = kept.join(repeated.hint("merge"), "mark", "left_semi").groupBy("mark").agg(F.first("whole").alias("whole")).select("whole", "mark")
        kept = kept.join(repeated.hint("merge"), "mark", "left_anti").select("whole", "mark").union(several)
    return kept.select(*[F.col(f"whole.`{c}`").alias(c) for c in documents.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
