"""The Jaccard join against all pairs."""

import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import jaccard


def shingles(text, n=3):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def linked(a, b, p=9, q=10):
    return bool(a) and bool(b) and q * len(a & b) >= p * len(a | b)


def plain(rows, n=3, p=9, q=10):
    """(doc_id, size, component) by all pairs of rows."""
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and linked(sets[i], sets[j], p, q):
                group = [group[i] if g == group[j] else g for g in group]
    low = {}
    for (doc, _), g in zip(rows, group):
        low[g] = min((x for x in (low.get(g), doc) if x is not None), default=None)
    return sorted(((doc, len(s), low[g]) for (doc, _), s, g in zip(rows, sets, group)), key=str)


def chains(rng, families, length, words, vocabulary=4000, passage=()):
    """Families of texts, each text one or two word edits from the one before, some with a passage that all families share."""
    out = []
    for f in range(families):
        text = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
        for _ in range(length):
            out.append(" ".join([*text, *passage] if rng.random() < 0.5 else text))
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(text))
                text = [*text[:at], *rng.choice([[], [f"x{rng.randrange(10**6)}"], ["w1", "w2"]]), *text[at + 1 :]]
    return out


ODD = [None, "", " \t\n\x0b", "one", "One", "one two", "ONE\ttwo", "two one", "a b c", "a b c a b c", "É b c", "é b c", "ha " * 30, "ha " * 31, "x y z " * 9000, "x y z " * 8999 + "x", "  b"]


@pytest.mark.parametrize("kind", ["odd", "families", "crowd", "parts", "empty"])
def test_components(spark, monkeypatch, kind):
    rng = random.Random(12)
    if kind == "odd":
        rows = [(i if i % 4 else None, t) for i, t in enumerate(ODD + ODD[3:6])] + [(5, "a b c"), (5, "a b c"), (5, "other text here"), (2, None)]
    elif kind == "families":
        rows = list(enumerate(chains(rng, 12, 9, 60) + chains(rng, 8, 6, 400, passage=[f"p{i}" for i in range(25)]) + chains(rng, 30, 3, 8)))
    elif kind == "empty":
        rows = []
    else:  # one template: many variants, most of them alike, some not, some only through others
        base = [f"w{i}" for i in range(90)]
        texts = []
        for _ in range(220):
            text = list(base)
            for _ in range(rng.choice([1, 1, 2, 4, 7])):
                text[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(text))
        rows = [(1000 - i, t) for i, t in enumerate(texts + texts[:40] + chains(rng, 3, 5, 90))]
        if kind == "parts":
            monkeypatch.setattr(jaccard, "PART", 700)  # some seven sets a part
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "size": F.lit("x"), "keys": F.lit(None)})
    got = jaccard.similar_documents(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("part, least, n", [(10**9, (9, 10), 3), (300, (4, 5), 5), (900, (1, 2), 2)])
def test_all_links_of_any_similarity(spark, monkeypatch, part, least, n):
    monkeypatch.setattr(jaccard, "PART", part)
    rows = list(enumerate(chains(random.Random(4), 10, 8, 90) + ["a b", "a b", "a", ""]))
    links, members = jaccard.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), n, least)
    of = {r["doc_id"]: r["node"] for r in members.collect()}
    sets = {i: shingles(t, n) for i, t in rows}
    want = {tuple(sorted((of[i], of[j]))) for i in sets for j in sets if i < j and of[i] != of[j] and linked(sets[i], sets[j], *least)}
    assert {tuple(r) for r in links.collect()} == want and len(want) > 30


def test_walks_are_exact_and_share_prefixes():
    """A probe finds what all pairs find, and reads far fewer branches than there are n-grams."""
    rng = np.random.default_rng(1)
    order = rng.permutation(100_000).astype(np.uint64)
    base = np.sort(rng.choice(100_000, 200, replace=False))
    sets = []
    for _ in range(150):
        keep = base[rng.random(200) > rng.choice([0.01, 0.03, 0.1])]
        sets.append(np.unique(np.concatenate([keep, rng.choice(100_000, rng.integers(0, 9))])))
    sets += [sets[0][:30], sets[0][:31], sets[1]]
    for least in ((9, 10), (2, 3)):
        trie = jaccard.Trie([order[s] for s in sets], [len(s) for s in sets], least)
        for i, x in enumerate(sets):
            want = [j for j, y in enumerate(sets) if j != i and linked(set(x.tolist()), set(y.tolist()), *least)]
            assert sorted(trie.like(i)) == want
        # the first n-grams alone never rule a similar set out
        heads = jaccard.Trie([order[s][: jaccard.key_count(len(s), least)] for s in sets], [len(s) for s in sets], least)
        heads.whole = False
        for i in range(len(sets)):
            assert set(trie.like(i)) <= set(heads.like(i))


def test_order_of_ngrams_changes_nothing(spark, monkeypatch):
    """The word counts decide the work alone."""
    rows = list(enumerate(chains(random.Random(9), 15, 5, 70)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard.word_weights(docs).max() > 0 == jaccard.word_weights(docs.where("false")).max()
    monkeypatch.setattr(jaccard, "word_weights", lambda _: np.zeros(jaccard.SLOTS, dtype=np.uint8))
    assert sorted(map(tuple, jaccard.similar_documents(docs).collect()), key=str) == plain(rows)


def test_hashes_of_words():
    """Equal for equal words wherever they stand, different for all others, as bytes in small letters split at white space."""
    rng, hashes = random.Random(7), jaccard.WordHashes()
    known = {}
    for text in ODD[1:] + ["".join(rng.choice("abAB é\t\x00\u2003\x1c\n") for _ in range(rng.randrange(60))) for _ in range(3000)]:
        words = text.encode().lower().split()
        got = hashes.of(text).tolist()
        assert len(got) == len(words)
        for w, h in zip(words, got):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 2000
    many = hashes.of(" ".join(f"w{i}" for i in range(200_000)))
    assert len(np.unique(many)) == 200_000


def test_whole_sets_move_as_texts(spark, monkeypatch):
    """What is dealt to the tasks that compare whole sets has the bytes of the texts, not eight for each n-gram."""
    moved, dealt = [], jaccard.sorted_by
    monkeypatch.setattr(jaccard, "sorted_by", lambda rows, *by: (moved.append(rows), dealt(rows, *by))[1])
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(400)) for _ in range(6)]
    table = spark.createDataFrame([(2 * i + k, t + " end" * k) for i, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    jaccard.similar_documents(table).collect()
    whole = next(rows for rows in moved if "part" in rows.columns)
    held = [c for c, of in whole.dtypes if of in ("string", "binary")]
    sizes = whole.agg(*[F.sum(F.octet_length(c)).alias(c) for c in held]).first()
    assert 0 < sum(sizes) <= sum(len(t) + 4 * k for t in texts for k in (0, 1))


def test_texts_reach_python_in_batches_of_bounded_size(spark, monkeypatch):
    """Long texts come by bytes, not 10,000 rows at a time, in op12 and in the pipeline's stage; the session's own setting is back afterwards."""
    import corpus_pipeline

    name, most, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], jaccard.set_links
    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": [b.nbytes]})

    def spied(*a, **k):
        most.append(texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0])
        return real(*a, **k)

    monkeypatch.setattr(jaccard, "set_links", spied)
    before = spark.conf.get(name)
    d = spark.createDataFrame([(k, f"some words of text number {k} and more") for k in range(4)], "doc_id long, text string")
    assert jaccard.similar_documents(d).count() == 4 and corpus_pipeline.drop_near_copies(spark, d, "").count() == 4
    assert len(most) == 2 and max(most) < 5 << 20 and spark.conf.get(name) == before


def test_a_trie_is_built_in_bounded_room():
    """Of a group of a million n-grams less than 32 bytes each beside its sequences, and ids by the order of hashes."""
    r = np.random.default_rng(5)
    sequences = [r.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(200)]
    tracemalloc.start()
    trie = jaccard.Trie(sequences, [5000] * 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    values = np.unique(np.concatenate(sequences))
    assert peak < 32_000_000 and all((values[t] == q[::-1]).all() for t, q in zip(trie.sets, sequences))


def test_sets_without_a_common_key_cost_a_probe_nothing():
    """Steps of a group of sets that are like none of the others grow with their number, not its square; what all have in common doesn't count."""
    r, steps = np.random.default_rng(7), {}
    for n in (150, 600):
        common = np.arange(10, dtype=np.uint64)
        sets = [np.concatenate([r.integers(1000, 1 << 60, 30, dtype=np.uint64), common]) for _ in range(n)]
        sets[-1] = np.concatenate([[np.uint64(7)], sets[0][1:]])  # one pair is alike
        trie, calls = jaccard.Trie(sets, [40] * n), [0]

        def count(frame, event, arg, calls=calls):
            calls[0] += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            links, _ = jaccard.forest(trie, 1)
        finally:
            sys.setprofile(None)
        assert links == [(0, n - 1)]
        steps[n] = calls[0]
    assert steps[600] < 6 * steps[150]


def test_sets_without_fingerprints_are_the_same_sets(spark, monkeypatch):
    """op12 reads no fingerprint, so none is made for it."""
    rows = list(enumerate(chains(random.Random(2), 3, 4, 60) + ODD))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = jaccard.word_weights(docs)
    plain_, marked = (jaccard.sets_of(docs, weights, prints=p).toPandas().sort_values("doc_id") for p in (False, True))
    assert (plain_["fp"] == 0).all() and (marked["fp"] != 0).any()
    assert plain_.drop(columns="fp").map(str).equals(marked.drop(columns="fp").map(str))
    asked, real = [], jaccard.sets_of
    monkeypatch.setattr(jaccard, "sets_of", lambda *a, **k: (asked.append(a), real(*a, **k))[1])
    assert jaccard.similar_documents(docs).count() == len(rows) and asked[0][-1] is False
