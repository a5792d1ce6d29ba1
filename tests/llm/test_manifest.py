"""The Merkle manifest against a plain version on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout):
    """Root, and of each digest the list of (left siblings, right siblings)."""
    paths = [[] for _ in digests]
    under = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = range(0, len(digests), fanout)
        for at in runs:
            for k in range(at, min(at + fanout, len(digests))):
                for i in under[k]:
                    paths[i].append(("".join(digests[at:k]), "".join(digests[k + 1 : at + fanout])))
        under = [sum(under[at : at + fanout], []) for at in runs]
        digests = [sha("".join(digests[at : at + fanout])) for at in runs]
    return digests[0], paths


def plain(rows, fanout=3):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = {}, []
    for s in order:
        members = sorted(groups[s], key=lambda r: (merkle.LEAST if r[0] is None else r[0], leaf(r)))
        root, paths = tree([leaf(r) for r in members], fanout)
        found[s] = members, paths
        subroots.append(root)
    top, above = tree(subroots, fanout)
    out = []
    for s, subroot, upper in zip(order, subroots, above):
        for r, path in zip(*found[s]):
            even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
            d = leaf((*r[:4], r[4].replace("\n", ""))) if even and r[4] is not None else leaf(r)
            for left, right in path + upper:
                d = sha(left + d + right)
            out.append((r[0], leaf(r), subroot, top, sha("".join(a + b for a, b in path + upper)), d, d == top))
    return out


def made(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"grp": F.lit(1), "rank": F.lit("x"), "id": F.lit(None)})
    monkeypatch.setattr(merkle, "read_table", lambda *_: df)
    return [tuple(r) for r in merkle.op11_merkle_manifest(spark, "").collect()]


ODD = [
    (None, None, None, None, None), (None, None, "en", 1, "a"), (3, None, "en", 2, "a\nb"), (-5, "", "en", 0, ""), (1, "é", "en", 5, "é\nü\n"), (2, "z", None, 1, "\n"), ((1 << 63) - 1, "z", "x", 1, "q"),
    (merkle.LEAST, "z", "x", 1, "q"), (-1, "z", "x", 1, "q"), (0, "z", "x", 1, "q"), (7, "z", "x", 1, "q"), (7, "z", "x", 1, "q"), (7, "z", "x", 1, "other"), (None, "z", "x", 1, "q"), (5, "Z", "x", 9, "long " * 40_000),
]


@pytest.mark.parametrize("kind", ["odd", "one", "empty", "wide", "copies", "many sources"])
def test_against_plain_trees(spark, monkeypatch, kind):
    rng = random.Random(3)
    rows = {
        "odd": ODD, "one": ODD[4:5], "empty": [],
        "wide": [(rng.randrange(-(1 << 62), 1 << 62) if i % 3 else i, rng.choice("aab"), "en", i, f"t{i}\n") for i in range(2300)],
        "copies": [(4, "a", "en", 1, "same\ntext")] * 700 + [(4, "a", "en", i, f"t{i}") for i in range(300)] + [(i, "a", "en", 1, "x") for i in range(60)],
        "many sources": [(i, f"s{i % 900}", "en", 1, "x") for i in range(1000)],
    }[kind]
    monkeypatch.setattr(merkle, "CHUNK", 64)
    assert Counter(made(spark, monkeypatch, rows)) == Counter(plain(rows) if rows else [])


@pytest.mark.parametrize("fanout", [2, 5])
def test_other_fanouts(spark, monkeypatch, fanout):
    """The general form: any fan-out; a proof gives the root from its leaf, and from no other."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = [(i, "ab"[i % 2], "en", i, f"t{i}") for i in range(333)]
    leaves = merkle.leaves_of(spark.createDataFrame(rows, SCHEMA), "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"])
    found = merkle.manifest(leaves, fanout).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("p"), merkle.fold(F.col("leaf")).alias("f"), merkle.fold(F.sha2("leaf", 256)).alias("g"))
    want = {r[0]: r[1:5] for r in plain(rows, fanout)}
    for r in found.collect():
        assert tuple(r)[1:5] == want.pop(r["doc_id"]) and r["f"] == r["root"] != r["g"]
    assert not want


def test_ranks_are_bounded_in_any_window(spark):
    """Digits alone decide the windows: no bucket of the last one holds more than 256 ids."""
    keys = spark.range(5000).selectExpr("'g' as grp", "id * 3 - 7000 as id", "1L as n")
    ranks = {r["id"]: (r["rank"], r["total"]) for r in merkle.ranked(keys, ["grp"], "id").collect()}
    assert ranks == {i * 3 - 7000: (i, 5000) for i in range(5000)} and merkle.shifts(keys, "id") == [64, 56, 48, 40, 32, 24, 16, 8]
    assert merkle.shifts(keys.where("id >= 0 and id < 250"), "id") == [8]
