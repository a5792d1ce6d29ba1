"""The pipeline's stages, one by one, against plain versions of what each must do."""

import os
import zlib

import pytest

import corpus_pipeline
from roadpulse.llm import queries, secrets

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        kept.append(docs)
    return kept


def test_columns_and_ids(stages):
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns and s.dtypes == stages[0].dtypes
        assert s.select("doc_id").distinct().count() == s.count()


def test_quality_keeps_good_documents(stages, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)


def test_lines_are_a_part_of_the_text(stages):
    before = {r["doc_id"]: (r["text"] or "").split("\n") for r in stages[1].collect()}
    seen = set()
    for r in sorted(stages[2].collect(), key=lambda r: r["doc_id"]):
        assert r["n_chars"] == len(r["text"])
        at = iter(before[r["doc_id"]])
        for line in r["text"].split("\n") if r["text"] else []:
            assert line in at
            form = " ".join(line.lower().split())
            if len(form) >= 20:
                assert form not in seen
                seen.add(form)


def test_near_copies_go_and_others_stay(stages):
    """Held against all pairs: what went is like something that stayed, and equal texts stand once."""
    from roadpulse.llm.simhash import jaccard

    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    kept = {r["doc_id"] for r in stages[3].select("doc_id").collect()}
    assert all(any(jaccard(before[i], before[j], 5) >= 0.8 for j in kept if j < i) for i in before.keys() - kept)
    texts = [before[i] for i in kept]
    assert len(texts) == len(set(texts)) == len(kept)


def test_no_secret_is_left(stages):
    scan = secrets.Scanner()
    assert stages[4].count() == stages[3].count()
    assert not [r["doc_id"] for r in stages[4].collect() if scan.base(r["text"])]


def test_pieces_cover_every_document(stages):
    packed = stages[5].groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in stages[4].collect()}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        assert compare(df, connect(SF), queries.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, and no rows at all."""
    from .test_operators import ODD, docs

    texts = [*ODD, ODD[6], "token = abcdefghijklmnop end"]
    odd = docs(spark, texts, [None, 1, 1, 2, 3, 4, 5, 5, 6, 5, 7])
    for d, n in ((odd, len(texts)), (odd.where("false"), 0)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            before, d = d, stage(spark, d, SF)
            assert d.columns == before.columns and d.dtypes == before.dtypes and d.count() <= before.count()
        kept = d.collect()
        assert len({r["text"] for r in kept}) == len(kept) and all(r["text"] is not None for r in kept)
        packed = corpus_pipeline.pack(spark, d, SF)
        assert packed.select("doc_id").distinct().count() == len({r["doc_id"] for r in kept})
        assert n == 0 or any("[secret]" in r["text"] for r in kept)
    assert corpus_pipeline.keep_good(spark, odd.where("false"), SF).count() == 0
    assert corpus_pipeline.keep_good(spark, odd, SF).columns == odd.columns
