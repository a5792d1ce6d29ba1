"""The registered queries over a whole table against plain versions of their contracts."""

import hashlib
import os
import re
import zlib
from array import array
from collections import defaultdict

import pytest

from roadpulse.llm import pieces, queries
from roadpulse.llm.common import tokenizer_file

from .test_operators import naive, plain_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
KINDS = ("assign", "access", "hex")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark):
    of = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        of[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    of[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    got = {r["conv_id"]: r for r in rows(spark, "op1_chat_format")}
    assert got.keys() == of.keys()
    for conv, turns in of.items():
        turns.sort(key=lambda t: t[0])
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= len(loss)


def n_best(table, marked, n, unknown):
    """(score, pieces) of the n best ways, by a list of n at each position. A character without a piece costs `unknown` and counts its bytes."""
    best = [[(0.0, 0)]] + [[] for _ in marked]
    for end in range(1, len(marked) + 1):
        found = []
        for start in range(max(0, end - 16), end):
            p = table.get(marked[start:end])
            if p is not None:
                found += [(s - p, c + 1) for s, c in best[start]]
            elif end == start + 1:
                found += [(s - unknown, c + len(marked[start].encode())) for s, c in best[start]]
        best[end] = sorted(found)[:n]
    return [(-s, c) for s, c in best[-1]]


def test_op2(spark, texts):
    model = pieces.Pieces.load(tokenizer_file("piece_bpe_32k.model"))
    table = {p: score for p, (_, score) in model.pieces.items()}
    assert max(map(len, table)) <= 16
    got = defaultdict(list)
    for r in rows(spark, "op2_sentencepiece"):
        got[r["doc_id"]].append(r)
        assert r["round_trip"]
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        if len(text) > 4000 or "▁" in text:
            continue
        want = n_best(table, (" " + text).replace(" ", "▁") if text else "", 3, pieces.UNKNOWN)
        have = [(r["score"], r["n_pieces"]) for r in sorted(got[doc], key=lambda r: r["rank"])]
        assert [c for _, c in have] == [c for _, c in want]
        assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for (a, _), (b, _) in zip(have, want))


def test_op4(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op4_secret_scan")}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        spans = plain_spans(text)
        base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        r = got[doc]
        assert [r[f"n_{n}"] for n in KINDS] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= {*r["spans"].split(","), ""}


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op5_best_fit_packing"):
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert of.keys() == texts.keys()
    total = 0
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(of[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(array("I", ids[at : at + r["length"]]).tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids) and len(of[doc]) == -(-len(ids) // 1024)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.05 * -(-total // 1024) + 1


def test_op6(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op6_fingerprints")}
    order = sorted(texts, reverse=True)
    by_text = defaultdict(set)
    for doc, following in zip(order, order[1:] + order[:1]):
        text, other = texts[doc], texts[following]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and r["near_next"] == float(r["fingerprint"] == got[following]["fingerprint"])
        if text == other:
            assert r["near_next"] == 1.0
        by_text[text].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_op9(spark, texts):
    prints = {doc: naive(text) for doc, text in texts.items()}
    group = {doc: doc for doc in texts}
    for a in sorted(texts):  # components by repeated merging; a few hundred rows
        for b in sorted(texts):
            if a < b and group[a] != group[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op9_simhash")}
    assert got == {d: (f"{prints[d]:016x}", group[d]) for d in texts}


@pytest.mark.parametrize("name, threshold", [("op7_toxicity", 0.7), ("op10_quality", 0.5)])
def test_classifier_queries(spark, texts, name, threshold):
    got = rows(spark, name)
    assert {r["doc_id"] for r in got} == texts.keys() and len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)


def test_op8(spark, texts):
    """Exact copies by brute force; fuzzy ones are held against all pairs in test_operators."""
    got = {r["doc_id"]: r for r in rows(spark, "op8_line_dedup")}
    seen, copies = set(), defaultdict(set)
    for doc in sorted(texts):
        for k, line in enumerate(texts[doc].split("\n")):
            form = re.sub(r"[ \t\f\r\x0b]+", " ", line).strip(" ").lower()
            if form and form in seen:
                copies[doc].add(k)
            seen.add(form)
    for doc, text in texts.items():
        r = got[doc]
        removed = {int(x) for x in r["removed"].split(",") if x}
        assert (r["n_lines"], r["n_removed"]) == (text.count("\n") + 1, len(removed)) and copies[doc] <= removed
