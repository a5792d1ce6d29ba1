"""Near copies as the pipeline's third stage decides them, keys of any length and alphabet, and classifiers that learn from few rows."""

import random

import numpy as np
import pytest

import corpus_pipeline
from roadpulse.llm import quality, secrets
from roadpulse.llm.simhash import jaccard

from .test_operators import AROUND, docs

WORDS = ["".join(random.Random(i).choice("aeiounrst") for _ in range(3 + i % 6)) + str(i) for i in range(5000)]


def edited(r, text, edits):
    """Words replaced, left out, put in."""
    words = text.split()
    for _ in range(edits):
        at = r.randrange(len(words))
        words[at : at + 1] = r.choice([[r.choice(WORDS)], [], [words[at], r.choice(WORDS)]])
    return " ".join(words)


@pytest.mark.parametrize("size", [60, 200, 800])
def test_every_pair_at_0_8_and_above_is_found(spark, size):
    """Planted pairs of all similarities: of those from 0.8 on one text stays, of those below both do."""
    r = random.Random(size)
    texts, pairs = [], []
    for k in range(160):
        one = " ".join(r.choice(WORDS) for _ in range(size))
        other = edited(r, one, 1 + k % max(3, size // 35))
        pairs.append((len(texts), len(texts) + 1, jaccard(one, other, 5)))
        texts += [one, other]
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()}
    assert all(i in kept and (j in kept) == (s < 0.8) for i, j, s in pairs)
    assert sum(s >= 0.8 for _, _, s in pairs) >= 40 and sum(0.8 <= s < 0.85 for _, _, s in pairs) >= 10 and any(s < 0.8 for _, _, s in pairs)


def test_a_chain_is_one_group(spark):
    """400 texts, each at least 0.87 like the next and the ends unlike: one stays."""
    r = random.Random(5)
    texts = [" ".join(r.choice(WORDS) for _ in range(240))]
    while len(texts) < 400:
        texts.append(edited(r, texts[-1], 3))
    texts += [" ".join(r.choice(WORDS) for _ in range(240)) for _ in range(3)]
    assert min(jaccard(a, b, 5) for a, b in zip(texts[:399], texts[1:400])) >= 0.85 and jaccard(texts[0], texts[399], 5) < 0.2
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()}
    assert kept == {0, 400, 401, 402}


def test_repeated_rows_and_other_columns(spark):
    """Of equal rows one stays, and equal texts without words are one group; a smaller id stays whatever its place."""
    text = " ".join(WORDS[:40])
    rows = docs(spark, [text, text, text, text + " x", "", " \n", None, "solo", "solo"], [None, 7, 7, 9, 3, 2, None, 1, 1])
    kept = corpus_pipeline.drop_near_copies(spark, rows, "")
    assert kept.columns == rows.columns and kept.dtypes == rows.dtypes
    assert sorted((x["doc_id"], x["text"]) for x in kept.collect()) == [(1, "solo"), (2, " \n"), (7, text)]


def test_keys_of_any_length_and_alphabet():
    r, scan = random.Random(3), secrets.Scanner()
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [small + small.upper() + digits + "+/", small + small.upper() + digits, small + digits, small, small.upper(), small.upper() + "234567", digits + "ABCDEF"]  # digits and small hex are base spans
    for alphabet in alphabets:
        for n in (20, 32, 40, 64, 65, 100, 200, 400):
            keys = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(60)]
            found = 0
            for key in keys:
                text = r.choice(AROUND).format(key)
                found += any(k == 3 and text[s:e] == key for s, k, e in scan(text)[1])
            assert found >= 48, (alphabet, n, found)


def test_long_names_are_no_keys():
    r, scan = random.Random(4), secrets.Scanner()
    words = [w for w in secrets.vocabulary().split() if len(w) > 3]
    for join in ("_".join, "-".join, "/".join, ".".join, lambda w: "".join(x.title() for x in w)):
        names = [join([r.choice(words) for _ in range(r.choice([4, 8, 16]))]) for _ in range(200)]
        assert sum(any(k == 3 for _, k, _ in scan(r.choice(AROUND).format(x))[1]) for x in names if len(x) >= secrets.NOVEL_LEAST) <= 10


@pytest.mark.parametrize("known", [1, 2, 5, 9, 10, 40])
def test_few_positives_are_learned_from(known):
    """No number of rows turns the classifier off: good rows score above others on average, from the first one on."""
    r = np.random.default_rng(known)
    good = lambda n: r.normal(1.0, 0.4, (n, len(quality.NAMES)))
    bad = lambda n: r.normal(-1.0, 0.4, (n, len(quality.NAMES)))
    model = quality.fit_matrices(good(known), np.concatenate([good(60), bad(60)]))
    a, b = model.score(good(50)), model.score(bad(50))
    assert a.mean() > b.mean() + 0.1 and np.ptp(np.concatenate([a, b])) > 0.1
    assert quality.fit_matrices(good(0), bad(5)).score(bad(3)).tolist() == [0.5] * 3 == quality.fit_matrices(good(5), bad(0)).score(bad(3)).tolist()
