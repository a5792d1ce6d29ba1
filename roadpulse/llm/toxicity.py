"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (whole words and word beginnings that are far
more common in toxic training texts), their closeness to second-person words,
capitals, punctuation, and letters replaced by digits or signs. The lexicon is
counted on the executors; the trees are grown on the driver from a bounded
sample (`MOST_TRAINING` rows), and the calibration from out-of-fold margins.

Defined cases: null text is empty, and an empty text has a score like any other;
repeated rows score alike; texts are read whole; with labels of one kind or none
the score is their share, or 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, long_ids, read_table, whole_texts
from .training import labelled

MOST_TRAINING = 12_000
LEXICON_SIZE = 400
THRESHOLD = 0.7
STEM = 4
#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus vuestro".split())
NEAR = 5
PER_TEXT = 5


class Features:
    """Dense features of a text; `lexicon` maps words, and "^" + word beginnings, to the log of their ratio of frequencies."""

    names = ("words", "hits", "density", "stem_hits", "stem_density", "weight_density", "weight", "strong", "near_you", "you", "capitals", "exclamation", "punctuation", "obfuscation", "mean_length")

    def __init__(self, lexicon: dict[str, float]):
        self.words = {k: v for k, v in lexicon.items() if k[0] != "^"}
        self.stems = {k[1:]: v for k, v in lexicon.items() if k[0] == "^"}
        self.word = re.compile(r"\w+")
        self.obfuscated = re.compile(r"[A-Za-z][0-9@$*]+[A-Za-z]")

    def __call__(self, text: str) -> list[float]:
        cased = self.word.findall(text)
        words = "\n".join(cased).lower().split("\n") if cased else []
        n, chars = max(len(words), 1), max(len(text), 1)
        whole, stems = self.words, self.stems
        hits = [i for i, w in enumerate(words) if w in whole]
        begun = [i for i, w in enumerate(words) if w[:STEM] in stems]
        weights = [whole[words[i]] for i in hits] + [stems[words[i][:STEM]] for i in begun]
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if you and (hits or begun):
            at = np.asarray(sorted({*hits, *begun}))
            you_at = np.asarray(you)
            after = np.searchsorted(you_at, at)
            gap = np.minimum(np.abs(at - you_at[np.minimum(after, len(you) - 1)]), np.abs(at - you_at[np.maximum(after - 1, 0)]))
            near = int((gap <= NEAR).sum())
        strong = sum(w >= 2.5 for w in weights)
        length = sum(map(len, words))
        return [
            np.log1p(len(words)), min(len(hits), 50), len(hits) / n, min(len(begun), 50), len(begun) / n, sum(weights) / n, np.log1p(sum(weights)), strong / n, near / n, len(you) / n,
            sum(map(str.isupper, cased)) / n, text.count("!") / chars, max(0, chars - length - text.count(" ")) / chars, len(self.obfuscated.findall(text)) / n, length / n,
        ]


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Words and beginnings with at least four times the frequency in toxic texts. A text counts a word five times at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(r"\w+")
        docs, uses = (Counter(), Counter()), (Counter(), Counter())
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                c = Counter(word.findall((text or "").lower()))
                for w, k in list(c.items()):
                    if len(w) > STEM:
                        c["^" + w[:STEM]] += k
                docs[label].update(c.keys())
                uses[label].update({w: min(k, PER_TEXT) for w, k in c.items()})
                uses[label][""] += min(sum(c.values()), 1_000_000)
                docs[label][""] += 1
        keys = list(uses[0].keys() | uses[1].keys())
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            yield pd.DataFrame({"key": some, "d1": [docs[1][k] for k in some], "d0": [docs[0][k] for k in some], "t1": [uses[1][k] for k in some], "t0": [uses[0][k] for k in some]})

    counts = cut(sample.mapInPandas(count, "key string, d1 long, d0 long, t1 long, t0 long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("d1", "d0", "t1", "t0")]))
    all_ = counts.where("key = ''").first()
    if all_ is None or not all_["d1"] or not all_["d0"]:
        return {}
    ratio = ((F.col("t1") + 0.5) / all_["t1"]) / ((F.col("t0") + 0.5) / all_["t0"])
    found = counts.where((F.col("key") != "") & (F.col("d1") >= max(3, all_["d1"] // 100))).withColumn("ratio", ratio).where("ratio >= 4")
    best = found.orderBy(F.desc(F.col("d1") * F.log("ratio")), "key").limit(size).collect()
    return {r["key"]: float(np.log(r["ratio"])) for r in best}


class Trees:
    """Gradient boosting on binned features for log loss; each tree of fixed depth is an array of splits."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin, self.trees = np.full(len(y), self.start), []
        width, features = self.bins, x.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            splits = []
            for level in range(self.depth):
                count = 1 << level
                best_gain, best_f, best_b = np.zeros(count), np.zeros(count, dtype=int), np.full(count, width)
                total_g, total_h = np.bincount(node, g, count), np.bincount(node, h, count)
                for f in range(features):
                    key = node * width + codes[:, f]
                    gl = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                    hl = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                    gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                    gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (total_g**2 / (total_h + self.l2))[:, None]
                    gain[(hl < 1) | (hr < 1)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    better = top > best_gain + 1e-9
                    best_gain[better], best_f[better], best_b[better] = top[better], f, at[better]
                splits.append((best_f, best_b))
                node = node * 2 + (codes[np.arange(len(y)), best_f[node]] > best_b[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            margin += value[node]
            self.trees.append((splits, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for f, b in splits:
                node = node * 2 + (codes[rows, f[node]] > b[node])
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (margins, shares), both ascending, to interpolate between."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order].astype(float)):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    points = [(m, (s + 0.5 * 0.1) / (n + 0.1)) for s, n, lo, hi in blocks for m in ((lo, hi) if hi > lo else (lo,))]
    shares = np.maximum.accumulate([p for _, p in points])
    return np.array([m for m, _ in points]), shares


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, curve: tuple[np.ndarray, np.ndarray] | None, constant: float):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.trees.margin(x), *self.curve), 0, 1)


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Model:
    """Labels come only from ids outside the held-out third; `most` bounds the rows that are learned from."""
    sample = cut(labelled(documents, labels, "toxic", most))
    lexicon = learn_lexicon(sample)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features(lexicon)
        for b in batches:
            yield pd.DataFrame({"fold": b["fold"], "label": b["label"], "x": [make(t or "") for t in b["text"]]})

    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(3)).cast("int").alias("fold")
    rows = sample.select(fold, "label", "text").mapInPandas(features, "fold int, label int, x array<double>").toPandas()  # `most` rows at the most
    y = rows["label"].to_numpy(float) if len(rows) else np.zeros(0)
    if len(set(y)) < 2:
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x, folds = np.stack(rows["x"].to_list()), rows["fold"].to_numpy()
    order = np.lexsort((*x.T, y))  # the arrival order of rows must not matter
    x, y, folds = x[order], y[order], folds[order]
    outside = np.full(len(y), np.nan)
    for k in range(3):
        if len(set(y[folds != k])) == 2 and (folds == k).any():
            outside[folds == k] = Trees().fit(x[folds != k], y[folds != k]).margin(x[folds == k])
    trees = Trees().fit(x, y)
    known = ~np.isnan(outside)
    return Model(lexicon, trees, isotonic(outside[known], y[known]) if known.any() else isotonic(trees.margin(x), y), 0.0)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted. Nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features(model.lexicon)
        for b in batches:
            x = np.array([make(t) for t in b["text"]]).reshape(-1, len(Features.names))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(x)})

    scored = long_ids(whole_texts(documents).mapInPandas(run, "doc_id string, score double"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return score(documents, fit(documents, read_table(spark, sf_dir, "labels")))
