"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents outside the held-out third;
the unlabelled set is web text of the corpus itself, whose labels are never read.
The share of positives in it is estimated from the best ratio of upper tails of
a first classifier's scores; a small network then minimises the non-negative
unbiased risk. Both samples are bounded (`MOST_TRAINING` rows each).

Defined cases: null text is empty, and an empty text has a score like any other;
repeated rows score alike; texts are read whole; without positives or documents
every score is 0.5, and so every document is kept.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, long_ids, read_table, whole_texts
from .training import labelled, sampled

MOST_TRAINING = 10_000
THRESHOLD = 0.5
NAMES = ("words", "word_length", "signs", "bars", "exclamation", "capitals", "repeats", "variety", "same_lines", "line_length", "digits", "stops", "short_words", "letters")


def features(text: str) -> list[float]:
    words = text.split()
    count = len(words)
    n, chars = max(count, 1), max(len(text), 1)
    lines = text.split("\n")
    length = sum(map(len, words))
    signs = sum(map(text.count, "$%&#*@^~<>{}\\"))
    return [
        np.log1p(count),
        min(length / n, 30),
        min(signs / n, 4),
        min(text.count("|") / n, 1),
        min(text.count("!") / n, 4),
        sum(map(str.isupper, words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(words)) / n ** 0.85,
        1 - len(set(lines)) / len(lines),
        np.log1p(chars / len(lines)),
        min(sum(map(text.count, "0123456789")) / chars, 1),
        min((text.count(".") + text.count(",")) / n, 2),
        sum(len(w) <= 2 for w in words) / n,
        length / chars,
    ]


def logistic(p: np.ndarray, u: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights that tell positives from the unlabelled, last one the constant."""
    x = np.concatenate([p, u])
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    y = np.repeat([1.0, 0.0], [len(p), len(u)])
    c = np.where(y == 1, 0.5 / len(p), 0.5 / len(u))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 2.0 * (x.T @ (c * (y - z)) - 1e-4 * w)
    return w


def class_prior(p_scores: np.ndarray, u_scores: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails, with an allowance for chance, and its standard error above, as too small a share rejects good documents."""
    cuts = np.quantile(p_scores, np.linspace(0.02, 0.8, 40))
    above_p = np.array([(p_scores >= c).mean() for c in cuts])
    above_u = np.array([(u_scores >= c).mean() for c in cuts])
    allowance = np.sqrt(np.log(40) / (2 * len(p_scores))) + np.sqrt(np.log(40) / (2 * len(u_scores)))
    at = np.argmin((above_u + allowance) / above_p)
    ratio = above_u[at] / above_p[at]
    error = np.sqrt(above_u[at] * (1 - above_u[at]) / len(u_scores)) + ratio * np.sqrt(above_p[at] * (1 - above_p[at]) / len(p_scores))
    error *= 1 + 20 / len(p_scores)  # of few positives the error is itself uncertain
    return float(np.clip(ratio + error / above_p[at], 0.05, 0.98))


class Network:
    """One hidden layer, fitted by the non-negative unbiased risk with the sigmoid loss."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        self.hidden, self.seed = hidden, seed

    @staticmethod
    def gradient(w: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float, decay: float, beta: float = 0.0) -> list[np.ndarray]:
        """Of the risk over a batch of positives and one of unlabelled rows, of one size; where its negative part is below -beta, of minus that part alone."""
        batch = len(xp)
        x = np.concatenate([xp, xu])
        a = np.tanh(x @ w[0] + w[1])
        s = 1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30)))
        slope = s * (1 - s) / batch
        negative = s[batch:].mean() - prior * s[:batch].mean()
        if negative >= -beta:  # d/dz of prior * E_p[1 - s] + E_u[s] - prior * E_p[s]
            dz = np.concatenate([-2 * prior * slope[:batch], slope[batch:]])
        else:  # the negative part of the risk has gone below zero: step back on it alone
            dz = np.concatenate([prior * slope[:batch], -slope[batch:]])
        da = dz[:, None] * w[2] * (1 - a**2)
        return [x.T @ da + decay * w[0], da.sum(0), a.T @ dz + decay * w[2], dz.sum()]

    def fit(self, p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1500, batch: int = 512, rate: float = 0.01, beta: float = 0.0) -> Network:
        decay = max(1e-4, 1 / (len(p) + 20))  # few positives would be learned by heart
        r = np.random.default_rng(self.seed)
        d = p.shape[1]
        w = [r.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), r.normal(0, self.hidden**-0.5, self.hidden), np.zeros(())]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for t in range(1, steps + 1):
            xp, xu = p[r.integers(len(p), size=batch)], u[r.integers(len(u), size=batch)]
            grads = self.gradient(w, xp, xu, prior, decay, beta)
            step = rate * min(1, 2 * (1 - t / (steps + 1)))
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3], -30, 30)))


#: Rows that the class prior's first guess, a half, counts as: one of either class.
SHRINK = 2


class Model:
    def __init__(self, network: Network | None, mean: np.ndarray | None, spread: np.ndarray | None, prior: float):
        self.network, self.mean, self.spread, self.prior = network, mean, spread, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.network is None else self.network.score(np.clip((x - self.mean) / self.spread, -8, 8))


def fit_matrices(p: np.ndarray, u: np.ndarray) -> Model:
    if not len(p) or not len(u):
        return Model(None, None, None, 0.5)
    p, u = (x[np.lexsort(x.T)] for x in (p, u))  # the arrival order of rows must not matter
    both = np.concatenate([p, u])
    mean, spread = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / spread, -8, 8) for x in (p, u))
    r = np.random.default_rng(11)
    p, u = p[r.permutation(len(p))], u[r.permutation(len(u))]
    half_p, half_u = len(p) // 2, len(u) // 2
    known = min(len(p) - half_p, len(u) - half_u) if half_p and half_u else 0
    w = logistic(p[:half_p], u[:half_u]) if known else None
    estimate = class_prior(p[half_p:] @ w[:-1], u[half_u:] @ w[:-1]) if known else 0.5
    prior = (known * estimate + SHRINK * 0.5) / (known + SHRINK)  # of few rows little can be told
    return Model(Network().fit(p, u, prior), mean, spread, prior)


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Model:
    """Reads labels of documents outside the held-out third, and of these only which are good."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [features(t or "") for t in b["text"]]})

    def matrix(rows: DataFrame) -> np.ndarray:
        got = rows.select("text").mapInPandas(make, "x array<double>").toPandas()  # `most` rows at the most
        return np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(NAMES)))

    return fit_matrices(matrix(labelled(documents, labels, "quality", most, wanted=1)), matrix(sampled(documents.select("doc_id", "text"), most)))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted. Nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([features(t) for t in b["text"]]).reshape(-1, len(NAMES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(x)})

    scored = long_ids(whole_texts(documents).mapInPandas(run, "doc_id string, score double"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least the threshold, all columns as they were."""

    @F.pandas_udf("double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(np.array([features(x) for x in t]).reshape(-1, len(NAMES))))

    return documents.where(rate(F.coalesce(F.col("text"), F.lit(""))) >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return score(documents, fit(documents, read_table(spark, sf_dir, "labels")))
