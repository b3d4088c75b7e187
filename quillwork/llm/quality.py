"""Document quality by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a logistic model that
minimises the non-negative unbiased risk of Kiryo et al. (2017),
    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1)).
The class prior pi is estimated from the two samples alone, negative labels are never
read: a model of which sample a text is from scores texts that it was not fitted on, and
above any score the share of unlabelled texts is at least pi times that of positives, so
the least ratio of the two, with its error, bounds pi (Garg et al. 2021).  Features are
standardised by their means and deviations over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.llm._common import fold, sampled

#: The fit's bounds: positives and unlabelled texts that reach the driver as feature rows.
MAX_POSITIVES, MAX_UNLABELLED = 12_000, 16_000
THRESHOLD = 0.3

# Classes of bytes: lower, upper, digit, blank, line end, sentence punctuation, symbol, beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
for _i, _c in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:'\"?()-")):
    _CLASS[list(_c)] = _i
_CLASS[128:] = 7
WIDTH = 8 + 64 + 10


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes and of pairs of them, and how often words and lines repeat, over the whole text."""
    out = np.zeros(WIDTH, np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return out
    c = _CLASS[data]
    out[:8] = np.bincount(c, minlength=8) / len(c)
    if len(c) > 1:
        out[8:72] = np.bincount(c[:-1] * np.uint8(8) + c[1:], minlength=64) / (len(c) - 1)
    words = text.split()
    lines = text.split("\n")
    n = len(words)
    if n:
        counts = Counter(words)
        out[72:80] = (
            np.log1p(n) / 8,
            len(counts) / n,
            max(counts.values()) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            len(data) / n / 16,
            sum(v for v in counts.values() if v > 3) / n,
            sum(map(str.isupper, words)) / n,
            len(counts) / n ** 0.8 / 4,
        )
    out[80:] = len(set(lines)) / len(lines), np.log1p(len(lines)) / 8
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_expand((x - self.mean) / self.scale) @ self.weight + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _expand(x: np.ndarray) -> np.ndarray:
    """Standardised features, bounded, with how far each lies to either side."""
    x = np.clip(x, -6, 6)
    return np.concatenate([x, np.abs(x)], axis=1)


def nnpu_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk by w, the bias last; where the estimated risk of negatives is below zero, of that part undone instead."""
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    sp, su = _sigmoid(zp), _sigmoid(zu)
    as_negative = np.append(su @ u / len(u) - prior * (sp @ p) / len(p), su.mean() - prior * sp.mean())
    as_positive = prior * np.append((sp - 1) @ p / len(p), (sp - 1).mean())
    part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return as_positive + as_negative if part >= 0 else -as_negative


def _adam(gradient: Callable[[np.ndarray], np.ndarray], w: np.ndarray, steps: int, rate: float, l2: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray, steps: int = 500, rate: float = 0.03, l2: float = 1e-4) -> QualityModel:
    """Adam on the whole sample."""
    p, u = (_expand((x - mean) / scale).astype(np.float64) for x in (positive, unlabelled))
    start = np.append(np.zeros(p.shape[1]), np.log(prior / (1 - prior)))
    w = _adam(lambda w: nnpu_gradient(w, p, u, prior), start, steps, rate, l2)
    return QualityModel(mean, scale, w[:-1].copy(), float(w[-1]), prior)


def mixture_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.05) -> float:
    """Share of positives in unlabelled scores: least ratio, over thresholds, of the tails, with the tails' errors at that confidence."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.unique(np.quantile(positive, np.linspace(0, 0.99, 200)))
    tail = lambda x: 1 - np.searchsorted(np.sort(x), at, "left") / len(x)
    slack = lambda n: np.sqrt(np.log(4 / sure) / (2 * n))
    p, u = tail(positive), tail(unlabelled)
    worst = (u + (slack(len(unlabelled)) + slack(len(positive)))) / np.maximum(p, 1e-9)
    best = int(worst.argmin())
    return float(u[best] / p[best])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, steps: int = 200) -> float:
    """Each half of the rows is scored by a model of the other half that tells the samples apart."""
    p, u = (_expand((x - mean) / scale).astype(np.float64) for x in (positive, unlabelled))
    found = []
    for k in (0, 1):
        a, b = p[k::2], u[k::2]
        if not len(a) or not len(b) or not len(p[1 - k :: 2]) or not len(u[1 - k :: 2]):
            continue
        # Both samples weigh the same.
        gradient = lambda w, a=a, b=b: np.append((_sigmoid(a @ w[:-1] + w[-1]) - 1) @ a / len(a) + _sigmoid(b @ w[:-1] + w[-1]) @ b / len(b), (_sigmoid(a @ w[:-1] + w[-1]) - 1).mean() + _sigmoid(b @ w[:-1] + w[-1]).mean())
        w = _adam(gradient, np.zeros(p.shape[1] + 1), steps, 0.03, 1e-3)
        found.append(mixture_prior(p[1 - k :: 2] @ w[:-1], u[1 - k :: 2] @ w[:-1]))
    return min(0.98, max(0.02, float(np.mean(found)) if found else 0.5))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _features_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def feature_moments(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all rows (column _t): a task sends its sums alone."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, squares = 0, np.zeros(WIDTH), np.zeros(WIDTH)
        for f in frames:
            for t in f["_t"]:
                x = features(t).astype(np.float64)
                n, sums, squares = n + 1, sums + x, squares + x * x
        yield pd.DataFrame({"i": np.arange(WIDTH), "n": n, "s": sums, "q": squares})

    found = texts.mapInPandas(add, "i int, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").toPandas()
    if not len(found) or not found["n"].iloc[0]:
        return np.zeros(WIDTH), np.ones(WIDTH)
    mean = (found["s"] / found["n"]).to_numpy()
    return mean, np.sqrt(np.maximum((found["q"] / found["n"]).to_numpy() - mean**2, 0)) + 1e-3


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, remainder: int = 0) -> QualityModel:
    """Labels of the held-out fold are never read; of several labels of an id the smallest counts, null labels none.

    With no positive label or no text the model scores everything alike, by a prior of a half.
    """
    known = labels.filter(~fold(id_col, modulus, remainder) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"))
    trusted = sampled(known.filter("_y = 1").select("_id"), MAX_POSITIVES, "_id")
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    # About MAX_POSITIVES ids at most, by the draw: a bound for the broadcast.
    rows = text.join(F.broadcast(trusted), "_id").dropDuplicates(["_id"]).select(F.lit(True).alias("p"), _features_udf("_t").alias("x"))
    # Drawn by id and text, so that rows without an id do not come all at once; equal rows count once.
    free = sampled(text, MAX_UNLABELLED, "_id", "_t").dropDuplicates(["_id", "_t"]).select(F.lit(False).alias("p"), _features_udf("_t").alias("x"))
    found = rows.unionByName(free).toPandas()
    if found["p"].sum() == 0 or (~found["p"].astype(bool)).sum() == 0:
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH), 0.0, 0.5)
    x, p = np.stack(found["x"].to_numpy()).astype(np.float32), found["p"].to_numpy(bool)
    order = np.lexsort(x.T[::-1])  # sums do not depend on the order of arrival
    x, p = x[order], p[order]
    mean, scale = feature_moments(text.select("_t"))
    return fit_nnpu(x[p], x[~p], estimate_prior(x[p], x[~p], mean, scale), mean, scale)


def quality_of(model: QualityModel) -> Callable[[Column], Column]:
    """A function from a text column to a score in 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.stack([features(t) for t in texts])) if len(texts) else [], dtype="float64")

    return run


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, score, predicted.  Null and empty texts are scored alike, as texts without a word; repeated rows score the same."""
    return docs.select(F.col(id_col), quality_of(model)(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score under the threshold, all columns as they were.  Null and empty texts score as texts without a word; repeated rows go or stay together; an empty table stays empty."""
    return docs.filter(quality_of(model)(F.col(text_col)) >= threshold)
