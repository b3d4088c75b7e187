"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

A feature is the presence of a hashed character n-gram of the lower-cased text.
Document counts of a bounded sample of labelled texts outside the held-out fold
give each n-gram's log-count ratio; all n-grams whose log odds ratio stands out by so many
of its standard errors are kept, the errors being those at the classes' true sizes, whatever
the sample's.  A logistic model is fitted on presence times ratio.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import drop_scratch, fold, sampled, write_scratch

SIZES, BITS = (3, 4, 5, 6), 21
#: The fit's bounds: labelled toxic rows (and twice as many others) that n-grams are counted in, and those that weights are fitted on.
MAX_COUNTED, MAX_ROWS = 12_000, 2_000
#: Texts that an n-gram is seen in, at least; standard errors that a log odds ratio must have; the counts' smoothing.
MIN_DOCS, MIN_Z, ALPHA = 3, 4.0, 0.5
THRESHOLD = 0.7
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[list(b"\t\n\r\x0b\x0c")] = 32


def hashes(text: str | None) -> list[np.ndarray]:
    """Hashed n-grams of each size, repeats included, over the whole text between blanks."""
    data = _BLANK[np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    out, h = [], data * np.uint32(0x9E3779B1)
    for n in range(2, SIZES[-1] + 1):
        if len(data) < n:
            break
        h = (h[:-1] ^ (data[n - 1 :] + np.uint32(n))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        if n in SIZES:
            out.append(h >> np.uint32(32 - BITS))
    return out


@dataclass
class ToxicityModel:
    """weight by hashed n-gram: ratio times coefficient."""

    ids: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        table = slots(self.ids)

        def score(text: str | None) -> float:
            z = self.bias + (self.weight[p].sum() if len(p := present(text, table)) else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def slots(ids: np.ndarray) -> np.ndarray:
    """By hash: the place of a kept n-gram, or -1."""
    table = np.full(1 << BITS, -1, np.int32)
    table[ids] = np.arange(len(ids))
    return table


def present(text: str | None, table: np.ndarray) -> np.ndarray:
    found = [k[k >= 0] for h in hashes(text) for k in (table[h],)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """zeros and ones: texts of each class with n-gram g; all texts with g = -1."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    texts = np.zeros(2, np.int64)
    for f in frames:
        for y, t in zip(f["_y"], f["_t"], strict=True):
            texts[int(y == 1)] += 1
            found = hashes(t)
            if found:
                counts[int(y == 1), np.unique(np.concatenate(found))] += 1
    yield pd.DataFrame({"g": [-1], "zeros": texts[:1], "ones": texts[1:]})
    seen = np.flatnonzero(counts.any(0))
    for part in np.array_split(seen, len(seen) // 50_000 + 1):
        yield pd.DataFrame({"g": part, "zeros": counts[0, part], "ones": counts[1, part]})


def telling_ngrams(counted: DataFrame, zeros: int, ones: int, odds_of_others: float) -> DataFrame:
    """g and r, the log-count ratio, of the n-grams that tell the classes apart; zeros and ones: texts counted of each class."""
    p, q = (F.col("ones") + ALPHA) / (ones + 2 * ALPHA), (F.col("zeros") + ALPHA) / (zeros + 2 * ALPHA)
    odds = F.log(p / (1 - p)) - F.log(q / (1 - q))
    whole = odds_of_others * ones / zeros  # texts of the other class for one of the sample
    cells = (F.col("ones"), ones - F.col("ones"), whole * F.col("zeros"), whole * (zeros - F.col("zeros")))
    error = F.sqrt(sum((1 / (c + ALPHA) for c in cells[1:]), 1 / (cells[0] + ALPHA)))
    seen = F.col("zeros") + F.col("ones")
    return counted.filter("g >= 0").filter(seen >= MIN_DOCS).select("g", F.log(p / q).alias("r"), F.abs(odds / error).alias("z")).filter(F.col("z") >= MIN_Z)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, remainder: int = 1) -> ToxicityModel:
    """Labels of the held-out fold are never read; of several labels of an id the largest counts, null labels none.

    With one class only, or no text, the model is its bias.
    """
    known = labels.filter(~fold(id_col, modulus, remainder) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    n = {y: c for y, c in known.groupBy("_y").count().collect()}
    ones = n.get(1, 0)
    zeros = sum(n.values()) - ones
    prior = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 4.0 if ones else -4.0)
    if not ones or not zeros:
        return prior
    toxic, other = known.filter("_y = 1"), known.filter("_y <> 1")
    odds_of_others = zeros / ones

    def labelled(bound: int) -> DataFrame:
        # About three times `bound` ids at most, by the draw: a bound for the broadcast.
        return rows.join(F.broadcast(sampled(toxic, bound, "_id").unionByName(sampled(other, 2 * bound, "_id"))), "_id")

    # A task sends each n-gram once.
    counted = write_scratch(labelled(MAX_COUNTED).mapInPandas(_count, "g int, zeros long, ones long").groupBy("g").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")), "toxicity-counts")
    sums = counted.filter("g = -1").first()
    if sums is None or not sums["ones"] or not sums["zeros"]:
        return prior
    zeros, ones = sums["zeros"], sums["ones"]
    grams = telling_ngrams(counted, zeros, ones, odds_of_others)
    # At most 2 ** BITS rows, the hashes there are; in practice those of a few thousand n-grams.
    model = grams.select("g", "r").orderBy("g").toPandas()
    drop_scratch(counted)
    ids, ratio = model["g"].to_numpy(np.int64), model["r"].to_numpy()

    def vector(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots(ids)
        for f in frames:
            yield pd.DataFrame({"y": (f["_y"] == 1).astype("int32"), "x": [present(t, table).astype("<i4").tobytes() for t in f["_t"]]})

    fit = write_scratch(labelled(MAX_ROWS).mapInPandas(vector, "y int, x binary"), "toxicity-fit")
    # A partition at a time to the driver; in order, so that sums do not depend on the order of arrival.
    found = sorted((r["y"], bytes(r["x"])) for r in fit.coalesce(8).toLocalIterator())
    drop_scratch(fit)
    y, columns = np.array([y for y, _ in found], np.float64), [np.frombuffer(x, "<i4") for _, x in found]
    del found
    weight, bias = _logistic(columns, y, ratio, odds_of_others)
    return ToxicityModel(ids, weight * ratio, bias)


def _logistic(columns: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, odds: float, steps: int = 120, rate: float = 0.05, l2: float = 2e-5, together: int = 1000) -> tuple[np.ndarray, float]:
    """Adam on the whole sample, so many rows at a time (columns is emptied); the classes weigh as often as they occur among all labels."""
    parts = []
    for a in range(0, len(columns), together):
        size = np.array([len(c) for c in columns[a : a + together]])
        parts.append((np.concatenate(columns[a : a + together]), size))
        columns[a : a + together] = [None] * len(size)  # held once
    weigh = np.where(y == 1, 1 / max(1, (y == 1).sum()), odds / max(1, (y == 0).sum()))
    weigh /= weigh.sum()
    w = np.zeros(len(ratio) + 1)
    w[-1] = -np.log(odds)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        scaled, g, at = ratio * w[:-1], np.zeros(len(ratio) + 1), 0
        for col, size in parts:
            rows = slice(at, at + len(size))
            sums = np.append(0, np.cumsum(scaled[col]))
            z = np.diff(sums[np.append(0, np.cumsum(size))]) + w[-1]
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * weigh[rows]
            g[:-1] += np.bincount(col, weights=np.repeat(e, size), minlength=len(ratio))
            g[-1] += e.sum()
            at += len(size)
        g[:-1] = ratio * g[:-1] + l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def toxicity_of(model: ToxicityModel) -> Callable[[Column], Column]:
    """A function from a text column to a score in 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, score, predicted.  A null text is an empty one; repeated rows score the same."""
    return docs.select(F.col(id_col), toxicity_of(model)(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
