"""The two classifiers as a whole against plain versions: every feature by its definition, every step by loops over rows."""

import math
import zlib

import numpy as np
import pytest

from quillwork.llm import quality, queries, toxicity

CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:'\"?()-"]
GOOD = ["The river runs by the old mill, and the miller's dog sleeps.", "We walked home in the evening; it was warm.", "A short note on bread: flour, water, salt.", "Nobody knew why the lamp was lit."]
BAD = ["BUY NOW BUY NOW BUY NOW 99999", "$$$ click click click\n$$$ click click click\n", "aaaa aaaa aaaa aaaa aaaa", "l33t #### @@@@ !!!! ####"]


def fixture(spark, rng, n=70):
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = " ".join(rng.choice(GOOD if good else BAD, 2)) + f" {i}"
        docs.append((i, None if i == 13 else "" if i == 14 else text))
        if i % 2 == 0:
            labels.append((i, int(good), int(not good)))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_features(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 82
    cls = [next((i for i, c in enumerate(CLASSES) if b < 128 and chr(b) in c), 7 if b >= 128 else 6) for b in raw]
    out = [cls.count(i) / len(cls) for i in range(8)]
    after = list(zip(cls, cls[1:]))
    out += [(sum(p == (a, b) for p in after) / len(after) if after else 0.0) for a in range(8) for b in range(8)]
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if n:
        count = {w: words.count(w) for w in words}
        out += [math.log(1 + n) / 8, len(count) / n, max(count.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(raw) / n / 16, sum(v for v in count.values() if v > 3) / n, sum(w.isupper() for w in words) / n, len(count) / n**0.8 / 4]
    else:
        out += [0.0] * 8
    return [*out, len(set(lines)) / len(lines), math.log(1 + len(lines)) / 8]


def sigmoid(z):
    return 1 / (1 + math.exp(-min(40, max(-40, z))))


def adam(w, gradient, steps, rate, l2):
    m, v = [0.0] * len(w), [0.0] * len(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        for k in range(len(w)):
            x = g[k] + (l2 * w[k] if k < len(w) - 1 else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def test_quality_as_a_whole(spark, monkeypatch):
    """The risk's parts are summed row by row; the prior is the operator's own, which has tests of its own."""
    docs, labels, d, l = fixture(spark, np.random.default_rng(2))
    known = {}
    prior_of = quality.estimate_prior
    monkeypatch.setattr(quality, "estimate_prior", lambda *a: known.setdefault("prior", prior_of(*a)))
    model = quality.fit_quality(d, l)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(d, model).collect()}
    x = np.array([plain_features(t) for _, t in docs], np.float32).astype(float)
    mean = x.mean(0)
    scale = np.sqrt(np.maximum((x * x).mean(0) - mean**2, 0)) + 1e-3
    std = np.clip((x - mean) / scale, -6, 6)
    wide = [np.append(np.concatenate([r, np.abs(r)]), 1.0) for r in std]
    trusted = [i for i, q, _ in labels if q == 1 and zlib.crc32(str(i).encode()) % 5]
    prior = known["prior"]
    assert trusted and 0 < prior < 1

    def gradient(w):
        pos = [(sigmoid(wide[i] @ w), math.log(1 + math.exp(wide[i] @ w)), wide[i]) for i in trusted]
        free = [(sigmoid(r @ w), math.log(1 + math.exp(r @ w)), r) for r in wide]
        negative = sum(s * r for s, _, r in free) / len(free) - prior * sum(s * r for s, _, r in pos) / len(pos)
        positive = prior * sum((s - 1) * r for s, _, r in pos) / len(pos)
        risk = sum(k for _, k, _ in free) / len(free) - prior * sum(k for _, k, _ in pos) / len(pos)
        return positive + negative if risk >= 0 else -negative

    w = np.array(adam(np.append(np.zeros(164), math.log(prior / (1 - prior))), gradient, 500, 0.03, 1e-4))
    for (i, _), r in zip(docs, wide, strict=True):
        assert got[i] == pytest.approx(sigmoid(r @ w), abs=2e-3)


def test_toxicity_as_a_whole(spark):
    """n-grams by slices of bytes, counts by sets, ratios, errors and the weights by loops."""
    docs, labels, d, l = fixture(spark, np.random.default_rng(3), 400)
    model = toxicity.fit_toxicity(d, l)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, model).collect()}

    def grams(text):
        """The hash of each size's every n-gram, one at a time."""
        raw = bytes(toxicity._BLANK[np.frombuffer(f" {text or ''} ".lower().encode(), np.uint8)])
        found = set()
        for n in toxicity.SIZES:
            for a in range(len(raw) - n + 1):
                h = raw[a] * 0x9E3779B1 % 2**32
                for k in range(2, n + 1):
                    h = (h ^ (raw[a + k - 1] + k)) * 0x85EBCA6B % 2**32
                    h ^= h >> 13
                found.add(h >> (32 - toxicity.BITS))
        return found

    of = {i: grams(t) for i, t in docs}
    used = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    ones, zeros = sum(y for _, y in used), sum(1 - y for _, y in used)
    kept, a = {}, toxicity.ALPHA
    for g in set().union(*(of[i] for i, _ in used)):
        n1, n0 = sum(y for i, y in used if g in of[i]), sum(1 - y for i, y in used if g in of[i])
        p, q = (n1 + a) / (ones + 2 * a), (n0 + a) / (zeros + 2 * a)
        odds = math.log(p / (1 - p)) - math.log(q / (1 - q))
        error = math.sqrt(sum(1 / (c + a) for c in (n1, ones - n1, n0, zeros - n0)))
        if n1 + n0 >= toxicity.MIN_DOCS and abs(odds / error) >= toxicity.MIN_Z:
            kept[g] = math.log(p / q)
    assert len(kept) > 5 and (len(kept), sorted(set(kept) ^ set(model.ids.tolist()))) == (len(model.ids), [])
    names = sorted(kept)
    x = {i: np.array([kept[g] * (g in of[i]) for g in names] + [1.0]) for i, _ in docs}
    share = {1: 0.5 / ones / (0.5 / ones * ones + 0.5 * (zeros / ones) / zeros * zeros), 0: 0.5 * (zeros / ones) / zeros / (0.5 / ones * ones + 0.5 * (zeros / ones) / zeros * zeros)}

    def gradient(w):
        return sum(share[y] * (sigmoid(x[i] @ w) - y) * x[i] for i, y in used)

    w = np.array(adam(np.append(np.zeros(len(names)), -math.log(zeros / ones)), gradient, 120, 0.05, 2e-5))
    for i, _ in docs:
        assert got[i] == pytest.approx(sigmoid(x[i] @ w), abs=1e-6)


def test_queries_read_the_whole_table(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.op3_quality_pu(spark, sf_dir).count() == n == queries.op4_toxicity_nb(spark, sf_dir).count()
