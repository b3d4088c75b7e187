"""Column generation against all patterns of small cases; packings against their definition."""

from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillwork.llm import cutting_stock as S
from quillwork.llm import queries
from quillwork.llm.bpe import ids_crc32, public_vocabulary


def all_patterns(lengths, capacity):
    return [p for p in product(*(range(capacity // n + 1) for n in lengths)) if 0 < sum(n * k for n, k in zip(lengths, p, strict=True)) <= capacity]


@pytest.mark.parametrize("seed", range(20))
def test_knapsack(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 16))
    lengths = sorted(rng.choice(np.arange(1, capacity + 1), 4, replace=False).tolist())
    prices = np.zeros(capacity + 1)
    prices[lengths] = rng.normal(0.4, 0.3, 4)
    best = max(sum(prices[n] * k for n, k in zip(lengths, p, strict=True)) for p in all_patterns(lengths, capacity))
    found = S.priced_patterns(prices, capacity)
    if best <= 1 + 1e-9:
        assert not found
    else:
        assert found[0][0] == pytest.approx(best)
        for worth, pattern in found:
            assert sum(pattern) <= capacity and sum(prices[pattern]) == pytest.approx(worth)


@pytest.mark.parametrize("seed", range(30))
def test_program_is_optimal(seed):
    """All pieces are used; and prices under which no pattern at all is worth more than a sequence prove the least number."""
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(6, 20))
    counts = np.zeros(capacity + 1, np.int64)
    lengths = sorted(rng.choice(np.arange(1, capacity + 1), min(5, capacity), replace=False).tolist())
    counts[lengths] = rng.integers(1, 50, len(lengths))
    patterns, used, bound = S.solve(counts, capacity, gap=1e-12)
    made = np.zeros(capacity + 1)
    for p, x in patterns:
        assert sum(p) <= capacity and x > -1e-7
        for n in p:
            made[n] += x
    assert np.allclose(made, counts) and sum(x for _, x in patterns) == pytest.approx(used)
    assert used == pytest.approx(bound)
    # Weak duality: a bound of the prices holds for all patterns; checked against all of them.
    a = np.array(all_patterns(lengths, capacity), float)
    least = _dual_bound(a, counts[lengths].astype(float))
    assert used >= least - 1e-6


def _dual_bound(a, need):
    """A feasible price vector by scaling: worth of each length its share of a sequence."""
    y = need / need.sum()
    return float(need @ y / (a @ y).max())


@pytest.mark.parametrize(("counts", "wanted"), [({3: 10}, 10 / 3), ({6: 5, 4: 5}, 5), ({7: 3, 5: 4, 3: 3}, 5), ({4: 1, 3: 1}, 3 / 4)])
def test_known_optima(counts, wanted):
    """Capacity 10: pieces of 3 go three to a sequence; 4 and 3 mix as half a 4 + 3 + 3 and a quarter 4 + 4."""
    c = np.zeros(11, np.int64)
    for n, k in counts.items():
        c[n] = k
    assert S.solve(c, 10, gap=1e-12)[1] == pytest.approx(wanted)


@pytest.mark.parametrize("seed", range(10))
def test_patterns_have_no_padding(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(rng.geometric(0.02, 3000), 128), minlength=129)
    left = counts.copy()
    for p, k in S.whole_patterns(counts, 128):
        assert k > 0 and sum(p) <= 128 and sum(p).bit_count() == 1
        for n in p:
            left[n] -= k
    assert (left >= 0).all() and (left * np.arange(129)).sum() < 0.2 * (counts * np.arange(129)).sum()


def test_stopped_early_it_is_whole_all_the_same():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 65, 500), minlength=65)
    for pivots in (0, 3):
        left = counts.copy()
        for p, k in S.whole_patterns(counts, 64, pivots=pivots):
            for n in p:
                left[n] -= k
        assert (left >= 0).all()


@pytest.mark.parametrize("seed", range(10))
def test_cutting(seed):
    rng = np.random.default_rng(seed)
    left = rng.integers(0, 4, 17)
    left[0] = 0
    cut = S.Cutting(left, 16, 100)
    length = np.repeat(np.arange(17), left)
    rank = np.concatenate([np.arange(k) for k in left])
    mix = rng.permutation(len(length))
    row, start, n, sequence, offset = cut(length[mix], rank[mix])
    covered, places = defaultdict(list), defaultdict(list)
    for i, s, k, q, o in zip(row, start, n, sequence, offset, strict=True):
        covered[i] += range(s, s + k)
        places[q] += range(o, o + k)
    assert all(sorted(covered[i]) == list(range(length[mix][i])) for i in range(len(length)))
    sizes = [len(places[q]) for q in sorted(places)]
    assert sorted(places) == list(range(100, 100 + len(sizes))) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(s == 16 for s in sizes[: left @ np.arange(17) // 16]) and all(s.bit_count() == 1 for s in sizes)


def check_packing(rows, found, capacity, end_id):
    tokenizer = Tokenizer.from_file(public_vocabulary())
    wanted = defaultdict(list)
    for key, text in rows:
        wanted[key].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id])
    sequences, got = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and ids_crc32(ids) == r["ids_crc32"]
        got[r["doc_id"]].append((r["doc_tokens"], r["start"], ids.tolist()))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity and at.bit_count() == 1
    for key, texts in wanted.items():
        # Ids that are shared have the pieces of all their rows.
        cover = defaultdict(list)
        for total, start, ids in got.pop(key):
            cover[total] += [(start + i, x) for i, x in enumerate(ids)]
        assert sorted((n, *x) for n, pairs in cover.items() for x in pairs) == sorted((len(t), i, x) for t in texts for i, x in enumerate(t))
    assert not got


@pytest.mark.parametrize("capacity", [16, 256])
def test_packing(spark, capacity):
    rng = np.random.default_rng(3)
    words = "alpha beta, gamma\n delta wörd <|endoftext|> the of and".split(" ")
    texts = ["", None, " ", "one", "é" * 40, " ".join(["again"] * 3000), *(" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(300))]
    rows = [*enumerate(texts), (5, "twice"), (5, "twice"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, ids string, length int").repartition(5)
    found = S.pack_by_patterns(docs, public_vocabulary(), capacity=capacity, end_id=1, with_ids=True)
    check_packing(rows, found.collect(), capacity, 1)
    plain = S.pack_by_patterns(docs, public_vocabulary(), capacity=capacity, end_id=1)
    assert plain.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    total = lambda df: df.agg(F.sum("length"), F.sum("ids_crc32"), F.count("*")).first()
    assert plain.agg(F.sum("length")).first()[0] == total(found)[0]


def test_query_on_the_small_table(spark, sf_dir):
    """Crc32 of parts cut after the fact are of the right ids; no sequence is padded; few documents are cut."""
    found = queries.op12_cutting_stock_packing(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_vocabulary())
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sequences = defaultdict(int)
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and ids_crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]] += r["length"]
    assert sum(sequences.values()) == sum(map(len, ids.values())) and all(n.bit_count() == 1 and n <= 2048 for n in sequences.values())


def test_odd_tables(spark):
    assert S.pack_by_patterns(spark.createDataFrame([], "doc_id string, text string"), public_vocabulary()).collect() == []
    with pytest.raises(ValueError):
        S.pack_by_patterns(spark.createDataFrame([], "doc_id string, text string"), public_vocabulary(), capacity=1000)
