"""Exact and near dedup, and packing, against brute force; odd rows."""

import random
import re
import string
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillwork.llm import exact_dedup, packing, simhash_dedup
from quillwork.llm.bpe import ids_crc32, public_vocabulary

ODD = "doc_id long, text string, lang string, kept string, keep_id string, _h string, fp string"


def table(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "x", "y", "z", None) for i, t in rows], ODD)


ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "same text"), (7, "same text"), (None, "same text"), (8, "x" * 30000), (9, " same text")]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, keep, weak):
    how = {"content_hash": lambda norm: F.substring(F.unhex(F.md5(norm)), 1, 0)} if weak else {}  # every text under one hash
    got = exact_dedup.exact_dedup(table(spark, ROWS), keep=keep, **how).collect()
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    groups = {}
    for i, t in ROWS:
        groups.setdefault((t or "").translate(lower), []).append(i)
    wanted = []
    for i, t in ROWS:
        ids = groups[(t or "").translate(lower)]
        best = (min if keep == "min" else max)(x for x in ids if x is not None)
        wanted.append((i, best, len(ids), i == best))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=key) == sorted(wanted, key=key)


def test_exact_dedup_of_nothing_and_columns(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    left = exact_dedup.drop_exact_copies(table(spark, [(1, "a"), (2, "A"), (3, "b")]))
    assert left.columns == [c.split()[0] for c in ODD.split(", ")] and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d", "é x y z z z z", "w " * 40000])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    for words in (1, 4):
        a = rng.integers(0, 1 << 63, (1000, words), dtype=np.uint64)
        b = a.copy()
        for i in range(1000):
            for bit in rng.choice(64 * words, rng.integers(0, 6 * words), replace=False):
                b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        for radius in (0, 1, 2, 3, 4, 11, 17):
            assert (simhash_dedup.linked(a, b, radius) == (np.bitwise_count(a ^ b).sum(1) <= radius)).all()
    assert len(simhash_dedup.linked(a[:0], b[:0])) == 0


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_against_brute_force(spark, tile):
    rng = random.Random(3)
    fps = {0, 1, 3, 7, 15}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(base)
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                base ^= 1 << bit
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if ((x ^ y) % (1 << 64)).bit_count() <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    edges = simhash_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"), tile=tile)
    got = {r["v"]: r["root"] for r in simhash_dedup.components(edges).collect()}
    assert {x: got.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long), (3, long + " tail"), (9, long), (2, None), (4, "  "), (1, "other text here"), (None, long), (9, long)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash_dedup.near_duplicates(table(spark, rows)).collect()), key=str)
    fp = {t: simhash_dedup.fingerprint(t) for _, t in rows}
    near = ((fp[long] ^ fp[long + " tail"]) % (1 << 64)).bit_count() <= 2
    top = 3 if near else 5
    assert got == sorted([(5, top), (3, 3), (9, top), (9, top), (2, 2), (4, 2), (1, 1), (None, top)], key=str)
    assert simhash_dedup.near_duplicates(table(spark, [])).count() == 0
    assert {r["doc_id"] for r in simhash_dedup.drop_near_copies(table(spark, [(1, "a b"), (2, "A b"), (3, "c d"), (5, None), (4, "")])).collect()} == {1, 3, 4}
    assert simhash_dedup.drop_near_copies(table(spark, [])).count() == 0


def test_keys_are_not_broadcast(spark):
    """By the size that Spark sees before keys are exploded they fit a broadcast, by their own they do not."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-(1 << 62), 1 << 62, 24).tolist(), rng.bytes(32), 20) for i in range(8000)]
    rows += [(i + 8000, rows[i][1], rows[i][2], 20) for i in range(0, 8000, 400)]
    nodes = simhash_dedup.write_scratch(spark.createDataFrame(rows, "node long, keys array<long>, bits binary, size long"), "test-nodes")
    narrow = {"spark.sql.autoBroadcastJoinThreshold": "512k", "spark.sql.maxBroadcastTableSize": "4m"}
    before = {k: spark.conf.get(k) for k in narrow}
    try:
        for k, v in narrow.items():
            spark.conf.set(k, v)
        got = simhash_dedup.keyed_links(nodes, simhash_dedup.SIMILAR_RADIUS).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(sorted(r)) for r in got) == [(i, i + 8000) for i in range(0, 8000, 400)]


def test_large_groups_as_small_ones():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, (6, 1), dtype=np.uint64)
    fps = base[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, 1), dtype=np.uint64))
    pairs = np.array([(i, j) for j in range(300) for i in range(j) if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 2])
    assert (simhash_dedup._reach(fps, 2) == simhash_dedup._forest(300, pairs[:, 0], pairs[:, 1])).all()


@pytest.mark.parametrize("tile", [8, 4096])
def test_similar_documents(spark, tile):
    """Texts of one, two and many changed words, clean ones, and one group of near copies larger than a tile."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, family = [], {}
    for f in range(30):
        base = [word() for _ in range(rng.randint(150, 400))]
        for c in range(40 if f == 0 else rng.randint(1, 4)):
            text = list(base)
            if c:
                for _ in range(rng.randint(1, max(1, len(text) // 120))):
                    text[rng.randrange(len(text))] = word()
            i = len(rows)
            rows.append((i, " ".join(text)))
            family[i] = f
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(table(spark, rows), tile=tile).collect()}
    first = {}
    for i, f in family.items():
        first.setdefault(f, i)
    assert got == {i: first[f] for i, f in family.items()}


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("tile", [4, 4096])
def test_similar_documents_around_the_threshold(spark, tile):
    """Texts of n shingles and of their first k, and chains of such, short and long, against all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for n, *cuts in [(5, 4), (6, 5), (6, 4), (10, 8), (15, 12), (15, 11), (25, 20), (25, 19), (26, 20), (250, 200), (250, 199), (250, 210, 170, 140), (1000, 800), (1000, 799), (100, 70), (20, 16, 13, 11, 9)]:
        for _ in range(6):
            base = [word() for _ in range(n + 4)]
            rows += [" ".join(base[: k + 4]) for k in (n, *cuts)]
    rng.shuffle(rows)
    sets = [shingles(t) for t in rows]
    top = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if top[i] != top[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(table(spark, list(enumerate(rows))), tile=tile).collect()}
    assert got == dict(enumerate(top))


def check_packing(rows, docs, capacity):
    fresh = Tokenizer.from_file(public_vocabulary())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    whole = sorted((str(i), (*fresh.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in docs)
    pieces = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        part = np.frombuffer(r["ids"], "<u4")
        assert len(part) == r["length"] and ids_crc32(part) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == capacity
        pieces.setdefault(str(r["doc_id"]), []).append((r["start"], part))
    if len({str(i) for i, _ in docs}) == len(docs):
        assert sorted((i, tuple(np.concatenate([p for _, p in x]).tolist())) for i, x in pieces.items()) == whole
    return len(by_sequence)


def test_packing(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["a", "bc", "the", "é☃"]) for _ in range(rng.choice([0, 3, 20, 60, 200])))) for i in range(120)] + [(None, "null id"), (500, None), (501, "a <|endoftext|> b" * 20)]
    got = packing.pack(table(spark, docs), public_vocabulary(), capacity=64, with_ids=True).collect()
    used = check_packing(got, docs, 64)
    assert used <= packing.lower_bound(np.bincount([r["length"] for r in got], minlength=65), 64) + 1
    assert packing.pack(table(spark, []), public_vocabulary()).count() == 0
    same = packing.pack(table(spark, [(1, "a b"), (1, "a b")]), public_vocabulary()).collect()
    assert len(same) == 2 and len({(r["sequence_id"], r["offset"]) for r in same}) == 2


def least_bins(sizes, capacity):
    """Exact by trying every bin for each piece."""
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins) if b >= sizes[i]}.values():
            put(i + 1, bins[:k] + [bins[k] - sizes[i]] + bins[k + 1 :])
        put(i + 1, [*bins, capacity - sizes[i]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_is_near_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 30])
    sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 11))), reverse=True)
    counts = np.bincount(sizes, minlength=capacity + 1)
    found = packing.pack_histogram(counts, capacity)
    used = np.zeros(capacity + 1, int)
    for filling, n in found:
        assert sum(filling) <= capacity
        for s in filling:
            used[s] += n
    assert (used == counts).all()
    least = least_bins(sizes, capacity)
    assert packing.lower_bound(counts, capacity) <= least == sum(n for _, n in found)


@pytest.mark.parametrize("seed", range(30))
def test_exhaustive_search_is_exact(seed):
    """Up to 15 pieces, and repeated lengths that had better not be used up at once."""
    rng = random.Random(100 + seed)
    capacity = rng.choice([12, 30, 100])
    sizes = sorted((rng.choice([rng.randint(1, capacity), capacity // 3, capacity // 4 + 1]) for _ in range(rng.randint(8, 15))), reverse=True)
    counts = np.bincount(sizes, minlength=capacity + 1)
    found = packing.pack_histogram(counts, capacity, nodes=None)
    assert Counter(s for f, n in found for s in f for _ in range(n)) == Counter(sizes)
    assert all(sum(f) <= capacity for f, _ in found)
    assert least_bins(sizes, capacity) == sum(n for _, n in found)


def test_fillings_are_all_the_undominated_ones():
    """Every maximal filling is there, or one that is there dominates it."""
    rng = random.Random(4)
    for _ in range(40):
        counts = [0] * 21
        for _ in range(rng.randint(1, 9)):
            counts[rng.randint(1, 20)] += 1
        sizes = [s for s in range(20, 0, -1) if counts[s]]
        space = rng.randint(1, 20)
        found = list(packing.fillings(space, counts.copy(), sizes))
        waste = [space - sum(f) for f in found]
        assert waste == sorted(waste) and len(set(found)) == len(found)

        def all_of(at, left):
            yield ()
            for i in range(at, len(sizes)):
                for k in range(1, min(counts[sizes[i]], left // sizes[i]) + 1):
                    for rest in all_of(i + 1, left - k * sizes[i]):
                        yield (sizes[i],) * k + rest

        for f in all_of(0, space):
            assert f in found or any(packing._dominated(g, f) for g in found)


def test_search_improves_on_best_fit():
    rng = np.random.default_rng(1)
    gains = []
    for low, high, n in [(200, 500, 120), (100, 400, 200), (150, 700, 200), (200, 500, 120)]:
        counts = np.bincount(rng.integers(low, high + 1, n), minlength=1025)
        used = [sum(k for _, k in x) for x in (packing.best_fit(counts, 1024), packing.pack_histogram(counts))]
        assert packing.lower_bound(counts, 1024) <= used[1] <= used[0]
        gains.append(used[0] - used[1])
    assert sum(gains) >= 3
