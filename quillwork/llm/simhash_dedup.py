"""SimHash near-duplicates, compared bit-sliced.

Documents become fingerprints; equal ones become one node.  Nodes that may link meet
under keys, by a shuffle, and are compared bit-sliced: bit planes stand vertically, 64
pairs to a word; carry-save adders sum up the planes' differences of very many pairs at
once, and words whose pairs have all passed the radius are abandoned.  Keys with very
many nodes are dealt out as pairs of tiles.  A task reports a spanning forest of its
links, not all of them, and connected components are found by joins and aggregates.

Two ways to make keys:
* near_duplicates: fingerprints of 64 bits within a small radius agree on at least
  blocks - radius of `blocks` blocks of bits, so keys of that many whole blocks miss no link.
* similar_documents: links are Jaccard similarities of whole shingle sets of at least 0.8,
  counted exactly.  Distances of 256-bit fingerprints only say which pairs are worth
  counting.  Sets of 0.8 differ in 39 bits on average, with a deviation of 6, and in 48 at
  worst (5 shingles and 4 of them): beyond the radius of 84 with a chance of 3e-8, and beyond
  the 76 of sets of 10 or more with one of 2e-8.  No blocks of such a radius are
  selective, so keys are minima of permuted shingle hashes, 24 of 3 each: sets of 0.8
  share none with a chance of 3e-8.  Sets are counted within the components of these
  loose links, dealt as pairs of tiles where they are large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import drop_scratch, keep_named, write_scratch

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Blocks of bits, and fingerprints of one key that a task compares with each other.
BLOCKS, TILE = 4, 1024
#: Of similar_documents: words of a shingle, 64-bit words of a fingerprint, the radius within which sets are counted, that of sets from SIMILAR_LARGE on, and keys of so many minima.
SIMILAR_SHINGLE, SIMILAR_WORDS, SIMILAR_RADIUS, LARGE_RADIUS, SIMILAR_LARGE, KEYS, MINIMA = 5, 4, 84, 76, 10, 24, 3
#: Least similarity, as a fraction; sets of one component that a task counts with each other, and the letters of their texts.
SIMILAR, SET_TILE, SET_LETTERS = (4, 5), 1024, 1 << 23
#: Groups up to this size are compared together; rows of larger ones are compared with the rest so many at a time.
SMALL = 64
#: Words that a worker remembers the hashes of.
MEMORY = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: By byte: each of its bits in a byte of its own, so that up to 255 rows are counted by adding words.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def _words(text: str | None) -> list[bytes]:
    """What stands between ASCII blanks, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words have each bit."""
    rows = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1)
    counts = np.zeros(rows.shape[1] * 8, np.int64)
    for a in range(0, len(rows), 255):
        counts += _SPREAD[rows[a : a + 255]].sum(0, dtype=np.uint64).view(np.uint8)
    return counts


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles, repeats included, over the whole text; 0 without a word.

    Words are what stands between ASCII blanks after lower-casing A-Z; fewer words than
    a shingle are one shingle.  A bit is set if it is in over half of the XXH64 hashes.
    """
    from xxhash import xxh64_intdigest as digest

    words = _words(text)
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for a in range(0, n, 1 << 14):
        h = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(a, min(n, a + (1 << 14)))], "<u8")
        counts += _bit_counts(h[:, None])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


class WordHashes(dict):
    """XXH64 of words, looked up once a word; a task has its own."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = self[word] = xxh64_intdigest(word, SEED)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingle_hashes(text: str | None, known: WordHashes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the word shingles of the whole text; none without a word."""
    words = _words(text)
    if len(known) > MEMORY:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    take = min(shingle, len(h))
    if not take:
        return h
    out = h[: len(h) - take + 1].copy()
    for k in range(1, take):
        out = _mix(out) + h[k : len(h) - take + 1 + k]
    return np.unique(_mix(out))


_SALTS = _mix(np.arange(1, KEYS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SALTS_32, _ODD_32 = (_SALTS >> np.uint64(32)).astype(np.uint32), _SALTS.astype(np.uint32) | np.uint32(1)


def sketch(text: str | None, known: WordHashes, shingle: int = SIMILAR_SHINGLE) -> tuple[bytes, list[int], int, int]:
    """A fingerprint of 64 * SIMILAR_WORDS bits over distinct shingles, KEYS keys, a hash of the whole set and its size; texts without a word share theirs."""
    from xxhash import xxh64_intdigest as digest

    h = shingle_hashes(text, known, shingle)
    counts = np.zeros(64 * SIMILAR_WORDS, np.int64)
    least = np.full(KEYS * MINIMA, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(h), 4096):
        part = h[a : a + 4096]
        counts += _bit_counts(np.stack([part, *(_mix(part ^ s) for s in _SALTS[: SIMILAR_WORDS - 1])], axis=1))
        least = np.minimum(least, (((part >> np.uint64(32)).astype(np.uint32)[:, None] ^ _SALTS_32) * _ODD_32).min(0))
    key = np.zeros(KEYS, np.uint64)
    for column in least.reshape(KEYS, MINIMA).T:
        key = _mix(key + column)
    node = digest(h.astype("<u8").tobytes(), SEED)
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes(), key.view(np.int64).tolist(), node - (node >> 63 << 64), len(h)


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (a row of 64-bit words each): row b holds bit b of all, 64 to a word."""
    n, width = -(-len(fps) // 64) * 64, fps.shape[1] * 64
    bits = np.zeros((n, width), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, width // 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _over(weights: list[list[np.ndarray]], radius: int) -> np.ndarray:
    """Which pairs' sums, lists of planes by weight, are above the radius."""
    carry, sums = None, []
    for planes in weights:
        planes = [*planes, *([] if carry is None else [carry])]
        carry = None
        while len(planes) > 1:
            x, y, *rest = planes
            c = x & y
            if rest:
                xy = x ^ y
                c, planes = c | (xy & rest[0]), [xy ^ rest[0], *rest[1:]]
            else:
                planes = [x ^ y]
            carry = c if carry is None else carry | c  # at most three planes a weight: one carry
        sums.append(planes[0] if planes else None)
    if carry is not None:
        sums.append(carry)
    shape = next(x for x in sums if x is not None)
    above, equal = np.zeros_like(shape), np.full_like(shape, _ALL)
    for k in reversed(range(len(sums))):
        x = np.zeros_like(shape) if sums[k] is None else sums[k]
        if radius >> k & 1:
            equal = equal & x
        else:
            above, equal = above | (equal & x), equal & ~x
    return above


def within(differ: Callable[[int, np.ndarray | None], np.ndarray], bits: int, words: int, radius: int) -> np.ndarray:
    """Words of 64 pairs each: which pairs differ in at most `radius` of the bits.

    differ(b, live) is where the pairs differ in bit b, for all words or the live ones.
    Three planes of one weight become one of it and one of the next (a carry-save adder).
    """
    weights: list[list[np.ndarray]] = [[] for _ in range(bits.bit_length() + 1)]
    found, live, step = np.zeros(words, np.uint64), None, min(32, bits)
    for b in range(bits):
        weights[0].append(differ(b, live))
        k = 0
        while len(weights[k]) == 3:
            x, y, z = weights[k]
            xy = x ^ y
            weights[k] = [xy ^ z]
            weights[k + 1].append((x & y) | (xy & z))
            k += 1
        if (b + 1) % step and b + 1 < bits or b < min(radius, bits - 1):
            continue
        over = _over(weights, radius)
        if b + 1 == bits:
            found[slice(None) if live is None else live] = ~over
            break
        stay = np.flatnonzero(over != _ALL)
        if not len(stay):
            break
        if 4 * len(stay) <= 3 * len(over):
            weights = [[x[stay] for x in planes] for planes in weights]
            live = stay if live is None else live[stay]
    return found


def linked(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the pairs left[i], right[i] (rows of 64-bit words) differ in at most `radius` bits."""
    if not len(left):
        return np.zeros(0, bool)
    planes = _planes(left ^ right)
    found = within(lambda b, live: planes[b] if live is None else planes[b, live], *planes.shape, radius)
    return np.unpackbits(found.view(np.uint8), bitorder="little")[: len(left)] == 1


def _ahead(planes: np.ndarray, steps: np.ndarray, radius: int) -> np.ndarray:
    """For each step (1 to 63), which rows are linked to the row so many places on."""
    bits, words = planes.shape
    follow = np.concatenate([planes[:, 1:], np.zeros((bits, 1), np.uint64)], axis=1)
    right, left = steps.astype(np.uint64)[:, None], (64 - steps).astype(np.uint64)[:, None]

    def differ(b: int, live: np.ndarray | None) -> np.ndarray:
        p, f = planes[b], follow[b]
        if live is None:
            return (p ^ (p >> right | f << left)).ravel()
        s, w = live // words, live % words
        return p[w] ^ (p[w] >> right[s, 0] | f[w] << left[s, 0])

    found = within(differ, bits, words * len(steps), radius)
    return np.unpackbits(found.view(np.uint8), bitorder="little").reshape(len(steps), -1) == 1


def _against(planes: np.ndarray, seeds: np.ndarray, radius: int) -> np.ndarray:
    """For each seed fingerprint, which rows of the planes it is linked to."""
    bits, words = planes.shape
    flips = np.where(np.unpackbits(np.ascontiguousarray(seeds).view(np.uint8).reshape(len(seeds), -1), axis=1, bitorder="little") == 1, _ALL, np.uint64(0))

    def differ(b: int, live: np.ndarray | None) -> np.ndarray:
        if live is None:
            return (planes[b] ^ flips[:, b, None]).ravel()
        return planes[b, live % words] ^ flips[live // words, b]

    found = within(differ, bits, words * len(seeds), radius)
    return np.unpackbits(found.view(np.uint8), bitorder="little").reshape(len(seeds), -1) == 1


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows is connected to."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (label[label] != label).any():
        label = label[label]
    return label


Fit = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _reach(fps: np.ndarray, radius: int, fit: Fit | None = None) -> np.ndarray:
    """Smallest row that each row is connected to, in one large group.

    Rows are held against what is not reached yet, SMALL at a time; what they reach leaves it
    and is held against the rest in its turn, so clusters cost little.
    """
    joined_a, joined_b = [], []
    rest, edge = np.arange(len(fps)), np.zeros(0, np.int64)
    seen, planes = rest, _planes(fps)
    while len(rest):
        if not len(edge):
            edge = rest[:SMALL]
        seeds, edge = edge[:SMALL], edge[SMALL:]
        if 2 * len(rest) < len(seen):
            seen, planes = rest, _planes(fps[rest])
        hit = _against(planes, fps[seeds], radius)[:, : len(seen)]
        # Seeds drawn from the rest stand in it themselves; what was reached before is no news.
        hit &= np.isin(seen, rest)
        s, r = np.nonzero(hit)
        s, r = seeds[s], seen[r]
        if fit is not None and len(s):
            ok = fit(s, r)
            s, r = s[ok], r[ok]
        joined_a.append(s)
        joined_b.append(r)
        new = np.setdiff1d(r, seeds)
        edge = np.union1d(np.setdiff1d(edge, seeds), new)
        rest = np.setdiff1d(rest, np.concatenate([new, seeds]))
    return _forest(len(fps), np.concatenate(joined_a), np.concatenate(joined_b))


def _compare(group: np.ndarray, fps: np.ndarray, radius: int, fit: Fit | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forest of links within groups of rows; group is ascending.  fit(rows, rows) says which linked pairs count, by default all."""
    n = len(fps)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    size = np.diff(np.append(starts, n))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, m in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        own = None if fit is None else lambda i, j, at=at: fit(i + at, j + at)
        label = _reach(fps[at : at + m], radius, own)
        moved = np.flatnonzero(label != np.arange(m))
        a.append(moved + at)
        b.append(label[moved] + at)
    # The other groups stand in order of size, largest first: each row meets the next of its group, the second next, and so on.
    small = np.flatnonzero(size <= SMALL)
    small = small[np.argsort(-size[small], kind="stable")]
    size = size[small]
    row = np.repeat(starts[small] - np.cumsum(size) + size, size) + np.arange(size.sum())
    end = np.repeat(np.cumsum(size), size)
    for d in range(1, int(size.max(initial=1)), 8):
        m = int(size[size > d].sum())  # rows of groups that have a row so far ahead
        steps = np.arange(d, min(d + 8, int(size.max())))
        hit = _ahead(_planes(fps[row[:m]]), steps, radius)[:, :m]
        hit &= np.arange(m) + steps[:, None] < end[:m]
        k, i = np.nonzero(hit)
        i, j = row[i], row[i + steps[k]]
        if fit is not None and len(i):
            ok = fit(i, j)
            i, j = i[ok], j[ok]
        a.append(i)
        b.append(j)
    label = _forest(n, np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges a, b between different fingerprints (column fp, distinct 64-bit numbers) that span the components of all links."""
    size, same = 64 // blocks, blocks - radius
    if same < 1:
        raise ValueError("more blocks than bits may differ are needed")
    spans = [(i * size, 64 if i == blocks - 1 else (i + 1) * size) for i in range(blocks)]

    def mask(combo: tuple[int, ...]) -> int:
        m = sum(1 << bit for i in combo for bit in range(*spans[i]))
        return m - (1 << 64) if m >> 63 else m

    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(mask(c))) for c in combinations(range(blocks), same)))
    return keyed_links(fingerprints.select(F.col("fp").alias("node"), keys.alias("keys")), radius, tile)


def _similar_sizes(fps: np.ndarray, sizes: np.ndarray) -> Fit:
    """Which pairs' sets may still have the similarity asked for, by their sizes and the distance of their fingerprints."""

    def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        near = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64) <= LARGE_RADIUS
        return (SIMILAR[1] * low >= SIMILAR[0] * high) & (near | (low < SIMILAR_LARGE))

    return fit


def keyed_links(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges a, b between nodes (node, keys, and bits and size, or the node itself for bits) that share a key at a place and lie within the radius."""
    keyed = nodes.select("node", F.posexplode("keys").alias("k", "v"))
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark takes a node for one key, and would send all keys of all nodes through the driver to every executor.
    dealt = _dealt(keyed.hint("merge").join(sizes, ["k", "v"]), F.ceil(F.col("n") / F.lit(tile)), "node", "k", "v")
    sets = "bits" in nodes.columns
    if sets:  # few nodes share a key, so bits come last
        dealt = dealt.join(nodes.select("node", "bits", "size"), "node")
    group = ["k", "v", "lo", "hi"]

    def out(f: pd.DataFrame) -> pa.RecordBatch:
        change = (f[group].diff() != 0).any(axis=1).to_numpy()
        node = f["node"].to_numpy()
        fps = np.frombuffer(b"".join(f["bits"]), "<u8").reshape(len(f), -1) if sets else node.view(np.uint64).reshape(-1, 1)
        a, b = _compare(np.cumsum(change), fps, radius, _similar_sizes(fps, f["size"].to_numpy()) if sets else None)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return _grouped(dealt, group).mapInArrow(lambda batches: _by_group(batches, group, out), "a long, b long").distinct()


def _grouped(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows of a group together, in as many partitions as shuffles have: their bytes say little of the work."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *group).sortWithinPartitions(*group, "node")


def _dealt(rows: DataFrame, tiles: Column, *columns: str) -> DataFrame:
    """Columns of rows of groups of so many tiles, and lo, hi: a row goes with its own tile to each pair of tiles."""
    rows = rows.withColumn("tiles", F.greatest(tiles, F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("tiles") - 1), F.array(own)))
    met = rows.withColumn("own", own).select(*columns, "own", F.explode(others).alias("other"))
    return met.select(*columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _by_group(batches: Iterator[pa.RecordBatch], group: list[str], out: Callable[[pd.DataFrame], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """out of whole groups of rows that stand together; the last group may go on in the next batch."""
    held = None
    for batch in batches:
        f = batch.to_pandas()
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        last = (f[group] == f[group].iloc[-1]).all(axis=1).to_numpy()
        held, done = f[last], f[~last]
        if len(done):
            yield out(done.reset_index(drop=True))
    if held is not None:
        yield out(held.reset_index(drop=True))


def _similar(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest row that each set is connected to by similarities of SIMILAR or more.

    Shingles stand in order of how many sets have them.  Two sets of that similarity share
    one of the first n - ceil(0.8 n) + 1 of either, so a set is counted only with those that
    it meets under these, the rarest; what is reached leaves the rest.
    """
    sizes = np.array([len(x) for x in sets])
    label = np.arange(len(sets))
    if not sizes.sum():
        return np.zeros(len(sets), np.int64)
    label[sizes == 0] = np.flatnonzero(sizes == 0)[:1]
    names, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(names))
    start = np.cumsum(sizes) - sizes
    flat = rank[at][np.lexsort((rank[at], np.repeat(np.arange(len(sets)), sizes)))]
    prefix = sizes - -(-SIMILAR[0] * sizes // SIMILAR[1]) + (sizes > 0)
    of_set = np.repeat(np.arange(len(sets)), prefix)
    key = flat[np.repeat(start - np.cumsum(prefix) + prefix, prefix) + np.arange(prefix.sum())]
    by_key = np.argsort(key, kind="stable")
    key, of_set = key[by_key], of_set[by_key]
    alive, mark = sizes > 0, np.zeros(len(names), bool)
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed], edge = False, [seed]
        while edge:
            e = edge.pop()
            own = flat[start[e] : start[e] + sizes[e]]
            lo, hi = (np.searchsorted(key, own[: prefix[e]], side) for side in ("left", "right"))
            met = [of_set[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b - a > 1]
            other = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            other = other[alive[other]]
            if not len(other):
                continue
            n = sizes[other]
            mark[own] = True
            ends = np.cumsum(n)
            both = np.add.reduceat(mark[flat[np.repeat(start[other] - ends + n, n) + np.arange(ends[-1])]].astype(np.int64), ends - n)
            mark[own] = False
            hit = other[SIMILAR[1] * both >= SIMILAR[0] * (sizes[e] + n - both)]
            label[hit] = seed
            alive[hit] = False
            edge.extend(hit.tolist())
    return label


def set_links(texts: DataFrame, tile: int = SET_TILE, letters: int = SET_LETTERS) -> DataFrame:
    """Edges a, b that span the components of exact similarities among the nodes (root, node, text) of each root."""
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("letters"))
    group = ["root", "lo", "hi"]
    tiles = F.greatest(F.ceil(F.col("n") / F.lit(tile)), F.ceil(F.coalesce("letters", F.lit(0)) / F.lit(letters)))
    dealt = _dealt(texts.join(sizes, "root"), tiles, "node", "root", "text")

    def out(f: pd.DataFrame) -> pa.RecordBatch:
        node, a, b = f["node"].to_numpy(), [], []
        known = WordHashes()
        sets = [shingle_hashes(x, known) for x in f["text"]]
        starts = np.flatnonzero((f[group].diff() != 0).any(axis=1).to_numpy())
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(f)], strict=True):
            label = _similar(sets[i:j])
            moved = np.flatnonzero(label != np.arange(j - i))
            a.append(node[i + moved])
            b.append(node[i + label[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return _grouped(dealt, group).mapInArrow(lambda batches: _by_group(batches, group, out), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of the edges a, b: the smallest vertex that it is connected to.

    Every round gives a vertex the smallest label around it and then its label's label;
    each round is a written table, so lost executors cost one round at most.
    """
    both = write_scratch(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-edges")
    label = write_scratch(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("root")), "simhash-labels")
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        once = label.join(near, "v").select("v", F.least("root", "near").alias("next"), "root")
        jump = label.select(F.col("v").alias("next"), F.col("root").alias("far"))
        found = write_scratch(once.join(jump, "next").select("v", F.least("next", "far").alias("next"), "root"), "simhash-labels")
        moved = not found.filter("next <> root").isEmpty()
        drop_scratch(label)
        label = found.select("v", F.col("next").alias("root"))
        if not moved:
            drop_scratch(both)
            return label


def named_components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, root, component_id for every node (key, least): one node of its component, and the smallest `least` of those that the edges connect it to.

    Nodes with their roots and the roots' names are written first, so both sides of their
    join are scans under the shuffle and AQE splits a component with very many nodes.
    """
    if edges.isEmpty():
        return write_scratch(nodes.select(key, F.col(key).alias("root"), F.col("least").alias("component_id")), "simhash-named")
    found = components(edges)
    rooted = nodes.join(found.withColumnRenamed("v", key), key, "left").withColumn("root", F.coalesce("root", key))
    rooted = write_scratch(rooted, "simhash-rooted")
    names = write_scratch(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    named = write_scratch(rooted.join(names, "root").select(key, "root", "component_id"), "simhash-named")
    drop_scratch(found, rooted, names)
    return named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Per row: id, fingerprint (16 lowercase hex digits), component_id: the smallest id that its fingerprint reaches by links.

    A null text is an empty one; texts without a word have fingerprint zero and link like
    any other.  Null ids have a component and never name one, unless all its ids are null.
    Repeated rows share their component.  Columns other than the two named are not read.
    """

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([fingerprint(x, shingle) for x in t], dtype="int64")

    rows = write_scratch(docs.select(F.col(id_col).alias("_id"), fp(F.col(text_col)).alias("fp")), "simhash-rows")
    nodes = write_scratch(rows.groupBy("fp").agg(F.min("_id").alias("least")), "simhash-nodes")
    edges = write_scratch(links(nodes.select("fp"), radius, blocks, tile), "simhash-links")
    named = named_components(nodes, edges, "fp")
    drop_scratch(nodes, edges)
    # Both sides are scans under the shuffle: AQE splits the rows of a fingerprint that many share.
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar_rows(docs: DataFrame, id_col: str, text_col: str, radius: int, tile: int) -> DataFrame:
    """_id, _mark (a hash of the text), root and component_id of each row of docs."""

    @F.pandas_udf("bits binary, keys array<long>, node long, size long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for t in texts:
            yield pd.DataFrame([sketch(x, known) for x in t], columns=["bits", "keys", "node", "size"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_mark"), F.col(text_col).alias("_text"), run(F.col(text_col)).alias("s"))
    rows = write_scratch(rows.select("_id", "_mark", "_text", "s.*"), "simhash-rows")
    # A node is a set of shingles, by a 64-bit hash of it: equal texts are one.
    nodes = write_scratch(rows.groupBy("node", "bits", "keys", "size").agg(F.min("_id").alias("least")), "simhash-nodes")
    edges = write_scratch(keyed_links(nodes.select("node", "bits", "keys", "size"), radius, tile), "simhash-links")
    if not edges.isEmpty():
        loose = components(edges)
        texts = rows.select("node", "_text").join(loose.withColumnRenamed("v", "node"), "node").groupBy("root", "node").agg(F.first("_text").alias("text"))
        texts = write_scratch(texts, "simhash-texts")
        drop_scratch(edges)
        edges = write_scratch(set_links(texts, min(tile, SET_TILE)), "simhash-set-links")
        drop_scratch(loose, texts)
    named = named_components(nodes.select("node", "least"), edges, "node")
    drop_scratch(nodes, edges)
    return rows.select("_id", "_mark", "node").join(named, "node").drop("node")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = SIMILAR_RADIUS, tile: int = TILE) -> DataFrame:
    """Per row: id, component_id: the smallest id that its text reaches by links of 0.8 Jaccard similarity of its set of five-word shingles or more.

    Odd rows as in near_duplicates.
    """
    return _similar_rows(docs, id_col, text_col, radius, tile).select(F.col("_id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = SIMILAR_RADIUS, tile: int = TILE) -> DataFrame:
    """docs with one document of each component of similar documents, that of the smallest id, all columns as they were.

    Texts without a word (null ones too) are one component.  A component of null ids
    only keeps one of its rows.  Rows that share an id for different texts are told apart
    by the text; of rows equal in id and text any one stays.  An empty table stays empty.
    """
    rows = _similar_rows(docs, id_col, text_col, radius, tile)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_mark")).alias("k")
    kept = write_scratch(rows.groupBy("root").agg(first).select("k._id", "k._mark"), "simhash-kept")
    drop_scratch(rows)
    return keep_named(docs, kept, id_col, kept, F.xxhash64(text_col))
