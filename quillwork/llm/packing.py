"""Packing of tokenised documents into sequences by bin completion.

Documents are tokenised where they lie; those longer than a sequence are cut, the
first piece taking the remainder.  What decides a packing is how many pieces have
each length, at most `capacity` numbers however many documents there are.  The
search runs on that histogram, with the best-fit solution as its incumbent: around
the largest piece it tries the undominated fillings, least waste first, all of them if
need be, and leaves a branch when its waste rules out fewer sequences than the
incumbent's.  It stops at the lower bound, or when nothing has improved for a while; then
parts of the incumbent, its wasteful sequences and some others, are searched anew.  With
nodes=None the search is exhaustive and the packing optimal.  Spark then
gives every piece its place: its rank among the pieces of its length, counted by
task and summed by a window over tasks, names sequence and offset.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.llm._common import by_bytes, write_scratch
from quillwork.llm.bpe import BPE_BYTES, bpe_encoder, forget_encoders, ids_crc32

CAPACITY, END_ID = 1024, 2
#: The search gives up after so many nodes without a better packing; parts of so many sequences are searched anew, by so many nodes each, until so many in a row gave nothing.
NODES, PART, PART_NODES, PARTS = 150, 16, 60, 400


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 over the histogram: counts[n] pieces have length n."""
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(total[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        # Pieces over capacity - k stand alone; those over half share with none of their kind.
        alone, large = int(n[-1] - n[capacity - k]), int(n[capacity - k] - n[capacity // 2])
        free = large * capacity - int(total[capacity - k] - total[capacity // 2])
        small = int(total[capacity // 2] - total[k - 1])
        best = max(best, alone + large + max(0, -(-(small - free) // capacity)))
    return best


def _dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's pieces, all of them, fit group by group into single pieces of a."""
    if sum(b) > sum(a) or a == b:
        return False

    def fit(rest: tuple[int, ...], room: list[int]) -> bool:
        if not rest:
            return True
        tried = set()
        for i, r in enumerate(room):
            if rest[0] <= r and r not in tried:
                tried.add(r)
                room[i] -= rest[0]
                if fit(rest[1:], room):
                    return True
                room[i] += rest[0]
        return False

    return fit(b, list(a))


def _sums(total: int, sizes: list[int], counts: list[int], reach: list[int], at: int = 0) -> Iterator[tuple[int, ...]]:
    """All ways to make the total of pieces at hand, large pieces first; reach[i] has bit t set if sizes[i:] make t."""
    if not total:
        yield ()
        return
    for i in range(at, len(sizes)):
        s = sizes[i]
        if not reach[i] >> total & 1:
            return
        for k in range(min(counts[s], total // s), 0, -1):
            if reach[i + 1] >> (total - k * s) & 1:
                for rest in _sums(total - k * s, sizes, counts, reach, i + 1):
                    yield (s,) * k + rest


def fillings(space: int, counts: list[int], sizes: list[int]) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of the space with pieces at hand, least waste first; sizes: the lengths at hand, largest first."""
    sizes = [s for s in sizes if s <= space]
    if not sizes:
        yield ()
        return
    kept: list[tuple[int, ...]] = []
    # One or two pieces that fill the space need no table.
    have = set(sizes)
    if space in have:
        kept.append((space,))
        yield (space,)
    for s in sizes:
        if 2 * s < space:
            break
        if space - s in have and (2 * s > space or counts[s] > 1):
            kept.append((s, space - s))
            yield kept[-1]
    reach, mask = [1], (1 << space + 1) - 1
    for s in reversed(sizes):
        sums, k, step = reach[-1], min(counts[s], space // s), 1
        while k > 0:
            sums |= sums << s * min(step, k) & mask
            k, step = k - step, 2 * step
        reach.append(sums)
    reach.reverse()
    for total in range(space, 0, -1):
        if not reach[0] >> total & 1:
            continue
        for f in _sums(total, sizes, counts, reach):
            full = not any(s <= space - total and f.count(s) < counts[s] for s in sizes[bisect_left(sizes, total - space, key=int.__neg__) :])
            if full and f not in kept and not any(_dominated(k, f) for k in kept):
                kept.append(f)
                yield f


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Incumbent: around the largest piece, the largest that fits, until nothing fits."""
    left, out = np.asarray(counts).tolist(), []
    sizes = [s for s in range(capacity, 0, -1) if left[s]]
    while sizes:
        largest = sizes[0]
        left[largest] -= 1
        chosen, space = (largest,), capacity - largest
        at = 0
        while (at := max(at, bisect_left(sizes, -space, key=int.__neg__))) < len(sizes):
            k = min(left[sizes[at]], space // sizes[at])
            chosen, space = chosen + (sizes[at],) * k, space - k * sizes[at]
            at += 1
        left[largest] += 1
        n = _times(chosen, left)
        for s in chosen:
            left[s] -= n
        out.append((chosen, n))
        sizes = [s for s in sizes if left[s]]
    return out


def _times(filling: tuple[int, ...], counts: list[int]) -> int:
    """How often the pieces at hand make the filling."""
    return min(counts[s] // n for s, n in Counter(filling).items())


def search(counts: list[int], capacity: int, limit: int, nodes: int | None) -> list[tuple[tuple[int, ...], int]] | None:
    """Depth first for a packing of fewer sequences than the limit; None if there is none, or none within so many nodes after the first descent.

    A node is what is left to pack.  Its branches are the fillings around its largest piece, each
    as often as pieces allow and once, so that any number of times is tried.
    """
    allowed = (limit - 1) * capacity - sum(s * n for s, n in enumerate(counts))
    seen: dict[bytes, int] = {}
    # What is left, sequences, waste, the path to here, branches taken.
    stack: list[tuple] = [(counts, 0, 0, None, 0)] if allowed >= 0 else []
    tried, deepest = 0, False
    while stack and (nodes is None or tried < nodes):
        left, used, waste, path, k = stack.pop()
        sizes = [s for s in range(capacity, 0, -1) if left[s]]
        if not sizes:
            out = []
            while path:
                path, filling, n = path
                out.append((filling, n))
            return out[::-1]
        largest = sizes[0]
        left[largest] -= 1
        rest = sizes if left[largest] else sizes[1:]
        options = ((largest, *f) for f in fillings(capacity - largest, left, rest))
        filling = next(islice(options, k // 2, None), None)
        left[largest] += 1
        if filling is None:
            continue
        lost, most = capacity - sum(filling), _times(filling, left)
        if waste + lost > allowed:
            deepest = True
            continue  # later fillings lose as much or more
        stack.append((left, used, waste, path, k + 1))
        n = 1 if k % 2 else most
        tried += deepest
        if k % 2 and most == 1 or waste + n * lost > allowed:
            deepest = True
            continue
        after = left.copy()
        for s in filling:
            after[s] -= n
        mark = np.array(after, np.int64).tobytes()
        if seen.get(mark, waste + n * lost + 1) > waste + n * lost:
            seen[mark] = waste + n * lost
            stack.append((after, used + n, waste + n * lost, (path, filling, n), 0))
    return None


def _improved(packing: list[tuple[tuple[int, ...], int]], capacity: int, bound: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences with waste and some without are packed anew, together: a part that takes fewer is taken over, and one that gathers its waste in fewer sequences, so that others may follow."""
    rng, idle = np.random.default_rng(0), 0
    kinds: Counter = Counter()
    for filling, n in packing:
        kinds[filling] += n
    while idle < PARTS and kinds.total() > bound:
        names = sorted(kinds)
        loss = np.array([capacity - sum(f) for f in names])
        of = np.repeat(np.arange(len(names)), np.minimum([kinds[f] for f in names], PART))
        # Half of them by lot from those with waste, half from all.
        lossy = of[loss[of] > 0]
        take = rng.permutation(np.concatenate([rng.permutation(lossy)[: PART // 2], rng.permutation(of)[:PART]]))
        part: Counter = Counter()
        for i in take.tolist():
            if part.total() < PART and part[names[i]] < kinds[names[i]]:
                part[names[i]] += 1
        counts = [0] * (capacity + 1)
        for f, n in part.items():
            for s in f:
                counts[s] += n
        found = search(counts, capacity, part.total() + 1, PART_NODES)
        idle += 1
        if found is None:
            continue
        packed = Counter()
        for f, n in found:
            packed[f] += n
        worth = [(-x.total(), sum(n * (capacity - sum(f)) ** 2 for f, n in x.items())) for x in (part, packed)]
        if worth[1] > worth[0]:
            idle = 0 if worth[1][0] > worth[0][0] else idle
            kinds = kinds - part + packed
    return sorted(kinds.items(), reverse=True)


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of sequences and how often each occurs; counts[n] pieces have length n, 1 <= n <= capacity.  nodes=None: the fewest sequences, whatever it takes."""
    counts = np.asarray(counts, np.int64)
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    limit = sum(n for _, n in best)
    while limit > bound and (found := search(counts.tolist(), capacity, limit, nodes)):
        best, limit = found, sum(n for _, n in found)
    if nodes is not None:
        best = _improved(best, capacity, bound)
    assert sum(n * sum(f) for f, n in best) == int((counts * np.arange(capacity + 1)).sum())
    return best


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut; _part and _rank: the task, and the place among its pieces of that length."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bpe_encoder(path, end_id), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in by_bytes(batches, most=BPE_BYTES):
            ids, bounds = encoder.encode(b.column(1))
            ids = ids.astype("<u4")
            row, piece, start, length, crc, rank, raw = [], [], [], [], [], [], []
            for i, (a, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                at, n = a, min(e - a, (e - a - 1) % capacity + 1)
                while at < e:
                    row.append(i)
                    piece.append(0 if at == a else piece[-1] + 1)
                    start.append(at - a)
                    length.append(n)
                    crc.append(ids_crc32(ids[at : at + n]))
                    rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        raw.append(ids[at : at + n].tobytes())
                    at, n = at + n, capacity
            columns = {id_col: b.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "_part": pa.array([part] * len(row), pa.int64()), "_rank": pa.array(rank, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _part long, _rank long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Placement:
    """Where the pieces of each length go, by their rank: the sequences number at most a few thousand kinds."""

    def __init__(self, solution: list[tuple[tuple[int, ...], int]]):
        base = 0
        by: dict[int, list[tuple[int, list[int], int]]] = {}
        for filling, n in solution:
            offsets: dict[int, list[int]] = {}
            at = 0
            for s in filling:
                offsets.setdefault(s, []).append(at)
                at += s
            for s, o in offsets.items():
                by.setdefault(s, []).append((base, o, n))
            base += n
        self.runs = {s: (np.cumsum([0, *(n * len(o) for _, o, n in runs)]), runs) for s, runs in by.items()}

    def __call__(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, runs = self.runs[length]
        k = np.searchsorted(ends, rank, "right") - 1
        base, copies = np.array([r[0] for r in runs])[k], np.array([len(r[1]) for r in runs])[k]
        within = rank - ends[k]
        first = np.cumsum([0, *(len(r[1]) for r in runs)])[k]
        offset = np.array([x for r in runs for x in r[1]])[first + within % copies]
        return base + within // copies, offset


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian unsigned 32-bit) on demand.

    A null text is empty: its one piece is the end id.  Repeated rows and ids are
    packed as often as they come.  An empty table gives an empty result.  Columns
    other than the two named are not read.
    """
    pieces = write_scratch(pieces_of(docs, path, id_col, text_col, capacity, end_id, with_ids), "pack-pieces")
    by_task = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    place = Placement(pack_histogram(counts, capacity))
    before = by_task.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                sequence[at], offset[at] = place(int(n), rank[at])
            names = [x for x in b.schema.names if x != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    keep = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*keep).schema)
    return ranked.select(*keep, "_rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")
