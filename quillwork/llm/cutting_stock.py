"""Packing of tokenised documents without padding, as a cutting-stock problem solved by column generation.

Documents longer than a sequence give whole sequences and a rest.  How many pieces have each
length is all that decides a packing, at most `capacity` numbers however many documents
there are.  A pattern is a set of lengths that fit a sequence.  The linear program asks
how often to use each pattern so that all pieces are packed into the fewest sequences; its
columns are generated as they are needed: a knapsack, by dynamic programming over the
capacity, finds the patterns whose pieces are worth more than a sequence at the present
prices, and the simplex method takes them into the basis.  It starts from a basis of best-fit
patterns, each repeated until one of its lengths is used up, and ends at the optimum or when
a bound from the prices shows that it is as near as `gap` sequences.

Repetitions are rounded down.  Patterns with padding, and pieces that rounding leaves, are
packed by best fit where that fills a sequence; what then remains is laid end to end and
cut at the sequences' ends, the last one into powers of two.  So nothing is padded, and
few documents are cut.  Spark gives every piece its place by its rank among the
pieces of its length, counted by task and summed by a window over tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.llm._common import by_bytes, write_scratch
from quillwork.llm.bpe import BPE_BYTES, bpe_encoder, forget_encoders, ids_crc32
from quillwork.llm.packing import Placement, best_fit

CAPACITY, END_ID = 2048, 1
#: The program ends when it is this near its bound (in sequences; under one, no packing has fewer), or after so many exchanges of a column: its patterns are valid at any time.
GAP, PIVOTS = 0.25, 600
#: Columns that one knapsack may bring; the basis is inverted anew after so many exchanges.
COLUMNS, ANEW = 32, 400
#: Pieces left for cutting that are sent to all tasks; 100 bytes each.
SENT = 100_000
_EPS = 1e-9


def priced_patterns(prices: np.ndarray, capacity: int, most: int = COLUMNS) -> list[tuple[float, list[int]]]:
    """The knapsack: patterns (lengths, largest first) of the highest worth, best first; prices[n] is that of length n, 0 for lengths that no piece has.

    One pattern at most for each length that it must hold; only those worth more than a sequence.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    value = np.where(prices > 0, prices, -np.inf)
    for c in range(1, capacity + 1):
        with_piece = best[c - 1 :: -1][:c] + value[1 : c + 1]
        k = int(with_piece.argmax())
        if with_piece[k] > best[c - 1]:
            best[c], last[c] = with_piece[k], k + 1
        else:
            best[c] = best[c - 1]
    worth = best[::-1] + value  # of a piece and the best that fits beside it
    out, seen = [], set()
    for n in np.argsort(-worth, kind="stable")[: 4 * most].tolist():
        if worth[n] <= 1 + _EPS or len(out) == most:
            break
        pattern, c = [n], capacity - n
        while c:
            if last[c]:
                pattern.append(int(last[c]))
            c -= max(1, int(last[c]))
        pattern.sort(reverse=True)
        if tuple(pattern) not in seen:
            seen.add(tuple(pattern))
            out.append((float(worth[n]), pattern))
    return out


def first_basis(lengths: list[int], counts: np.ndarray, capacity: int) -> list[list[int]]:
    """A pattern for each length, so that each is the last to hold a length not used up before: a triangular basis.

    lengths ascend.  Around the largest length at hand stands the largest that fits, and again, until nothing fits.
    """
    left = {n: float(c) for n, c in zip(lengths, counts, strict=True)}
    at_hand = sorted(lengths)
    out = []
    while at_hand:
        pattern, space = [], capacity
        for n in reversed(at_hand):
            pattern += [n] * (space // n)
            space %= n
            if not space:
                break
        times = Counter(pattern)
        x = min(left[n] / k for n, k in times.items())
        used_up = [n for n, k in times.items() if left[n] - x * k <= _EPS * max(1.0, left[n])]
        for n, k in times.items():
            left[n] -= x * k
        out.append(pattern)
        # Of lengths used up together, all but one get a pattern of their own, not used.
        out += [[n] * (capacity // n) for n in used_up[1:]]
        at_hand = [n for n in at_hand if n not in used_up]
    return out


def solve(counts: np.ndarray, capacity: int, gap: float = GAP, pivots: int = PIVOTS) -> tuple[list[tuple[tuple[int, ...], float]], float, float]:
    """Patterns and how often each is used, in fractions; the number of sequences; and a lower bound of it."""
    lengths = np.flatnonzero(counts).tolist()
    row = {n: i for i, n in enumerate(lengths)}
    need = counts[lengths].astype(float)
    volume = float(need @ lengths) / capacity

    def column(pattern: list[int]) -> np.ndarray:
        a = np.zeros(len(lengths))
        for n in pattern:
            a[row[n]] += 1
        return a

    patterns = first_basis(lengths, need, capacity)
    basis = np.stack([column(p) for p in patterns], axis=1)
    inverse, since, bound = np.linalg.inv(basis), 0, volume
    x, y = inverse @ need, inverse.sum(axis=0)
    done = 0
    while done < pivots:
        prices = np.zeros(capacity + 1)
        prices[lengths] = y
        found = priced_patterns(prices, capacity)
        used = float(x.sum())
        # Prices that are scaled so that no pattern is worth more than a sequence bound the program from below.
        bound = max(bound, float(need @ np.maximum(y, 0)) / max(1.0, found[0][0]) if found else used)
        if not found or used - bound <= gap:
            break
        before = done
        for _, pattern in found:
            a = column(pattern)
            worth = float(y @ a)
            if worth <= 1 + _EPS:
                continue
            d = inverse @ a
            able = np.flatnonzero(d > 1e-7)
            if not len(able):
                continue
            ratio = np.maximum(x[able], 0) / d[able]
            least = ratio.min()
            near = able[ratio <= least + _EPS * (1 + least)]
            r = int(near[np.argmax(d[near])])
            step = max(0.0, x[r]) / d[r]
            y += (1 - worth) / d[r] * inverse[r]
            x -= step * d
            x[r] = step
            pivot = inverse[r] / d[r]
            some = np.flatnonzero(np.abs(d) > 1e-13)
            inverse[some] -= d[some, None] * pivot
            inverse[r] = pivot
            basis[:, r], patterns[r] = a, pattern
            done, since = done + 1, since + 1
            if since >= ANEW:
                inverse, since = np.linalg.inv(basis), 0
                x, y = inverse @ need, inverse.sum(axis=0)
        if done == before:
            break
    return [(tuple(p), float(n)) for p, n in zip(patterns, x, strict=True)], float(x.sum()), bound


def _is_full(total: int, capacity: int) -> bool:
    return total == capacity or total & (total - 1) == 0


def whole_patterns(counts: np.ndarray, capacity: int = CAPACITY, gap: float = GAP, pivots: int = PIVOTS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns without padding and how often each is used; pieces that they leave are for cutting.  counts[n] pieces have length n."""
    left = np.asarray(counts, np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        use = Counter(pattern)
        times = min([times, *(int(left[n]) // k for n, k in use.items())])
        if times > 0 and _is_full(sum(pattern), capacity):
            for n, k in use.items():
                left[n] -= times * k
            out.append((pattern, times))

    take((capacity,), int(left[capacity]))
    if left.any():
        for pattern, x in sorted(solve(left, capacity, gap, pivots)[0]):
            take(pattern, int(x + 1e-6))
    for pattern, times in best_fit(left.copy(), capacity):
        take(pattern, times)
    return out


class Cutting:
    """Places of pieces that no pattern takes: laid end to end by length and rank, and cut at sequences' ends; the last sequence at powers of two."""

    def __init__(self, left: np.ndarray, capacity: int, first_sequence: int):
        size = np.arange(capacity + 1)
        self.base = np.cumsum(left * size) - left * size
        total = int((left * size).sum())
        self.capacity, self.full, self.first = capacity, total // capacity, first_sequence
        rest = total % capacity
        tail = [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1]
        self.tail = np.cumsum([0, *tail])

    def _sequence(self, at: np.ndarray) -> np.ndarray:
        whole = self.full * self.capacity
        return np.where(at < whole, at // self.capacity, self.full + np.searchsorted(self.tail, at - whole, "right") - 1)

    def _start(self, sequence: np.ndarray) -> np.ndarray:
        beyond = np.clip(sequence - self.full, 0, len(self.tail) - 1)
        return np.where(sequence <= self.full, sequence * self.capacity, self.full * self.capacity + self.tail[beyond])

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the rank-th piece (from 0) left of each length: the row of each part, where it starts in the piece, its length, sequence and offset."""
        a = self.base[length] + rank * length
        first, last = self._sequence(a), self._sequence(a + length - 1)
        many = last - first + 1
        row = np.repeat(np.arange(len(length)), many)
        sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        begin, end = self._start(sequence), self._start(sequence + 1)
        lo, hi = np.maximum(a[row], begin), np.minimum(a[row] + length[row], end)
        return row, lo - a[row], hi - lo, sequence + self.first, lo - begin


def pieces_of(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenise and cut what is longer than a sequence, the rest last.  _part, _n: the task and the piece's place in it; _rank: its place among the task's pieces of its length; _ids: two bytes an id if that is enough, else four."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bpe_encoder(path, end_id), TaskContext.get().partitionId()
        width = "<u2" if encoder.narrow else "<u4"
        seen, before = np.zeros(capacity + 1, np.int64), 0
        for b in by_bytes(batches, most=BPE_BYTES):
            ids, bounds = encoder.encode(b.column(1))
            size = np.diff(bounds)
            many = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), many)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            length = np.minimum(size[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            run_of = np.searchsorted(length[order], length[order])
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - run_of + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            spans = [ids[x : x + n] for x, n in zip((bounds[row] + start).tolist(), length.tolist(), strict=True)]
            columns = {id_col: b.column(0).take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array([ids_crc32(s) for s in spans], pa.int64()), "doc_tokens": pa.array(size[row])}
            columns |= {"_part": pa.array(np.full(len(row), part)), "_n": pa.array(before + np.arange(len(row))), "_rank": pa.array(rank), "_ids": pa.array([s.astype(width).tobytes() for s in spans], pa.binary())}
            before += len(row)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, _part long, _n long, _rank long, _ids binary")


def _unpacked(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4").astype("<u4")


def pack_by_patterns(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, gap: float = GAP, pivots: int = PIVOTS) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit) on demand.

    Every sequence holds `capacity` tokens or a power of two of them; capacity is a power of two itself.
    A null text is empty: its one piece is the end id.  Repeated rows and ids are packed as often as
    they come; a piece belongs to a row of its id.  An empty table gives an empty result.  Columns
    other than the two named are not read.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    pieces = write_scratch(pieces_of(docs, path, id_col, text_col, capacity, end_id), "stock-pieces")
    by_task = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_many"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("_many").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    solution = whole_patterns(counts, capacity, gap, pivots)
    place, left = Placement(solution), counts.copy()
    for pattern, times in solution:
        for n in pattern:
            left[n] -= times
    cut = Cutting(left, capacity, sum(n for _, n in solution))
    whole = counts - left

    before = by_task.withColumn("_before", F.coalesce(F.sum("_many").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_many")
    taken = docs.sparkSession.createDataFrame([(n, int(whole[n])) for n in range(1, capacity + 1)], "length long, _whole long")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["_ids"] * with_ids]
    ranked = pieces.select(*names, "_part", "_n", "_rank").join(before, ["_part", "length"]).join(F.broadcast(taken), "length").withColumn("_rank", F.col("_rank") + F.col("_before"))
    kind = docs.schema[id_col].dataType.simpleString()
    result = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def in_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                sequence[at], offset[at] = place(int(n), rank[at])
            ids = [pa.array([_unpacked(x, n).tobytes() for x, n in zip(b.column("_ids").to_pylist(), length.tolist(), strict=True)], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in columns[:5]), pa.array(sequence), pa.array(offset), *ids], columns)

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in batches:
            length = b.column("length").to_numpy()
            row, start, n, sequence, offset = cut(length, b.column("_rank").to_numpy() - b.column("_whole").to_numpy())
            raw = [_unpacked(x, k) for x, k in zip(b.column("_ids").to_pylist(), length.tolist(), strict=True)]
            spans = [raw[i][a : a + k] for i, a, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
            of = pa.array(row)
            ids = [pa.array([s.tobytes() for s in spans], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(of), pa.array(b.column("start").to_numpy()[row] + start), pa.array(n), pa.array([ids_crc32(s) for s in spans], pa.int64()), b.column("doc_tokens").take(of), pa.array(sequence), pa.array(offset), *ids], columns)

    rest = ranked.filter("_rank >= _whole")
    if not with_ids:
        # How many these are is known: as a rule a few thousand, so that ids are read as they lie; many are joined by a shuffle.
        few = F.broadcast(rest) if int(left.sum()) <= SENT else rest
        rest = few.join(pieces.select("_part", "_n", "_ids"), ["_part", "_n"])
    placed = ranked.filter("_rank < _whole").select(*names, "_rank").mapInArrow(in_patterns, result)
    return placed.unionByName(rest.select(id_col, "start", "length", "doc_tokens", "_rank", "_whole", "_ids").mapInArrow(in_parts, result))
