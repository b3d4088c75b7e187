"""Exact top-k search by inner product with a KD-tree in each shard.

Candidates are dealt into shards by where they lie: median splits along the widest
side, fitted on a bounded sample, make cells; cells that hold more rows than a shard are split
again in the same way, each on a sample of its own, in its own task; and what even
then has very many rows (equal ones, perhaps) is dealt out by a hash.  A shard is indexed once: median splits again, a tight
box around each node.  A node's best possible score against a query follows from its
box.  A query is searched best first, and nodes whose bound is under the kth score so
far are skipped.  Every query first meets the shard where it lies itself; with the kth
score found there it is held against the other shards' outermost boxes, in blocks, and
travels to those shards alone that may still have better ones.  Queries stream past a
shard: a task holds one shard and one batch of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.llm._common import drop_scratch, sampled, write_scratch

#: Rows of a shard, queries that a copy of a shard serves, rows of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 65_536, 256
#: The sample that cells are fitted on (rows and numbers), the cells at most, in which a cell may be split again into as many, and sampled rows for each of these.
SAMPLE_ROWS, SAMPLE_NUMBERS, CELLS, CELL_SAMPLE = 32_768, 1 << 24, 512, 64
#: Queries and boxes that are held against each other at once.
PRUNE_QUERIES, PRUNE_BOXES = 4096, 256
SCALE = 256
KEY = ["dim", "cell", "part", "block"]


class KdTree:
    """Rows in leaf order; nodes in preorder with tight boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int]] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = points[self.order[a:b]]
            node = len(self.span)
            self.lo.append(rows.min(0))
            self.hi.append(rows.max(0))
            self.span.append((a, b))
            self.kids.append((-1, -1))
            if parent >= 0:
                kids = list(self.kids[parent])
                kids[side] = node
                self.kids[parent] = tuple(kids)
            if b - a > leaf:
                axis = int((self.hi[node] - self.lo[node]).argmax())
                half = (b - a) // 2
                # Ties may lie on both sides of the median: halves stay equal even if all rows are.
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], half)]
                todo += [(a + half, b, node, 1), (a, a + half, node, 0)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No point of node n scores more against query q than bounds[q, n]."""
        return bounds_of(queries, np.stack(self.lo), np.stack(self.hi))


def bounds_of(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T


def search(tree: KdTree, points: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Best k ids and scores, ties to smaller ids, of those that reach `floor`; points and ids in leaf order."""
    best_i, best_s, kth = np.zeros(0, np.int64), np.zeros(0, points.dtype), floor
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < kth:
            break
        left, right = tree.kids[node]
        if left >= 0:
            for n in (left, right):
                if bounds[n] >= kth:
                    heapq.heappush(heap, (-bounds[n], n))
            continue
        a, b = tree.span[node]
        s = points[a:b] @ query
        hit = np.flatnonzero((s >= kth) & (ids[a:b] != own))
        if not len(hit):
            continue
        best_i, best_s = np.concatenate([best_i, ids[a:b][hit]]), np.concatenate([best_s, s[hit]])
        top = np.lexsort((best_i, -best_s))[:k]
        best_i, best_s = best_i[top], best_s[top]
        if len(top) == k:
            kth = max(kth, best_s[-1])
    return best_i, best_s


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of rows of one width, whole numbers that doubles hold exactly."""
    return np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(len(vectors), -1)


def exact_kind(most: float, width: int) -> type:
    """In which numbers sums of so many products of at most this size are exact: doubles, 64-bit integers, or Python's."""
    sums = float(most) * max(1, width)
    return np.float64 if sums < 2**53 else np.int64 if sums < 2**62 else object


def _as_kind(x: np.ndarray, kind: type) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x) if kind is object and x.size else x.astype(kind)


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"))


Splits = tuple[np.ndarray, np.ndarray]


def median_splits(points: np.ndarray, levels: int) -> Splits:
    """Axes and places of median splits along the widest side, as a heap."""
    axes, places = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, of = todo.pop()
        if node >= len(axes) or not len(of):
            continue
        axis = int(np.ptp(points[of], axis=0).argmax())
        axes[node], places[node] = axis, np.median(points[of, axis])
        left = points[of, axis] <= places[node]
        todo += [(2 * node + 1, of[left]), (2 * node + 2, of[~left])]
    return axes, places


def _leaf(points: np.ndarray, splits: Splits) -> np.ndarray:
    """The leaf, from 0, that each point comes to."""
    axes, places = splits
    node = np.zeros(len(points), np.int64)
    while len(node) and node[0] < len(axes):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > places[node])
    return node - len(axes)


def fit_cells(cand: DataFrame, rows: int, shard_rows: int, most: int = CELLS) -> dict[int, Splits]:
    """Per width: the splits into cells; widths of fewer rows than a shard have none."""
    if rows <= shard_rows:
        return {}
    widest = max(1, cand.agg(F.max("dim")).first()[0])
    found = sampled(cand, min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // widest)), "id", "dim").toPandas()
    out = {}
    for dim, part in found.groupby("dim"):
        levels = int(np.log2(max(1, min(most, rows * len(part) / len(found) / shard_rows))))
        if levels and dim:
            out[int(dim)] = median_splits(np.stack(part["v"].to_numpy()).astype(np.float64), levels)
    return out


def fit_subcells(placed: DataFrame, sizes: dict[tuple[int, int], int], shard_rows: int, most: int = CELLS) -> dict[tuple[int, int], Splits]:
    """Per width and cell: the splits of cells that hold more than a shard.  Each is fitted in a task, on a sample of at most CELL_SAMPLE rows, or so, for each part; what comes here is `most` numbers for each cell."""
    large = {k: min(most, 1 << (-(-n // shard_rows) - 1).bit_length()) for k, n in sizes.items() if n > shard_rows and k[0]}
    if not large:
        return {}
    spark = placed.sparkSession
    shares = spark.createDataFrame([(*k, parts.bit_length() - 1, min(1 << 20, -(-CELL_SAMPLE * parts * (1 << 20) // sizes[k]))) for k, parts in large.items()], "dim int, cell int, levels int, share long")
    some = placed.join(F.broadcast(shares), ["dim", "cell"]).filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < F.col("share"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        axes, places = median_splits(np.stack(part["v"].to_numpy()).astype(np.float64), int(part["levels"].iloc[0]))
        return pd.DataFrame({"dim": part["dim"].iloc[:1], "cell": part["cell"].iloc[:1], "axes": [axes.tolist()], "places": [places.tolist()]})

    found = some.groupBy("dim", "cell").applyInPandas(fit, "dim int, cell int, axes array<int>, places array<double>").collect()
    return {(r["dim"], r["cell"]): (np.array(r["axes"], np.int64), np.array(r["places"])) for r in found}


def with_cell(rows: DataFrame, cells: dict[int, Splits], again: dict[tuple[int, int], Splits] | None = None) -> DataFrame:
    """rows (id, v, dim) with the cell that each vector lies in; cells that were split again are numbered apart."""
    if not cells and not again:
        return rows.withColumn("cell", F.lit(0))

    @F.pandas_udf("int")
    def cell_of(v: pd.Series, dims: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int64)
        for dim in np.unique(dims.to_numpy()).tolist():
            at = np.flatnonzero(dims.to_numpy() == dim)
            if not dim:
                continue
            points = np.stack(v.iloc[at].to_numpy()).astype(np.float64)
            cell = _leaf(points, cells[dim]) if dim in cells else np.zeros(len(at), np.int64)
            sub = np.zeros(len(at), np.int64)
            for c in np.unique(cell).tolist() if again else ():
                if (dim, c) in again:
                    here = cell == c
                    sub[here] = _leaf(points[here], again[dim, c])
            out[at] = cell * CELLS + sub if again else cell
        return pd.Series(out)

    return rows.withColumn("cell", cell_of("v", "dim"))


def _build(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    points = quantised(table.column("v").chunk(0))
    tree = KdTree(points)
    ids = table.column("id").to_numpy()[tree.order]
    nodes = np.concatenate([np.array(tree.span), np.array(tree.kids)], axis=1).astype("<i8")
    boxes = np.stack([np.stack(tree.lo), np.stack(tree.hi)])
    names = dict(zip(KEY, ([k.as_py()] for k in key)))
    names = {n: pa.array(v, pa.int32()) for n, v in names.items()}
    return pa.table(names | {"root": [np.ascontiguousarray(boxes[:, 0]).tobytes()], "ids": [ids.astype("<i8").tobytes()], "points": [points[tree.order].tobytes()], "nodes": [nodes.tobytes()], "boxes": [boxes.tobytes()]})


def _loaded(row: dict) -> tuple[KdTree, np.ndarray, np.ndarray]:
    """The tree of an index row, its points and their ids."""
    nodes = np.frombuffer(row["nodes"], "<i8").reshape(-1, 4)
    tree = KdTree.__new__(KdTree)
    tree.span, tree.kids = [(a, b) for a, b, _, _ in nodes.tolist()], [(c, d) for _, _, c, d in nodes.tolist()]
    tree.lo, tree.hi = np.frombuffer(row["boxes"], "<f8").reshape(2, len(nodes), -1)
    ids = np.frombuffer(row["ids"], "<i8")
    return tree, np.frombuffer(row["points"], "<f8").reshape(len(ids), -1), ids


def _asked(tree: KdTree, points: np.ndarray, ids: np.ndarray, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Results of a batch of queries (id, v, floor) in one shard."""
    q = quantised(queries.column("v"))
    kind = exact_kind(float(np.abs(q).max(initial=0)) * float(max(np.abs(tree.lo[0]).max(initial=0), np.abs(tree.hi[0]).max(initial=0))), q.shape[1])
    if kind is not np.float64:
        q, points = _as_kind(q, kind), _as_kind(points, kind)
        same = KdTree.__new__(KdTree)
        same.span, same.kids, same.lo, same.hi = tree.span, tree.kids, _as_kind(np.asarray(tree.lo), kind), _as_kind(np.asarray(tree.hi), kind)
        tree = same
    bounds = tree.bounds(q)
    found_q, found_i, found_s = [], [], []
    for n, (own, floor) in enumerate(zip(queries.column("id").to_pylist(), queries.column("floor").to_pylist(), strict=True)):
        i, s = search(tree, points, ids, q[n], own, bounds[n], k, -np.inf if floor is None else floor)
        found_q += [own] * len(i)
        found_i += i.tolist()
        # Scores beyond a long show as the last that it holds; they were compared as they are.
        found_s += [max(-(2**63), min(2**63 - 1, int(x))) for x in s]
    return pa.RecordBatch.from_arrays([pa.array(found_q, pa.int64()), pa.array(found_i, pa.int64()), pa.array(found_s, pa.int64())], ["query_id", "vec_id", "score"])


def meet(index: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Results of the queries (KEY, id, v, floor) in their shards: a shard comes first, its queries follow it."""
    copies = index.drop("root").join(rows.select(*KEY).distinct(), KEY[:3])
    shards = copies.select(*KEY, F.lit(0).alias("turn"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(rows.schema["v"].dataType).alias("v"), F.lit(None).cast("long").alias("floor"), "ids", "points", "nodes", "boxes")
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "points", "nodes", "boxes")]
    both = shards.unionByName(rows.select(*KEY, F.lit(1).alias("turn"), "id", "v", "floor", *none))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            turn = b.column("turn").to_numpy()
            cuts = np.flatnonzero((turn == 0) | (np.diff(turn, prepend=1) != 0)).tolist()
            for a, e in zip([0, *cuts] if 0 not in cuts else cuts, [*(cuts if 0 not in cuts else cuts[1:]), len(turn)], strict=True):
                if turn[a] == 0:
                    shard = _loaded({c: b.column(c)[a].as_py() for c in ("nodes", "boxes", "ids", "points")})
                else:
                    yield _asked(*shard, b.slice(a, e - a), k)

    ordered = both.repartition(n, *KEY).sortWithinPartitions(*KEY, "turn")
    return ordered.mapInArrow(find, "query_id long, vec_id long, score long")


def may_hold_better(asked: DataFrame, roots: DataFrame, shards: int, queries: int) -> DataFrame:
    """Queries (KEY, id, v, floor) paired with the shards whose outermost box allows a score of floor or more."""
    slots, blocks = max(1, -(-shards // PRUNE_BOXES)), max(1, -(-queries // PRUNE_QUERIES))
    group = ["dim", "slot", "batch"]
    boxes = roots.withColumn("slot", F.pmod(F.xxhash64("cell", "part"), F.lit(slots)).cast("int")).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = asked.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def prune(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            at, to = np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            box = np.frombuffer(b"".join(right.column("root").to_pylist()), "<f8").reshape(right.num_rows, 2, -1)
            q = quantised(left.column("v").chunk(0))
            # Bounds may be off by the rounding of doubles, where numbers are very large.
            slack = 1e-10 * (np.abs(q) @ np.abs(box).max(1).T)
            floor = np.array([-np.inf if x is None else x for x in left.column("floor").to_pylist()], np.float64)
            better = bounds_of(q, box[:, 0], box[:, 1]) + slack >= floor[:, None]
            own = np.stack([left.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("home_cell", "home_part")], axis=1)
            here = np.stack([right.column(c).to_numpy() for c in ("cell", "part")], axis=1)
            at, to = np.nonzero(better & ~(own[:, None] == here[None]).all(2))
        l, r = left.take(pa.array(at)), right.take(pa.array(to))
        return pa.table({"dim": l.column("dim"), "cell": r.column("cell"), "part": r.column("part"), "block": l.column("block"), "id": l.column("id"), "v": l.column("v"), "floor": l.column("floor")})

    kind = asked.schema["v"].dataType.simpleString()
    return met.groupBy(*group).cogroup(boxes.groupBy(*group)).applyInArrow(prune, f"dim int, cell int, part int, block int, id long, v {kind}, floor long")


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, most_cells: int = CELLS) -> DataFrame:
    """query_id, rank from 1, vec_id, score: for each query its k best candidates, ties to the smaller id, all if there are fewer.

    A score is the inner product of floor(256 x), exact whatever its size; one that a
    long cannot hold shows as the last number it holds.  A query's own id is no candidate of it.  Rows whose id or
    vector is null, or whose vector holds null or a non-finite number, take no part; vectors
    meet those of their own width only.  Repeated candidates appear as often as they come.  A query
    is one id: of rows that share it the smallest vector asks (shorter before longer where one begins the
    other).  Empty tables give an empty result.
    """
    cand, asked = usable(candidates, id_col, vector_col), usable(queries, id_col, vector_col)
    asked = asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    rows, n_asked = cand.count(), asked.count()
    cells = fit_cells(cand, rows, shard_rows, most_cells)
    placed = write_scratch(with_cell(cand, cells), "knn-rows", "snappy")
    # A row for each width and cell.
    sizes = {(r["dim"], r["cell"]): r["n"] for r in placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()} if rows > shard_rows else {}
    again = fit_subcells(placed, sizes, shard_rows, most_cells)
    if again:
        before, placed = placed, write_scratch(with_cell(placed.drop("cell"), cells, again), "knn-rows", "snappy")
        drop_scratch(before)
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    index = placed.join(parts, ["dim", "cell"]).withColumn("part", part).groupBy("dim", "cell", "part")
    index = write_scratch(index.applyInArrow(_build, "dim int, cell int, part int, root binary, ids binary, points binary, nodes binary, boxes binary"), "knn-index", "none")
    blocks = max(1, -(-n_asked // block_rows))
    asked = with_cell(asked, cells, again).join(parts, ["dim", "cell"], "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = write_scratch(asked.select("dim", F.when(F.col("parts") > 0, F.col("cell")).alias("home_cell"), part.alias("home_part"), "block", "id", "v"), "knn-asked", "snappy")
    home = asked.filter("home_cell IS NOT NULL").withColumnsRenamed({"home_cell": "cell", "home_part": "part"}).withColumn("floor", F.lit(None).cast("long"))
    home = home.join(index.select(*KEY[:3]), KEY[:3], "left_semi")  # a part may have got no candidate
    found = write_scratch(meet(index, home, k), "knn-first")
    shards = index.count()
    if shards > 1:
        kth = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
        # A score at a long's end may be another's stand-in: no floor.
        kth = kth.select("id", F.when((F.col("n") >= k) & (F.abs("floor") < 2**62), F.col("floor")).alias("floor"))
        rest = may_hold_better(asked.join(kth, "id", "left"), index.select("dim", "cell", "part", "root"), shards, n_asked)
        found = found.unionByName(meet(index, write_scratch(rest, "knn-pairs", "snappy"), k))
    drop_scratch(placed)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
