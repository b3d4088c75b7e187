"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

A file set is a folder with three tables.  `codebook` has one row: the code length of
each id (0: the id does not occur).  `ranges` says how many ids stand before each range,
ranges following each other by ascending document id.  A row of `blocks` is a block of
whole documents, in the same order within its range:
    range, block   where it stands
    before   ids of the range's documents before the block
    doc_ids, doc_sizes   its documents and their ids
    checkpoints   where, in bits, each CHECKPOINT-th id starts (little-endian unsigned 32-bit)
    payload       the codes, most significant bit first, filled up to whole 32-bit words
A block is decoded with the codebook alone, from any of its checkpoints.

Documents are tokenised where they lie, and each task counts its ids as it goes; only ids,
two bytes each, are sorted and shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._common import by_bytes, drop_scratch, write_scratch
from quillwork.llm.bpe import BPE_BYTES, bpe_encoder, forget_encoders, ids_crc32

#: A block is closed at this many ids; a longer document is a block of its own.
BLOCK_IDS, CHECKPOINT, MAX_BITS = 32_768, 256, 18
BLOCKS = "range int, block int, before long, n_tokens long, doc_ids array<{kind}>, doc_sizes array<long>, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Package-merge: the optimal code lengths of at most max_bits; ids that never occur get 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids cannot have codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n, row, levels = len(order), weight, []
    for _ in range(max_bits - 1):
        half = len(row) // 2 * 2
        merged = np.concatenate([weight, row[0:half:2] + row[1:half:2]])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        row = merged[rank]
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    length[:take] += 1
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.uint64)
    if len(order):
        # Each code is the sum of the intervals before it, seen at the longest length.
        longest = size.max()
        at = np.cumsum(np.uint64(1) << (longest - size)) - (np.uint64(1) << (longest - size))
        codes[order] = at >> (longest - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """By the next bits: id and code length, as id * 64 + length; and how many bits that is."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = int(lengths.max(initial=1))
    span = np.left_shift(1, bits - lengths[order].astype(np.int64))
    table = np.ones(1 << bits, np.int32 if len(lengths) < 1 << 25 else np.int64)
    table[: span.sum()] = np.repeat(order * 64 + lengths[order], span)
    return table, bits


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payload words (big-endian) and checkpoints."""
    if not len(ids):
        return np.zeros(1, ">u4"), np.zeros(0, "<u4")
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    word = at >> 5
    # Bits of codes that start in one word, and of what hangs over into the next.
    value = codes[ids] << (64 - (at & 31) - size).view(np.uint64)
    head = np.flatnonzero(np.diff(word, prepend=-1))
    value, word = np.bitwise_or.reduceat(value, head), word[head]
    out = np.zeros((int(end[-1]) + 31 >> 5) + 1, np.uint64)
    out[word] = value >> np.uint64(32)
    out[word + 1] |= value & np.uint64(0xFFFFFFFF)
    return out.astype(">u4"), at[::CHECKPOINT].astype("<u4")


def decode_blocks(payloads: list[bytes], checkpoints: list[bytes], sizes: list[int], table: tuple[np.ndarray, int]) -> np.ndarray:
    """Ids of the blocks, one after the other: all runs between checkpoints advance together, one table lookup an id."""
    known, bits = table
    words = np.frombuffer(b"".join(payloads) + bytes(8), ">u4").astype(np.uint64)
    words = (words[:-1] << np.uint64(32)) | words[1:]  # each word with the one after it
    first = np.cumsum([0, *(len(p) * 8 for p in payloads)])[:-1]
    at = np.concatenate([np.frombuffer(c, "<u4").astype(np.int64) + f for c, f in zip(checkpoints, first, strict=True)] or [np.zeros(0, np.int64)])
    todo = np.concatenate([np.minimum(CHECKPOINT, n - np.arange(0, n, CHECKPOINT)) for n in sizes] or [np.zeros(0, np.int64)])
    # The longest runs stand first, so that those not done yet are always the first so many.
    order = np.argsort(-todo, kind="stable")
    at, long, start = at[order], todo[order], (np.cumsum(todo) - todo)[order]
    out = np.zeros(int(todo.sum()), np.uint32)
    live = len(long)
    shift = np.uint64(64 - bits)
    for k in range(int(long.max(initial=0))):
        while long[live - 1] <= k:
            live -= 1
        p = at[:live]
        found = known[(words[p >> 5] << (p & 31).view(np.uint64) >> shift).view(np.int64)]
        out[start[:live] + k] = found >> 6
        p += found & 63
    return out


def write_token_file(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, the end id after each, in ascending order of ids.

    A null text is empty: the end id alone.  Null ids come first; rows that share an
    id follow each other in the order of their texts' hashes.  An empty table gives an
    empty file set.  Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, numbered in its task; then one that holds how often the task met each id."""
        encoder, part = bpe_encoder(path, end_id), TaskContext.get().partitionId()
        total, n = np.zeros(0, np.int64), 0
        names = ["_id", "_hash", "_row", "size", "ids", "counts"]
        for b in by_bytes(batches, most=BPE_BYTES):
            ids, bounds = encoder.encode(b.column(1))
            total = _added(total, np.bincount(ids))
            ids = ids.astype("<u2" if encoder.narrow else "<u4")
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            row = (np.int64(part) << 33) + np.arange(n, n + b.num_rows)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(row), pa.array(np.diff(bounds), pa.int64()), raw, pa.nulls(b.num_rows, pa.binary())], names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    staged = write_scratch(texts.mapInArrow(tokenise, f"_id {kind}, _hash long, _row long, size long, ids binary, counts binary"), "token-ids")
    counts = _sum_counts(staged)
    lengths = code_lengths(counts, max(MAX_BITS, len(counts).bit_length()))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.mode("overwrite").parquet(f"{out}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        part, before, block, held = TaskContext.get().partitionId(), 0, 0, 0
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal before, block, held
            ids, size, name = np.concatenate(parts), np.concatenate(sizes), pa.concat_arrays(names)
            payload, checkpoints = encode_block(ids, lengths, codes)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), whole(name), whole(pa.array(size, pa.int64())), pa.array([checkpoints.tobytes()], pa.binary()), pa.array([payload.tobytes()], pa.binary())]
            before, block, held = before + len(ids), block + 1, 0
            for x in (names, sizes, parts):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["range", "block", "before", "n_tokens", "doc_ids", "doc_sizes", "checkpoints", "payload"])

        for b in by_bytes(batches, 2):
            size = b.column(1).to_numpy()
            raw = b"".join(b.column(2).to_pylist())
            bounds = np.append(0, np.cumsum(size))
            ids = np.frombuffer(raw, f"<u{len(raw) // int(bounds[-1])}")
            at = 0
            while at < b.num_rows:
                # As many documents as bring the block to its size, one at least.
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_IDS - held)))
                to = min(to, b.num_rows)
                names.append(b.column(0).slice(at, to - at))
                sizes.append(size[at:to])
                parts.append(ids[bounds[at] : bounds[to]])
                held += int(bounds[to] - bounds[at])
                at = to
                if held >= BLOCK_IDS:
                    yield close()
        if parts:
            yield close()

    order = [F.col("_id").asc_nulls_first(), F.col("_hash").asc_nulls_first(), F.col("_row").asc()]
    ranged = staged.filter("counts IS NULL").repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "size", "ids")
    ranged.mapInArrow(encode, BLOCKS.format(kind=kind)).write.mode("overwrite").option("compression", "none").parquet(f"{out}/blocks")
    drop_scratch(staged)
    # One row a range: as many as the shuffle has partitions, whatever the number of documents.
    sums = spark.read.parquet(f"{out}/blocks").groupBy("range").agg(F.sum("n_tokens").alias("n")).orderBy("range").collect()
    first = np.cumsum([0, *(r["n"] for r in sums)]).tolist()
    rows = [(r["range"], a) for r, a in zip(sums, first)]
    spark.createDataFrame(rows, "range int, first_token long").coalesce(1).write.mode("overwrite").parquet(f"{out}/ranges")


def _added(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    if len(more) > len(total):
        total, more = more.astype(np.int64), total
    total[: len(more)] += more
    return total


def _sum_counts(staged: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; at most one row for each id of the vocabulary reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total = _added(total, np.frombuffer(raw, "<i8"))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    found = staged.filter("counts IS NOT NULL").select("counts").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def read_token_file(spark: SparkSession, out: str, id_kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Decode a file set: id as doc_id, start, n_tokens, ids_crc32, and ids (little-endian unsigned 32-bit) on demand."""
    lengths = np.frombuffer(spark.read.parquet(f"{out}/codebook").first()["lengths"], np.uint8)
    ranges = {r["range"]: r["first_token"] for r in spark.read.parquet(f"{out}/ranges").collect()}  # a row a range

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        table = decode_table(lengths)
        for b in by_bytes(batches, 6):
            ids = decode_blocks(b.column("payload").to_pylist(), b.column("checkpoints").to_pylist(), b.column("n_tokens").to_pylist(), table).astype("<u4")
            size = b.column("doc_sizes").flatten().to_numpy()
            end = np.cumsum(size)
            # Where a document starts among all: its range's first id, the ids before its block, and its place in the block.
            n = b.column("n_tokens").to_numpy()
            first = np.array([ranges[r] for r in b.column("range").to_pylist()], np.int64) + b.column("before").to_numpy()
            shift = np.repeat(first - (np.cumsum(n) - n), pc.list_value_length(b.column("doc_ids")).to_numpy())
            spans = list(zip((end - size).tolist(), end.tolist(), strict=True))
            columns = [b.column("doc_ids").flatten(), pa.array(end - size + shift, pa.int64()), pa.array(size, pa.int64()), pa.array([ids_crc32(ids[a:e]) for a, e in spans], pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([ids[a:e].tobytes() for a, e in spans], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    blocks = spark.read.schema(BLOCKS.format(kind=id_kind)).parquet(f"{out}/blocks")
    return blocks.select("range", "before", "n_tokens", "doc_ids", "doc_sizes", "checkpoints", "payload").mapInArrow(decode, f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
