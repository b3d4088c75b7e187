"""Byte-level BPE encoding of whole texts with the tokenizers library, remembering chunks that come again.

The vocabulary's own splitting pattern always ends a token before a blank that a
non-blank follows, and what it makes of the rest does not depend on what came
before.  So a text is the chain of its chunks (a blank and what follows it), each
chunk is encoded once by the library and its ids are looked up from then on.
Chunks are cut, hashed (128 bits) and looked up many at a time in the bytes of the
column; only those met for the first time become strings.  The memory is bounded: it starts
anew when it is full.  Texts that hold an added token of the vocabulary, such as the mark
of a text's end, go to the library as they are.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are best encoded together, and those whose chunks are hashed together.
BPE_BYTES, HASH_BYTES = 1 << 21, 1 << 17
_encoders: dict[tuple, BpeEncoder] = {}

_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: White space beyond ASCII, as UTF-8.
_WIDE = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]
_LEAD = np.zeros(256, bool)
_LEAD[[w[0] for w in _WIDE]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_TAIL = b",.;:!?"
_IS_TAIL = np.zeros(256, bool)
_IS_TAIL[list(_TAIL)] = True


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Grown:
    """An array that more is added to; room doubles, so that adding costs what is added."""

    def __init__(self, start: np.ndarray):
        self.room, self.n = start.copy(), len(start)

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(self.n + 2 * len(more), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class _ChunkHash:
    """Two 64-bit hashes of byte ranges: sums of random numbers of the bytes, each times a power of its place."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20)
        self.of_byte = rng.integers(0, 1 << 64, (2, 256), np.uint64)
        self.base = rng.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 64, (2, 2), np.uint64)
        self.powers = np.ones((2, 1), np.uint64)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the ranges of data, ascending and apart from each other; first ones are told from equal others."""
        size = end - start
        longest = int(size.max(initial=0))
        if longest > self.powers.shape[1]:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([np.ones((2, 1), np.uint64), np.repeat(self.base[:, None], longest, 1)], axis=1), axis=1)
        out = np.zeros((2, len(start)), np.uint64)
        some = np.flatnonzero(size)
        step = [*np.searchsorted(end[some], np.arange(0, int(end.max(initial=0)), HASH_BYTES)), len(some)]
        for a, b in zip(step[:-1], step[1:], strict=True):
            at = some[a:b]
            if not len(at):
                continue
            n = size[at]
            first_byte = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(first_byte, n)
            here = data[np.repeat(start[at], n) + place]
            for k in (0, 1):
                out[k, at] = np.add.reduceat(self.of_byte[k][here] * self.powers[k][place], first_byte)
        out += size.astype(np.uint64) * self.base[::-1, None] + np.where(first, self.salt[:, :1], self.salt[:, 1:])
        return _mix(out[0]), _mix(out[1])


class _ChunkTable:
    """Numbers of chunks by their two hashes: open addressing, at most half full."""

    def __init__(self, room: int):
        bits = max(4, (2 * room).bit_length())
        self.shift, self.mask, self.used = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.number = np.zeros((2, 1 << bits), np.uint64), np.full(1 << bits, -1, np.int32)

    def get(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The numbers, -1 where there is none."""
        out, slot, todo = np.full(len(one), -1, np.int64), (one >> self.shift).astype(np.int64), np.arange(len(one))
        while len(todo):
            found = self.number[slot]
            same = (self.keys[0, slot] == one[todo]) & (self.keys[1, slot] == two[todo])
            out[todo[same]] = found[same]
            on = (found >= 0) & ~same
            todo, slot = todo[on], slot[on] + 1 & self.mask
        return np.where(out < 0, -1, out)

    def put(self, one: np.ndarray, two: np.ndarray, numbers: np.ndarray) -> None:
        """Keys that are not there yet and differ from each other."""
        if 2 * (self.used + len(one)) > len(self.number):
            there = np.flatnonzero(self.number >= 0)
            (a, b), n = self.keys[:, there], self.number[there]
            self.__init__(2 * (self.used + len(one)))
            self.put(a, b, n)
        self.used += len(one)
        slot, todo = (one >> self.shift).astype(np.int64), np.arange(len(one))
        while len(todo):
            at, winner = np.unique(np.where(self.number[slot] < 0, slot, -1), return_index=True)
            winner = winner[at >= 0]
            put = todo[winner]
            self.keys[0, slot[winner]], self.keys[1, slot[winner]], self.number[slot[winner]] = one[put], two[put], numbers[put]
            stay = np.ones(len(todo), bool)
            stay[winner] = False
            todo, slot = todo[stay], slot[stay] + 1 & self.mask


class BpeEncoder:
    def __init__(self, path: str, end_id: int | None, max_chunks: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True  # the byte alphabet's blank
        self.end_id, self.max_chunks = end_id, max_chunks
        #: Whether ids fit 16 bits.
        self.narrow = max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 and (end_id or 0) < 1 << 16
        self.hash = _ChunkHash()
        self._forget()

    def _forget(self) -> None:
        # Chunk 0 is the end of a document; those of the marks in _TAIL follow.
        ids = [[] if self.end_id is None else [self.end_id], *self._library([chr(c) for c in _TAIL])]
        self.table = _ChunkTable(self.max_chunks)
        self.flat = Grown(np.array(list(chain.from_iterable(ids)), np.uint32))
        self.bounds = Grown(np.cumsum([0, *map(len, ids)]))  # of the chunks in flat

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new chunks with these ids."""
        n = self.bounds.n - 1
        self.bounds.add(self.flat.n + np.cumsum(sizes))
        self.flat.add(ids)
        return np.arange(n, n + len(sizes))

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Numbers of chunks that the library encodes as they are."""
        got = self._library(texts)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return self._add(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes)

    def _learn_spaced(self, keys: list[str]) -> np.ndarray:
        """Of chunks without their blank; many in one call: where each holds one blank, its first sign, the ids that start with a blank are where chunks start."""
        out = np.zeros(len(keys), np.int64)
        lone = np.fromiter((k != "" and " " not in k and not k[0].isspace() for k in keys), bool, len(keys))
        out[~lone] = self._learn([" " + keys[i] for i in np.flatnonzero(~lone).tolist()])
        one = [keys[i] for i in np.flatnonzero(lone).tolist()]
        if one:
            got = self._library([" " + " ".join(one[i : i + 64]) for i in range(0, len(one), 64)])
            ids = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
            out[lone] = self._add(ids, np.diff(np.append(np.flatnonzero(self.blank_first[ids]), len(ids))))
        return out

    def _ids(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these chunks one after the other, and where each ends."""
        bounds = self.bounds.all
        start = bounds[chunks]
        size = bounds[chunks + 1] - start
        after = np.cumsum(size)
        return self.flat.all[np.arange(after[-1] if len(after) else 0) + np.repeat(start - (after - size), size)], after

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, the end id after each; and where each text starts, with the total last.  A null text is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        raw = b"".join(x.as_buffer() for x in texts.cast(pa.binary()) if x.is_valid) if texts.null_count else _bytes_of(texts)
        whole = {int(np.searchsorted(end, p, "right")) for a in self.added for p in _places(raw, a)}
        whole = sorted(i for i in whole if any(a in raw[end[i] - size[i] : end[i]] for a in self.added))
        ids, bounds = self._encode(raw, end - size, end, np.isin(np.arange(len(size)), whole))
        if not whole:
            return ids, bounds
        parts, sizes, at = [], np.diff(bounds), 0
        for i, more in zip(whole, self._library([raw[end[i] - size[i] : end[i]].decode("utf-8", "replace") for i in whole]), strict=True):
            parts += [ids[at : bounds[i]], np.array(more, np.uint32)]
            at = bounds[i]
            sizes[i] += len(more)
        return np.concatenate([*parts, ids[at:]]), np.append(0, np.cumsum(sizes))

    def _encode(self, raw: bytes, begin: np.ndarray, end: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the documents raw[begin:end], skipped ones as empty texts."""
        if not len(end):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.bounds.n > self.max_chunks:
            self._forget()
        data = np.frombuffer(raw + bytes(4), np.uint8)
        cut = np.flatnonzero(data[: len(raw)] == 32)
        doc = np.searchsorted(end, cut, "right")
        keep = (cut + 1 < end[doc]) & ~_WHITE[data[cut + 1]] & ~skip[doc]
        for i in np.flatnonzero(keep & _LEAD[data[cut + 1]]).tolist():
            keep[i] = not raw.startswith(tuple(_WIDE), int(cut[i]) + 1)
        cut, doc = cut[keep], doc[keep]
        # A document's first chunk, then one behind each cut.
        many = np.bincount(doc, minlength=len(end)) + 1
        last = np.cumsum(many) - 1
        head = last - many + 1
        first = np.zeros(int(many.sum()), bool)
        first[head] = True
        start, stop = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        start[head], start[~first] = begin, cut + 1
        stop[:-1] = start[1:] - 1
        stop[last] = np.where(skip, begin, end)
        one, two = self.hash(data, start, stop, first)
        codes = self.table.get(one, two)
        gap = np.flatnonzero(codes < 0)
        if len(gap):
            at, back = _unlike(one[gap], two[gap])
            at = gap[at]
            number = self._new(raw, data, start[at], stop[at], first[at])
            self.table.put(one[at], two[at], number)
            codes[gap] = number[back]
        # Chunk 0 follows the last chunk of each text.
        chunks = np.zeros(len(codes) + len(end), np.int64)
        chunks[np.arange(len(codes)) + np.repeat(np.arange(len(end)), many)] = codes
        ids, after = self._ids(chunks)
        return ids, np.append(0, after[np.cumsum(many + 1) - 1])

    def _new(self, raw: bytes, data: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of chunks met for the first time."""
        out = np.zeros(len(start), np.int64)
        text = lambda rows: [raw[a:e].decode("utf-8", "replace") for a, e in zip(start[rows].tolist(), stop[rows].tolist(), strict=True)]
        # "word," is "word" and ",": letters and the mark after them never share a token.
        tailed = ~first & (stop - start > 1) & _IS_TAIL[data[stop - 1]] & _ASCII_LETTER[data[stop - 2]]
        rows = np.flatnonzero(first)
        out[rows] = self._learn(text(rows))
        rows = np.flatnonzero(~first & ~tailed)
        out[rows] = self._learn_spaced(text(rows))
        rows = np.flatnonzero(tailed)
        if len(rows):
            order = np.argsort(start[rows], kind="stable")
            rows = rows[order]
            # Chunks of this call that are not tailed are learned but not in the table yet: a stem among them is learned twice.
            one, two = self.hash(data, start[rows], stop[rows] - 1, np.zeros(len(rows), bool))
            stems = self.table.get(one, two)
            gap = np.flatnonzero(stems < 0)
            if len(gap):
                at, back = _unlike(one[gap], two[gap])
                found = self._learn_spaced([raw[a : e - 1].decode("utf-8", "replace") for a, e in zip(start[rows[gap[at]]].tolist(), stop[rows[gap[at]]].tolist(), strict=True)])
                stems[gap] = found[back]
            mark = np.array([_TAIL.find(c) + 1 for c in range(256)])[data[stop[rows] - 1]]
            ids, after = self._ids(np.stack([stems, mark], axis=1).ravel())
            out[rows] = self._add(ids, np.diff(after[1::2], prepend=0))
        return out


def _bytes_of(texts: pa.Array) -> bytes:
    """The bytes of texts without nulls, one after the other."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return b""
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    return data[int(at[0]) : int(at[-1])].to_pybytes()


def _places(raw: bytes, part: bytes) -> list[int]:
    out, at = [], raw.find(part)
    while at >= 0:
        out.append(at)
        at = raw.find(part, at + 1)
    return out


def _unlike(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for the different pairs, and each row's place among them; pairs in order of rows."""
    _, at, back = np.unique(one, return_index=True, return_inverse=True)
    if (two[at][back] != two).any():  # equal in one hash alone
        _, at, back = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(at)
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    return at[order], place[back.ravel()]


def bpe_encoder(path: str, end_id: int | None) -> BpeEncoder:
    """One encoder in each worker process, kept between tasks."""
    key = (path, end_id)
    if key not in _encoders:
        _encoders[key] = BpeEncoder(path, end_id)
    return _encoders[key]


def forget_encoders() -> None:
    """Later stages leave this worker's memory to others."""
    _encoders.clear()


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
