"""SentencePiece encoding, decoding, and sampling of segmentations without replacement.

The lattice of a text has an arc for each vocabulary piece; a path's probability is
the product of its pieces', normalised over all paths.  Gumbel top-k: perturbing
every path's log probability with a Gumbel variable and taking the k largest samples
k distinct paths without replacement.  Perturbed values need not be drawn for all
paths: the maximum over the paths behind a prefix is itself a Gumbel variable at the
prefix's log mass, so a best-first (A-star) search over prefixes, with that maximum
as its exact heuristic, emits paths in order (Maddison et al. 2014; Kool et al. 2019).

The sub-tree of a prefix is opened all at once: its best path is an ancestral sample,
and at each of its decisions the arcs not taken stay closed together, as one entry
whose maximum is a Gumbel variable cut off at that of the path.  No piece crosses a
blank, so log masses behind a position are kept per distinct word, and all words of a
text are walked in lock step.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import by_bytes
from quillwork.llm.bpe import Grown
from quillwork.llm.unigram import SPACE, load_vocabulary

#: Arcs that a worker remembers (when the memory is full, words that came again stay), and texts that are walked together.
MEMORY, TOGETHER = 12_000_000, 100
_WORD = re.compile(f"{SPACE}?[^{SPACE}]+|{SPACE}")


def _substring_hashes(text: str, stop: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and hashes of the substrings that end where their place's word (stop) does, or before; places fall out as lengths grow."""
    letters = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    at, h = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
    for n in range(1, longest + 1):
        if n > 1:
            fits = at + n <= stop[at]
            at, h = at[fits], h[fits]
        if not len(at):
            return
        h = h * np.uint64(0x9E3779B97F4A7C15) + letters[at + (n - 1)]
        yield n, at, _mix(h)


class Lattice:
    """Arcs of the words seen so far, flat and ordered by node; node 0 is a word's end and has none.

    Every position of a word is a node.  An arc has log_own, its log probability given
    its node, and share, the probabilities of the node's arcs up to it, the likeliest arc
    being a node's first.
    """

    def __init__(self, path: str):
        self.v = load_vocabulary(path)
        self.byte_log_prob = float(self.v.log_prob[self.v.byte_id[0]])
        # By length: hashes of the pieces in order, their ids, and a table of which hashes' first bits occur.
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(set(map(len, self.v.pieces))):
            pieces = [p for p in self.v.pieces if len(p) == n]
            stop = np.repeat(np.arange(1, len(pieces) + 1) * n, n)
            h = next(x for m, _, x in _substring_hashes("".join(pieces), stop, n) if m == n)
            order = np.argsort(h)
            some = np.zeros(1 << 18, bool)
            some[h >> np.uint64(46)] = True
            self.known[n] = h[order], np.array([self.v.pieces[p] for p in pieces])[order], some
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}  # first node
        self._nodes = Grown(np.zeros(2, np.int64))  # where each node's arcs start, and the end
        self._share, self._log_own = Grown(np.zeros(0, np.float32)), Grown(np.zeros(0))
        self._to, self._piece = Grown(np.zeros(0, np.int32)), Grown(np.zeros(0, np.int32))
        self._again = Grown(np.zeros(1, bool))  # by node: a word begins here that came again after it was learned
        self._show()
        # Ids of the bytes of characters without a piece, one after the other; an arc of such has minus its place.
        self.raw, self.raw_size = np.zeros(1, np.int32), np.zeros(1, np.int32)

    def _show(self) -> None:
        self.nodes, self.share, self.log_own, self.to, self.piece = (x.all for x in (self._nodes, self._share, self._log_own, self._to, self._piece))

    def _forget_rare(self) -> None:
        """Words that did not come again go; the others must come again to stay the next time.  All go if the others fill half of the memory."""
        old, again = self.words, self._again.all
        kept = [w for w, n in old.items() if again[n]]
        first = np.fromiter((old[w] for w in kept), np.int64, len(kept))
        size = np.fromiter(map(len, kept), np.int64, len(kept))
        nodes, share, log_own, to, piece = self.nodes, self.share, self.log_own, self.to, self.piece
        raw, raw_size = self.raw, self.raw_size
        many = nodes[first + size] - nodes[first]
        self._forget()
        if not kept or many.sum() > MEMORY // 2:
            return

        def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)

        at, arcs, begin = spans(first, size), spans(nodes[first], many), np.cumsum(size) - size + 1
        to, piece = to[arcs], piece[arcs]
        lone = np.flatnonzero(piece < 0)
        n = raw_size[-piece[lone]]
        self.raw, self.raw_size = np.append(np.int32(0), raw[spans(-piece[lone], n)]), np.append(np.int32(0), np.repeat(n, n))
        piece[lone] = -(1 + np.cumsum(n) - n)
        self.words = dict(zip(kept, begin.tolist(), strict=True))
        self._to.add(np.where(to > 0, to + np.repeat(begin - first, many), 0))
        self._nodes.add(np.cumsum(nodes[at + 1] - nodes[at]))
        self._again.add(np.zeros(len(at), bool))
        self._log_own.add(log_own[arcs])
        self._share.add(share[arcs])
        self._piece.add(piece)
        self._show()

    def learn(self, words: Iterable[str]) -> None:
        """Arcs of different words."""
        if len(self.to) > MEMORY:
            self._forget_rare()
        words = list(words)
        known = list(map(self.words.get, words))
        self._again.all[[n for n in known if n is not None]] = True
        new = [w for w, n in zip(words, known, strict=True) if n is None]
        if not new:
            return
        # No piece crosses from one word into the next: all substrings are looked up at once, by 64-bit hashes.
        text = "".join(new)
        size = np.fromiter(map(len, new), np.int64, len(new))
        stop = np.repeat(np.cumsum(size), size)  # where each position's word ends
        found = []
        for n, place, h in _substring_hashes(text, stop, max(self.known)):
            if n not in self.known:
                continue
            keys, ids, some = self.known[n]
            maybe = np.flatnonzero(some[h >> np.uint64(46)])
            k = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            hit = keys[k] == h[maybe]
            at = place[maybe[hit]]
            found.append((at, at + n, ids[k[hit]]))
        at, to, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        long = to - at
        log_prob = self.v.log_prob[piece]
        single = np.zeros(len(text), bool)
        single[at[long == 1]] = True
        lone = np.flatnonzero(~single)
        if len(lone):
            raw = [[self.v.byte_id[b] for b in text[i].encode("utf-8", "replace")] for i in lone.tolist()]
            size_of = np.array(list(map(len, raw)), np.int32)
            at, to = np.concatenate([at, lone]), np.concatenate([to, lone + 1])
            piece = np.concatenate([piece, -(len(self.raw) + np.cumsum(size_of) - size_of)])
            log_prob = np.concatenate([log_prob, self.byte_log_prob * size_of])
            self.raw = np.concatenate([self.raw, np.array([i for r in raw for i in r], np.int32)])
            self.raw_size = np.concatenate([self.raw_size, np.repeat(size_of, size_of)])
        # Log mass behind each position, from the words' ends backwards, all words at once.
        # Keys without ties, so that arcs come in the same order whatever other words are learned with theirs.
        order = np.argsort(((stop[at] - at) * (len(text) + 1) + at) * 64 + np.minimum(to - at, 63))
        at, to, piece, log_prob = at[order], to[order], piece[order], log_prob[order]
        level = stop[at] - at
        ends_word = to == stop[at]
        mass, log_own = np.zeros(len(text) + 1), np.empty(len(at))
        cuts = np.flatnonzero(np.diff(level, prepend=0, append=level[-1] + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m = log_prob[a:b] + np.where(ends_word[a:b], 0.0, mass[to[a:b] - (to[a:b] == len(text))])
            head = np.flatnonzero(np.diff(at[a:b], prepend=-1))
            total = np.logaddexp.reduceat(m, head)
            mass[at[a:b][head]] = total
            log_own[a:b] = m - np.repeat(total, np.diff(np.append(head, b - a)))
        # By node, the likeliest arc first, of likely ones alike the shorter.
        own = np.exp(log_own)
        unlikely = ((1 - own) * 2.0**36).astype(np.int64)
        order = np.argsort(at << 43 | unlikely << 6 | np.minimum(to - at, 63)) if len(text) < 1 << 20 else np.lexsort((to - at, unlikely, at))
        at, log_own = at[order], log_own[order]
        head = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(head[1:], len(at)) - 1
        share, on, k = own[order], head[last > head], 1
        while len(on):  # each node's sums on their own
            share[on + k] += share[on + k - 1]
            k += 1
            on = on[at[np.minimum(on + k, len(at) - 1)] == at[on]]
            on = on[on + k < len(at)]
        share[last] = 2.0  # no draw passes a node's last arc
        base = len(self.nodes) - 1
        self.words.update(zip(new, (np.cumsum(size) - size + base).tolist(), strict=True))
        self._to.add(np.where(ends_word[order], 0, to[order] + base))
        self._nodes.add(self._log_own.n + last + 1)
        self._again.add(np.zeros(len(text), bool))
        self._log_own.add(log_own)
        self._share.add(share)
        self._piece.add(piece[order])
        self._show()

    def walk(self, starts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ancestral samples from start nodes to their words' ends: arcs in order of start and position, and how many each start has."""
        live, at, found, step = np.arange(len(starts)), starts, [], 0
        many = np.zeros(len(starts), np.int64)
        while len(live):
            arc, u = self.nodes[at], _uniform(seeds[live], step)
            on = np.flatnonzero(self.share[arc] < u)
            while len(on):
                arc[on] += 1
                on = on[self.share[arc[on]] < u[on]]
            found.append((live, arc))
            at, step = self.to[arc], step + 1
            on = at > 0
            many[live[~on]] = step
            live, at = live[on], at[on]
        # A start's arc of a step has its place: it takes part in all steps up to its word's end.
        first, out = np.cumsum(many) - many, np.empty(int(many.sum()), np.int64)
        for step, (of, arc) in enumerate(found):
            out[first[of] + step] = arc
        return out, many


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function: random bits of a counter."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _seed(seeds: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return _mix(seeds + (np.atleast_1d(n).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _uniform(seeds: np.ndarray, n: np.ndarray | int = 0) -> np.ndarray:
    """Numbers above 0 and below 1, the same for the same seed and n whatever else is drawn."""
    return ((_seed(seeds, n) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _cut_gumbel(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at these log masses, given that each is below top."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - mass)


def sample_paths(lattice: Lattice, texts: list[np.ndarray], k: int, seeds: np.ndarray) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, given by its words' first nodes: up to k distinct paths by falling perturbed value, as arcs, log probability, perturbed value, inclusion score."""
    log_own, to, nodes = lattice.log_own, lattice.to, lattice.nodes
    found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
    closed: list[list[list]] = [[] for _ in texts]  # [values by decision, arcs, arcs opened by decision]
    kappa = np.full(len(texts), -np.inf)
    nothing = np.zeros(0, np.int64)

    def open_(round_: int, todo: list[tuple[int, np.ndarray, np.ndarray, float]]) -> None:
        """For (text, prefix, nodes behind it, perturbed value): the best path with this prefix, and what stays closed beside it."""
        size = np.array([len(rest) for _, _, rest, _ in todo])
        own_seed = _seed(seeds[[i for i, _, _, _ in todo]], round_)
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        arcs, n = lattice.walk(np.concatenate([rest for _, _, rest, _ in todo]), _seed(np.repeat(own_seed, size), place))
        ends = np.append(0, np.cumsum(n))
        spans = np.stack([ends[first], ends[first + size]], axis=1) if len(n) else np.zeros((len(todo), 2), np.int64)
        lp = log_own[arcs]
        before = np.cumsum(lp) - lp
        many = spans[:, 1] - spans[:, 0]
        start = np.array([log_own[prefix].sum() for _, prefix, _, _ in todo])
        shift = start - np.where(many > 0, np.append(before, 0.0)[np.minimum(spans[:, 0], len(before))], 0.0)
        # Decisions that leave something closed; most arcs are the only likely one of their node.
        other = -np.expm1(lp)
        some = np.flatnonzero(other > 1e-12)
        of = np.repeat(np.arange(len(todo)), many)[some]
        u = _uniform(_seed(own_seed, 1 << 40)[of], some - spans[of, 0])
        value = np.full(len(arcs), -np.inf)
        value[some] = _cut_gumbel(before[some] + shift[of] + np.log(other[some]), np.array([top for _, _, _, top in todo])[of], u)
        for (i, prefix, _, top), (a, e), s in zip(todo, spans.tolist(), start.tolist(), strict=True):
            # Decisions of the prefix belong to whoever opened it.
            closed[i].append([np.concatenate([np.full(len(prefix), -np.inf), value[a:e]]), np.concatenate([prefix, arcs[a:e]]), {}])
            found[i].append((closed[i][-1][1], s + float(lp[a:e].sum()), top))

    tops = -np.log(-np.log(_uniform(_seed(seeds, 1 << 41))))
    open_(0, [(i, nothing, t, float(g)) for i, (t, g) in enumerate(zip(texts, tops, strict=True))])
    live = list(range(len(texts)))
    for round_ in range(1, k + 1):
        pick, cut = _uniform(_seed(seeds, (1 << 42) + round_)), _uniform(_seed(seeds, (1 << 43) + round_))
        todo = []
        for t in live:
            value, arcs, opened = max(closed[t], key=lambda c: c[0].max(initial=-np.inf))
            top = float(value.max(initial=-np.inf))
            if top == -np.inf:
                continue
            if round_ == k:
                kappa[t] = top  # the (k+1)th value: only the threshold is asked for
                continue
            i = int(value.argmax())
            node = int(np.searchsorted(nodes, arcs[i], "right")) - 1
            here = np.arange(nodes[node], nodes[node + 1])
            taken = opened.setdefault(i, [int(arcs[i])])
            untaken = np.ones(len(here), bool)
            untaken[np.array(taken) - here[0]] = False
            free = here[untaken]
            own = np.exp(log_own[free])
            j = min(len(free) - 1, int(np.searchsorted(np.cumsum(own), pick[t] * own.sum())))
            arc, left = int(free[j]), float(own.sum() - own[j])
            taken.append(arc)
            if len(free) > 1 and left > 1e-15:
                value[i] = _cut_gumbel(log_own[arcs[:i]].sum() + math.log(left), top, cut[t])
            else:
                value[i] = -np.inf
            done = int((to[arcs[:i]] == 0).sum())
            behind = texts[t][done + 1 :] if to[arc] == 0 else np.append(to[arc], texts[t][done + 1 :])
            todo.append((t, np.append(arcs[:i], arc), behind, top))
        live = [t for t, _, _, _ in todo] if round_ < k else live
        if todo:
            open_(round_, todo)
    return [[(arcs, lp, g, 1.0 if kappa[t] == -np.inf else -math.expm1(-math.exp(min(700.0, lp - kappa[t])))) for arcs, lp, g in f] for t, f in enumerate(found)]


class Sampler:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lattice = Lattice(path)
        v = self.lattice.v
        at = {b: i for i, b in enumerate(v.byte_id)}
        pieces = [bytes([at[i]]) if i in at else n.replace(SPACE, " ").encode() for i, n in enumerate(v.names)]
        self.letters, self.size_of = np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces)), np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of

    def normalised(self, text: str | None) -> str:
        """The model file's own normalisation; surrogates that UTF-8 lacks become question marks."""
        return self.model.normalize((text or "").encode("utf-8", "replace").decode())

    def ids(self, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of arcs one after the other, and how many each arc has."""
        lattice = self.lattice
        piece = lattice.piece[arcs]
        raw = piece < 0
        size = np.where(raw, lattice.raw_size[np.where(raw, -piece, 0)], 1)
        if not raw.any():
            return piece, size
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        whole, lone = np.repeat(piece, size), np.repeat(raw, size)
        return np.where(lone, lattice.raw[np.where(lone, at - whole, 0)], whole), size

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids one after the other, and how many each has."""
        size = self.size_of[ids]
        first = np.cumsum(size) - size
        return self.letters[np.repeat(self.start_of[ids] - first, size) + np.arange(size.sum())].tobytes(), size

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the blank that encoding puts first is taken off."""
        return self.bytes_of(ids)[0].decode("utf-8", "replace").removeprefix(" ")

    def samples(self, keys: list, texts: list[str | None], k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float, bool]]:
        """Row, sample, ids, log probability, perturbed value, inclusion score, and whether decoding gives the normalised text."""
        for a in range(0, len(keys), TOGETHER):
            cut = [_WORD.findall(self.normalised(t)) for t in texts[a : a + TOGETHER]]
            self.lattice.learn(dict.fromkeys(chain.from_iterable(cut)))
            first = self.lattice.words
            seeds = np.array([xxhash.xxh64_intdigest(str(x).encode(), 42) for x in keys[a : a + TOGETHER]], np.uint64)
            words = [np.array([first[w] for w in c], np.int64) for c in cut]
            found = [(i, n, p) for i, paths in enumerate(sample_paths(self.lattice, words, k, seeds)) for n, p in enumerate(paths, 1)]
            # All samples at once: ids of their arcs, bytes of their ids, and where each sample ends in them.
            ids, many = self.ids(np.concatenate([p[0] for _, _, p in found]))
            ends = np.append(0, np.cumsum(many))[np.cumsum([0, *(len(p[0]) for _, _, p in found)])]
            raw, size = self.bytes_of(ids)
            cuts = np.append(0, np.cumsum(size))[ends].tolist()
            texts_as_bytes = ["".join(c).replace(SPACE, " ").encode() for c in cut]
            for j, (i, n, (_, lp, g, inclusion)) in enumerate(found):
                yield a + i, n, ids[ends[j] : ends[j + 1]], lp, g, inclusion, raw[cuts[j] : cuts[j + 1]] == texts_as_bytes[i]


@cache
def sampler(path: str) -> Sampler:
    return Sampler(path)


def encode_of(path: str) -> Callable[[Column], Column]:
    """A function from a text column to the file's own ids, by the sentencepiece library.  Null and empty texts give no ids."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sampler(path).model
        for texts in batches:
            yield pd.Series(model.encode([(t or "").encode("utf-8", "replace").decode() for t in texts], num_threads=1))

    return run


def decode_of(path: str) -> Callable[[Column], Column]:
    """A function from a column of ids to text; null ids give the empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = sampler(path)
        for ids in batches:
            yield pd.Series(["" if x is None else s.decode(np.asarray(x)) for x in ids])

    return run


def sample_segmentations(docs: DataFrame, path: str, k: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Up to k rows per document: id, sample (from 1), n_pieces, log_prob, perturbed, inclusion, ids_crc32, round_trip, and ids on demand.

    Samples come by falling perturbed value and differ from each other; texts with
    fewer segmentations give fewer, each with inclusion 1; null and empty texts give one
    without pieces.  perturbed minus log_prob is standard Gumbel noise before selection;
    inclusion is 1 - exp(-exp(log_prob - t)), t being the (k+1)th perturbed value.  The id
    seeds a row, so repeated rows give repeated results.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("sample", pa.int32()), ("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), *[("ids", pa.list_(pa.int32()))] * with_ids])
    ddl = f"`{id_col}` {kind}, sample int, n_pieces int, log_prob double, perturbed double, inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path)
        for b in by_bytes(batches):
            at, rows = [], []
            for i, n, ids, lp, g, inclusion, same in s.samples(b.column(0).to_pylist(), b.column(1).to_pylist(), k):
                at.append(i)
                rows.append((n, len(ids), lp, g, inclusion, zlib.crc32(ids.astype("<u4").tobytes()), same, *[ids.tolist()] * with_ids))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], [id_col, *schema.names])

    return docs.select(id_col, text_col).mapInArrow(run, ddl)
