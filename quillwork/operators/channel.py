"""A learned model of misspellings: a noisy channel, fitted by expectation-maximisation, searched over a dictionary's trie.

A word is typed letter by letter: before each letter, and at the end, letters may slip in;
then the letter is typed as some letter, itself as a rule, or left out.  The chances are
learned from pairs (misspelling, correct) without knowing which letter became which: a step
works out, for each pair in its task, how often each slip is to be expected, sums that up in
Spark, and takes the shares for the next.  A misspelling's correction is the dictionary word
of the best chance to be meant and to be typed so.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import clean, match_case, tokens_with_separators
from quillwork.operators.correct import Corrector
from quillwork.sources.constants import VALID_WORDS

#: Steps of the fit; what a slip that no pair shows counts as; the dictionary words that a model holds at most.
STEPS, UNSEEN, WORDS = 5, 1e-4, 500_000
#: A correction that costs more than this for each letter of the misspelling (in nats) is none.
CUTOFF = 4.0
_STOP, _SLIP, _OUT = "stop", "slip", ""


@dataclass
class Channel:
    """Chances: typed[a][b] that letter a is typed as b ("" for left out), slips[b] that b slips in, stop that nothing (more) does."""

    typed: dict[str, dict[str, float]] = field(default_factory=dict)
    slips: dict[str, float] = field(default_factory=dict)
    stop: float = 0.9

    def of(self, a: str, b: str) -> float:
        known = self.typed.get(a)
        if known is None:
            return 0.9 if a == b else UNSEEN
        return known.get(b, UNSEEN)

    def slip(self, b: str) -> float:
        return self.slips.get(b, UNSEEN)


def expected(channel: Channel, misspelling: str, correct: str) -> Counter:
    """How often each slip is to be expected in a pair: forward and backward sums over all ways to type it."""
    n, m, stop = len(correct), len(misspelling), channel.stop
    keep = [[channel.of(a, b) * stop for b in misspelling] for a in correct]
    out = [channel.of(a, _OUT) * stop for a in correct]
    slip = [channel.slip(b) for b in misspelling]
    ahead = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            x = 1.0 if not i and not j else 0.0
            if j:
                x += ahead[i][j - 1] * slip[j - 1]
            if i:
                x += ahead[i - 1][j] * out[i - 1]
                if j:
                    x += ahead[i - 1][j - 1] * keep[i - 1][j - 1]
            ahead[i][j] = x
    back = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            x = stop if i == n and j == m else 0.0
            if j < m:
                x += slip[j] * back[i][j + 1]
            if i < n:
                x += out[i] * back[i + 1][j]
                if j < m:
                    x += keep[i][j] * back[i + 1][j + 1]
            back[i][j] = x
    total, found = back[0][0], Counter()
    if not total:
        return found
    for i in range(n + 1):
        for j in range(m + 1):
            here = ahead[i][j] / total
            if not here:
                continue
            if j < m:
                found[_SLIP, misspelling[j]] += here * slip[j] * back[i][j + 1]
            if i < n:
                found[correct[i], _OUT] += here * out[i] * back[i + 1][j]
                if j < m:
                    found[correct[i], misspelling[j]] += here * keep[i][j] * back[i + 1][j + 1]
    found[_STOP, ""] = n + 1.0
    return found


#: Cells of the sums that are worked out at once.
CELLS = 1 << 19


def expected_sums(channel: Channel, pairs: list[tuple[str, str, float]]) -> Counter:
    """The sum of `expected` over pairs (misspelling, correct, n), n times each: pairs of equal lengths go through the same steps together."""
    found: Counter = Counter()
    by: dict[tuple[int, int], list[tuple[str, str, float]]] = defaultdict(list)
    for p in pairs:
        by[len(p[1]), len(p[0])].append(p)
    for (n, m), group in by.items():
        at_once = max(1, CELLS // ((n + 1) * (m + 1)))
        for k in range(0, len(group), at_once):
            found.update(_sums_of_lengths(channel, n, m, group[k : k + at_once]))
    return found


def _sums_of_lengths(channel: Channel, n: int, m: int, pairs: list[tuple[str, str, float]]) -> dict[tuple[str, str], float]:
    letters = sorted({x for p in pairs for x in p[0] + p[1]})
    at, stop = {x: i for i, x in enumerate(letters)}, channel.stop
    typed = np.full((len(letters), len(letters) + 1), UNSEEN)  # the last column: left out
    for a, i in at.items():
        if a not in channel.typed:
            typed[i, i] = channel.of(a, a)
        for b, x in channel.typed.get(a, {}).items():
            if b in at or b == _OUT:
                typed[i, at.get(b, -1)] = x
    c = np.array([[at[x] for x in p[1]] for p in pairs], np.int64).T
    b = np.array([[at[x] for x in p[0]] for p in pairs], np.int64).T
    keep = typed[c[:, None], b[None]] * stop
    out, slip = typed[c, -1] * stop, np.array([channel.slip(x) for x in letters])[b]
    ahead, back = np.zeros((2, n + 1, m + 1, len(pairs)))
    for i in range(n + 1):
        for j in range(m + 1):
            x = ahead[i, j]
            if not i and not j:
                x += 1
            if j:
                x += ahead[i, j - 1] * slip[j - 1]
            if i:
                x += ahead[i - 1, j] * out[i - 1]
                if j:
                    x += ahead[i - 1, j - 1] * keep[i - 1, j - 1]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            x = back[i, j]
            if i == n and j == m:
                x += stop
            if j < m:
                x += slip[j] * back[i, j + 1]
            if i < n:
                x += out[i] * back[i + 1, j]
                if j < m:
                    x += keep[i, j] * back[i + 1, j + 1]
    total, times = back[0, 0], np.array([p[2] for p in pairs], float)
    ahead *= np.divide(times, total, out=np.zeros(len(pairs)), where=total > 0)
    slips = np.bincount(b.ravel(), (ahead[:, :-1] * slip * back[:, 1:]).sum(0).ravel(), len(letters))
    outs = np.bincount(c.ravel(), (ahead[:-1] * out[:, None] * back[1:]).sum(1).ravel(), len(letters))
    keeps = np.bincount((c[:, None] * len(letters) + b[None]).ravel(), (ahead[:-1, :-1] * keep * back[1:, 1:]).ravel(), len(letters) ** 2)
    found = {(_SLIP, letters[i]): float(slips[i]) for i in np.flatnonzero(slips)} | {(letters[i], _OUT): float(outs[i]) for i in np.flatnonzero(outs)}
    found |= {(letters[i // len(letters)], letters[i % len(letters)]): float(keeps[i]) for i in np.flatnonzero(keeps)}
    if (total > 0).any():
        found[_STOP, ""] = float((n + 1.0) * times[total > 0].sum())
    return found


def fit_channel(pairs: DataFrame, steps: int = STEPS) -> Channel:
    """From pairs (misspelling, correct) and, if there is such a column, n, how often each occurs; lower case.  Null and empty words take no part.

    Each step reads all pairs; what comes to the driver is a row for each pair of letters, never of words.
    """
    n = F.col("n").cast("double") if "n" in pairs.columns else F.lit(1.0)
    rows = pairs.filter("misspelling <> '' AND correct <> ''").groupBy("misspelling", "correct").agg(F.sum(n).alias("n"))
    channel = Channel()
    for _ in range(steps):

        def count(batches: Iterator[pa.RecordBatch], channel: Channel = channel) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in batches:
                total.update(expected_sums(channel, list(zip(*(x.to_pylist() for x in b.columns), strict=True))))
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.float64())], ["a", "b", "x"])

        sums = rows.mapInArrow(count, "a string, b string, x double").groupBy("a", "b").agg(F.sum("x").alias("x")).collect()
        by: dict[str, dict[str, float]] = defaultdict(dict)
        for r in sums:
            by[r["a"]][r["b"]] = r["x"]
        if not by:
            break
        slips, stops = by.pop(_SLIP, {}), by.pop(_STOP)[""]
        gaps = stops + sum(slips.values())
        share = lambda x, whole: max(UNSEEN, x / whole)
        channel = Channel({a: {b: share(x, sum(to.values())) for b, x in to.items()} for a, to in by.items()}, {b: share(x, gaps) for b, x in slips.items()}, max(UNSEEN, stops / gaps))
    return channel


#: Words that are searched for together, the rows of each that a first look keeps at a depth, and what sums in another order may differ by.
TOGETHER, KEPT, SLACK = 128, 8, 1e-9
#: What is beyond any cost, where a bound must be finite.
_FAR = 1e9


def _nats(chance: float) -> float:
    return -log(chance) if chance > 0 else inf


class Trie:
    """Dictionary words with the cost of being meant; searched for what misspellings stand for.

    Nodes are numbered by depth, then by the alphabet, so those of a depth and the kids of a
    node lie side by side: first is a node's first kid, count how many it has, letter the one
    that leads to it, word the number of the word that ends there or -1.  Of the words below a
    node, least is the cheapest's cost, near and far the letters to the nearest and the
    farthest end, and below has a bit for each letter, 64 to a part.
    """

    def __init__(self, words: dict[str, float], channel: Channel):
        """words: how often each occurs, at least once."""
        total = sum(words.values())
        self.channel, self.words, self.letters = channel, sorted(words), sorted({c for w in words for c in w})
        self.meant = np.array([*(_nats(words[w] / total) for w in self.words), inf])  # the last is that of no word
        self._lay_out()
        self.stop = _nats(channel.stop)
        self.outs = np.array([self.stop + _nats(channel.of(c, _OUT)) for c in self.letters])
        self._typed: dict[str, tuple[np.ndarray, float, float, float, np.ndarray]] = {}

    def _lay_out(self) -> None:
        lengths = np.array([len(w) for w in self.words], np.int64)
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.searchsorted(np.array([ord(c) for c in self.letters], np.uint32), text)
        left, node, depths, ends = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), [0, 1], []
        parents, letters = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        while len(left):  # a depth at a time; words are sorted, so those of a node lie side by side
            over = lengths[left] == len(parents) - 1
            ends.append((node[over], left[over]))
            left, node = left[~over], node[~over]
            c = codes[starts[left] + len(parents) - 1]
            fresh = np.ones(len(left), bool)
            fresh[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
            parents.append(node[fresh])
            letters.append(c[fresh])
            node = depths[-1] + np.cumsum(fresh) - 1
            depths.append(depths[-1] + int(fresh.sum()))
        parent, self.letter, n = np.concatenate(parents), np.concatenate(letters), depths[-1]
        self.count = np.bincount(parent[1:], minlength=n)
        self.first = 1 + np.cumsum(self.count) - self.count
        self.word = np.full(n, -1, np.int64)
        for at, w in ends:
            self.word[at] = w
        self.least, ending = self.meant[self.word], self.word >= 0
        self.near, self.far = np.where(ending, 0.0, inf), np.where(ending, 0.0, -inf)
        i, parts = np.arange(len(self.letters)), -(-len(self.letters) // 64)
        self.bits = np.where(i // 64 == np.arange(parts)[:, None], np.uint64(1) << (i % 64).astype(np.uint64), np.uint64(0))
        self.below = np.zeros((parts, n), np.uint64)
        for lo, hi in reversed([x for x in zip(depths[1:], depths[2:]) if x[0] < x[1]]):
            up = parent[lo:hi]
            runs = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            to = up[runs]
            self.least[to] = np.minimum(self.least[to], np.minimum.reduceat(self.least[lo:hi], runs))
            self.near[to] = np.minimum(self.near[to], 1 + np.minimum.reduceat(self.near[lo:hi], runs))
            self.far[to] = np.maximum(self.far[to], 1 + np.maximum.reduceat(self.far[lo:hi], runs))
            self.below[:, to] = np.bitwise_or.reduceat(self.below[:, lo:hi] | self.bits[:, self.letter[lo:hi]], runs, axis=1)

    def typed(self, b: str) -> tuple[np.ndarray, float, float, float, np.ndarray]:
        """Of a letter: its cost for each letter meant and as a slip; the least it can cost at all, and without the letters often typed so; the bits of these."""
        if b not in self._typed:
            costs, slip = np.array([self.stop + _nats(self.channel.of(a, b)) for a in self.letters]), _nats(self.channel.slip(b))
            low = costs.min(initial=inf)
            often = costs <= low + 2
            self._typed[b] = costs, slip, min(low, slip, _FAR), min(costs[~often].min(initial=_FAR), slip), np.bitwise_or.reduce(self.bits[:, often], axis=1)
        return self._typed[b]

    def best(self, word: str, cutoff: float = CUTOFF) -> tuple[str, float] | None:
        """The cheapest word other than this one and its cost, the first by the alphabet of equals; None if it costs more than cutoff for each letter."""
        return self.best_of([word], cutoff)[0]

    def best_of(self, words: list[str], cutoff: float = CUTOFF) -> list[tuple[str, float] | None]:
        """The same for many words, which are searched for together, those of about the same length."""
        found: list[tuple[str, float] | None] = [None] * len(words)
        order = sorted((i for i, w in enumerate(words) if w and self.words), key=lambda i: (-len(words[i]), words[i]))
        while order:
            n = max(1, min(TOGETHER, CELLS // ((len(words[order[0]]) + 1) * max(1, len(self.letters)))))
            some, order = order[:n], order[n:]
            for i, told in zip(some, _Search(self, [words[i] for i in some], cutoff).run(), strict=True):
                found[i] = told
        return found


#: Rows of a search: whose word's and of which node each is, its cells (an array for each place in the words), and the least that its cells can come to.
_Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class _Search:
    """Words that are looked for in a trie together.

    A row has a cell for each place in a word: the cost of typing it up to there, when what was
    meant is a node's letters.  Words end in the last cell, shorter ones begin later.  A cell's
    bound is its cost, the cheapest word below its node, and the least that the letters still
    to be typed can cost: each is one of the few letters below that are often typed so, or
    costs more; what is too many for the farthest end has slipped in, what is too few for the
    nearest is left out.  A first look keeps a few rows of each word at each depth; what it
    finds is a limit for the second, which leaves out only rows whose bounds are all beyond it.
    """

    def __init__(self, trie: Trie, words: list[str], cutoff: float):
        lengths = np.array([len(w) for w in words])
        letters = sorted({b for w in words for b in w})
        at, told = {b: i for i, b in enumerate(letters)}, [trie.typed(b) for b in letters]
        self.trie, self.n, self.words = trie, int(lengths.max()), len(words)
        self.pad = self.n - lengths
        typed = np.array([[0] * (self.n - len(w)) + [at[b] for b in w] for w in words]).T
        costs, slips, lows, highs, often = (np.array(x) for x in zip(*told, strict=True))
        pads = np.arange(self.n)[:, None] < self.pad
        self.keep = costs[typed].transpose(0, 2, 1).reshape(self.n, -1)  # by place; by letter meant and word
        self.slip, self.often = slips[typed], np.moveaxis(often[typed], -1, 0)
        self.low, self.more = np.where(pads, 0.0, lows[typed]), np.where(pads, 0.0, np.maximum(highs - lows, 0)[typed])
        self.least_slip = np.where(pads, _FAR, np.minimum(self.slip, _FAR)).min(0)
        self.least_out = trie.outs.min(initial=_FAR)
        self.limit, self.answer = cutoff * lengths, np.full(len(words), len(trie.words))
        own = [bisect_left(trie.words, w) for w in words]
        self.own = np.array([i if trie.words[i : i + 1] == [w] else -1 for i, w in zip(own, words, strict=True)])

    def run(self) -> list[tuple[str, float] | None]:
        pads = np.arange(self.n + 1)[:, None] < self.pad
        cells = np.zeros((self.n + 1, self.words))
        cells[1:] = np.cumsum(np.where(pads[:-1], 0.0, self.slip), axis=0)
        cells[pads] = inf
        root = np.arange(self.words), np.zeros(self.words, np.int64), cells, np.zeros(self.words)
        self._note(*root[:3])
        rows, depth = root, 0
        while len(rows[0]):
            depth += 1
            rows = self._few(self._below(rows, depth))
        heap, made, at_once = [(0, 0, root)], 0, max(1, CELLS // 4 // (self.n + 1))
        while heap:  # the deepest first, so that few wait
            up, _, rows = heapq.heappop(heap)
            rows = self._below(rows, 1 - up)
            for k in range(0, len(rows[0]), at_once):
                made += 1
                heapq.heappush(heap, (up - 1, made, tuple(x[..., k : k + at_once] for x in rows)))
        return [(self.trie.words[a], x) if a < len(self.trie.words) else None for a, x in zip(self.answer.tolist(), self.limit.tolist(), strict=True)]

    def _few(self, rows: _Rows) -> _Rows:
        """The rows of each word that promise most."""
        order = np.lexsort((rows[3] + self.trie.least[rows[1]], rows[0]))
        many = np.bincount(rows[0], minlength=self.words)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many)
        return tuple(x[..., order[rank < KEPT]] for x in rows)

    def _note(self, q: np.ndarray, node: np.ndarray, cells: np.ndarray) -> None:
        """Words that end here, where they are better than the answers so far."""
        w = self.trie.word[node]
        cost = cells[-1] + self.trie.stop + self.trie.meant[w]
        ends = np.flatnonzero((w >= 0) & (w != self.own[q]) & (cost <= self.limit[q]))
        ends = ends[np.lexsort((w[ends], cost[ends], q[ends]))]
        ends = ends[np.unique(q[ends], return_index=True)[1]]
        q, w, cost = q[ends], w[ends], cost[ends]
        better = (cost < self.limit[q]) | (w < self.answer[q])
        self.limit[q[better]], self.answer[q[better]] = cost[better], w[better]

    def _below(self, rows: _Rows, depth: int) -> _Rows:
        """The rows of the kids, but those whose bounds are beyond the limit."""
        trie, n, (q, node, cells, bound) = self.trie, self.n, rows
        count = trie.count[node]
        at = np.repeat(np.arange(len(q)), count)
        kid = np.arange(len(at)) + np.repeat(trie.first[node] - np.cumsum(count) + count, count)
        can = np.flatnonzero(bound[at] + trie.least[kid] <= self.limit[q[at]] + SLACK)
        at, kid = at[can], kid[can]
        q, letter, least = q[at], trie.letter[kid], trie.least[kid]
        out, pair, new = trie.outs[letter], letter * self.words + q, np.full((n + 1, len(at)), inf)
        # so many more letters of the word than of what was meant, or fewer, are beyond any limit
        aside = (self.limit.max() - trie.least[0]) / max(min(self.least_slip.min(), self.least_out), SLACK)
        aside = int(min(aside, n + depth)) + 1
        lo, hi = max(0, depth + int(self.pad.min()) - aside), min(n, depth + int(self.pad.max()) + aside)
        before = cells[max(lo - 1, 0)][at]
        for j in range(lo, hi + 1):
            here = cells[j][at]
            x = here + out
            if j:
                np.minimum(x, before + self.keep[j - 1][pair], out=x)
                np.minimum(x, new[j - 1] + self.slip[j - 1][q], out=x)
            new[j], before = x, here
        near, far, below, least_slip = trie.near[kid], trie.far[kid], trie.below[:, kid], self.least_slip[q]
        rest, bound = np.full(len(at), trie.stop), np.full(len(at), inf)
        for j in range(n, lo - 1, -1):
            if j <= hi:
                left = n - j
                np.minimum(bound, new[j] + np.maximum(rest, (left - far) * least_slip) + np.maximum(near - left, 0) * self.least_out, out=bound)
            if j:
                rest += self.low[j - 1][q] + self.more[j - 1][q] * ~(below & self.often[:, j - 1][:, q]).any(axis=0)
        self._note(q, kid, new)
        stay = np.flatnonzero((bound + least <= self.limit[q] + SLACK) & (trie.count[kid] > 0))
        return q[stay], kid[stay], new[:, stay], bound[stay]


_tries: dict[str, Trie] = {}


def _trie(name: str, sent: Broadcast) -> Trie:
    """One in each worker, kept between tasks."""
    if name not in _tries:
        _tries.clear()
        _tries[name] = Trie(*sent.value)
    return _tries[name]


class LearnedModel:
    """A channel and a dictionary (word, n): its `most` most frequent words; n how often a word occurs, 1 without such a column."""

    def __init__(self, channel: Channel, dictionary: DataFrame, most: int = WORDS):
        n = F.col("n").cast("double") if "n" in dictionary.columns else F.lit(1.0)
        counted = dictionary.filter("word <> ''").groupBy("word").agg(F.greatest(F.sum(n), F.lit(1.0)).alias("n"))
        kept = counted.select("word", "n").orderBy(F.desc("n"), "word").limit(most).toArrow()
        self.channel, self.words, self.name = channel, dict(zip(*(x.to_pylist() for x in kept.columns), strict=True)), uuid.uuid4().hex
        self._sent = dictionary.sparkSession.sparkContext.broadcast((self.words, channel))  # read once by each worker, not by each task

    def corrections(self, words: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
        """word, correction, cost for distinct words (lower case); no row for those without an answer."""
        name, sent = self.name, self._sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = _trie(name, sent)
            for b in batches:
                asked = [w for w in b.column(0).to_pylist() if w]
                told = [(w, *found) for w, found in zip(asked, trie.best_of(asked, cutoff), strict=True) if found]
                word, correction, cost = zip(*told, strict=True) if told else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(correction, pa.string()), pa.array(cost, pa.float64())], ["word", "correction", "cost"])

        return words.select("word").mapInArrow(run, "word string, correction string, cost double")

    def corrector(self, cutoff: float = CUTOFF) -> Corrector:
        """A model for check_sentences: replies a sentence with its unknown words corrected, and null where it knows nothing to correct."""

        def reply(rows: DataFrame) -> DataFrame:
            spark = rows.sparkSession
            known = spark.createDataFrame([(w,) for w in {*self.words, *VALID_WORDS}], "word string")
            told = rows.select("key", F.posexplode(tokens_with_separators("sentence")).alias("i", "token")).withColumn("word", clean("token"))
            asked = told.select("word").filter("length(word) >= 2").distinct().join(known, "word", "left_anti")
            met = told.join(self.corrections(asked, cutoff).select("word", "correction"), "word", "left")
            new = F.when(F.col("correction").isNotNull(), F.regexp_replace("token", r"[\w']+", match_case("token", "correction"))).otherwise(F.col("token"))
            per = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", new.alias("t")))).alias("_t"), F.count("correction").alias("_n"))
            return per.select("key", F.when(F.col("_n") > 0, F.array_join(F.transform("_t", lambda x: x["t"]), "")).alias("reply"))

        return reply
