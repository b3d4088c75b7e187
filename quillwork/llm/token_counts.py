"""Token counts by a count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic
programming carries the best score and the number of pieces to each position, and
no path is kept.  Ties and unknown characters go as in the tokenizers library's
Unigram model with byte fallback, after Prepend and Replace of blanks and a split
before each blank: a later candidate must be strictly better, candidates come in
order of their start, and a character without a piece of its own may become bytes
at the least score less 10.  Pieces never cross a blank, so a text's count is the
sum of its words' counts, and words that come again are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm.unigram import SPACE, load_vocabulary

UNKNOWN_PENALTY = 10.0
#: Words remembered by a worker; the memory starts anew when it is full.  Longer words are not remembered.
MEMORY, LONGEST_KEPT = 1_000_000, 64


class TokenCounter:
    def __init__(self, path: str):
        import ahocorasick

        v = load_vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, i in v.pieces.items():
            self.automaton.add_word(piece, (len(piece), float(v.log_prob[i])))
        self.automaton.make_automaton()
        self.single = {p for p in v.pieces if len(p) == 1}
        self.unknown = v.least - UNKNOWN_PENALTY
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path through a word that starts with the blank's sign."""
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # positions whose best is final
        best, pieces = None, 0
        for end, (size, weight) in self.automaton.iter(word):
            while done < end:
                self._close(word, done, best, pieces, score, count)
                done, best, pieces = done + 1, None, 0
            s = score[end + 1 - size] + weight
            if best is None or s > best:
                best, pieces = s, count[end + 1 - size] + 1
        while done < n:
            self._close(word, done, best, pieces, score, count)
            done, best, pieces = done + 1, None, 0
        return count[n]

    def _close(self, word: str, at: int, best: float | None, pieces: int, score: list[float], count: list[int]) -> None:
        """Settle position at + 1: the character itself may be unknown."""
        if word[at] not in self.single:
            s = score[at] + self.unknown
            if best is None or s > best:
                best, pieces = s, count[at] + len(word[at].encode("utf-8", "replace"))
        score[at + 1], count[at + 1] = best, pieces

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        found = list(map(self.seen.get, words))
        if None in found:
            for i, c in enumerate(found):
                if c is None:
                    found[i] = c = self.word(SPACE + words[i])
                    if len(words[i]) <= LONGEST_KEPT:
                        if len(self.seen) >= MEMORY:
                            self.seen.clear()
                        self.seen[words[i]] = c
        return sum(found)


@cache
def token_counter(path: str) -> TokenCounter:
    """One in each worker process."""
    return TokenCounter(path)


def count_of(path: str) -> Callable[[Column], Column]:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = token_counter(path)
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens of the whole text.  Null and empty texts have 0; repeated rows repeat; other columns are not read."""
    return docs.select(F.col(id_col), count_of(path)(F.col(text_col)).alias("n_tokens"))
