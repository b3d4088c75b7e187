"""Matching blocks of two texts (Ratcliff and Obershelp), with a suffix automaton for the longest common block.

The ratio is twice the letters in matching blocks over the letters of both.  The longest common
block comes first, the earliest in the first text and then in the second, and so on to its left
and to its right.  In a second text of 200 letters or more, letters that make up more than a
hundredth of it start no block; a block that is found goes on over them.  So in long
texts only rare letters, and few places, are looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

LONG, SHARE = 200, 100


class _Automaton:
    """The substrings of runs of letters, each state with the first place where its substrings end."""

    __slots__ = ("next", "link", "size", "first", "last")

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        self.last = 0

    def _state(self, size: int, first: int, moves: dict[str, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, c: str) -> int:
        """The state behind p by c, of the length of p and one: it or a copy."""
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, c: str, at: int, goes_on: bool) -> None:
        """The letter at this place; it goes on a run or starts one."""
        p = self.last if goes_on else 0
        if c in self.next[p]:
            self.last = self._split(p, c)
            return
        new = self._state(self.size[p] + 1, at, {}, 0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        self.last = new


def _longest(a: str, b: str, in_a: list[int], in_b: list[int]) -> tuple[int, int, int]:
    """Starts and length of the longest common block over these places, ascending; length 0 if there is none."""
    automaton, before = _Automaton(), -2
    for j in in_b:
        automaton.add(b[j], j, j == before + 1)
        before = j
    moves, link, size, first = automaton.next, automaton.link, automaton.size, automaton.first
    best = (0, 0, 0)
    state, length, before = 0, 0, -2
    for i in in_a:
        if i != before + 1:
            state, length = 0, 0
        before, c = i, a[i]
        while state and c not in moves[state]:
            state = link[state]
            length = size[state]
        if c in moves[state]:
            state, length = moves[state][c], length + 1
            if length > best[2]:
                best = (i - length + 1, first[state] - length + 1, length)
    return best


def matched_letters(a: str, b: str) -> int:
    """Letters of a in matching blocks."""
    counts = Counter(b)
    popular = {c for c, n in counts.items() if n > len(b) // SHARE + 1} if len(b) >= LONG else ()
    rare = counts.keys() - popular
    shared = rare & set(a)
    in_a, in_b = ([i for i, c in enumerate(x) if c in shared] for x in (a, b))
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        here_a = in_a[bisect_left(in_a, alo) : bisect_left(in_a, ahi)]
        here_b = in_b[bisect_left(in_b, blo) : bisect_left(in_b, bhi)] if here_a else []
        i, j, n = _longest(a, b, here_a, here_b) if here_b else (0, 0, 0)
        if not n:
            i, j = alo, blo
        # On over letters that start no block.
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            if i > alo and j > blo:
                todo.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                todo.append((i + n, ahi, j + n, bhi))
    return total


def ratio(a: str, b: str) -> float:
    both = len(a) + len(b)
    return 2.0 * matched_letters(a, b) / both if both else 1.0


def most_ratio(a: str, b: str) -> float:
    """What the ratio is at most, by the letters that both texts have."""
    both = len(a) + len(b)
    return 2.0 * (Counter(a) & Counter(b)).total() / both if both else 1.0
