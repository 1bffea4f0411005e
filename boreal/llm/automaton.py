"""A suffix automaton over sequences of any hashable symbols, with the first document of each state."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Accepts every substring of the sequences added. Add sequences in ascending order of document."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, link: int, first, follow: dict) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def _clone(self, p: int, symbol, q: int) -> int:
        """Split off the part of q that is reached from p by one symbol."""
        c = self._state(self.length[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, symbols: Sequence, document) -> None:
        last = 0
        for s in symbols:
            if (q := self.next[last].get(s)) is not None:  # an earlier sequence has it
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, s, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, document, {}), last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][s]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, s, q)
            last = new

    def windows(self, symbols: Sequence, n: int) -> list:
        """For each window of n symbols the first document that holds it, or None: matching statistics, cut at n."""
        state, length, out = 0, 0, [None] * max(0, len(symbols) - n + 1)
        for k, s in enumerate(symbols):
            while state and s not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if s in self.next[state]:
                state, length = self.next[state][s], length + 1
            if length >= n:
                while self.length[self.link[state]] >= n:  # a suffix of at least n symbols keeps matching
                    state = self.link[state]
                    length = self.length[state]
                out[k - n + 1] = self.first[state]
        return out
