"""Suffix automaton over word numbers, grown one word at a time."""

from __future__ import annotations


class SuffixAutomaton:
    """Accepts every run of consecutive words of the sequences fed to it.

    A state stands for runs that end at the same places; ``long`` is the length of the
    longest of them and ``link`` the state of the longest run that ends elsewhere too.
    A sequence starts with ``extend(0, word)``; ``extend`` returns the state of the
    sequence so far.
    """

    def __init__(self) -> None:
        self.next: dict[int, int] = {}
        self.long = [0]
        self.link = [-1]
        self.out: list[list[int]] = [[]]

    def _state(self, long: int, link: int) -> int:
        self.long.append(long)
        self.link.append(link)
        self.out.append([])
        return len(self.long) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """The state for ``word`` after ``state``, cut off from longer runs in ``to``."""
        if self.long[to] == self.long[state] + 1:
            return to
        short = self._state(self.long[state] + 1, self.link[to])
        self.out[short] = list(self.out[to])
        for w in self.out[to]:
            self.next[short << 32 | w] = self.next[to << 32 | w]
        self.link[to] = short
        while state >= 0 and self.next.get(state << 32 | word) == to:
            self.next[state << 32 | word] = short
            state = self.link[state]
        return short

    def extend(self, last: int, word: int) -> int:
        to = self.next.get(last << 32 | word)
        if to is not None:
            return self._split(last, word, to)
        new = self._state(self.long[last] + 1, 0)
        while last >= 0 and last << 32 | word not in self.next:
            self.next[last << 32 | word] = new
            self.out[last].append(word)
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.next[last << 32 | word])
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest run that ends with ``word`` after a match of ``length`` words."""
        to = self.next.get(state << 32 | word)
        while to is None and state:
            state = self.link[state]
            length = self.long[state]
            to = self.next.get(state << 32 | word)
        return (0, 0) if to is None else (to, length + 1)
