"""Bounded table from a word to the bytes of its ids, kept by a Python worker between batches and tasks."""
from __future__ import annotations

from collections.abc import Callable

LONG = 128


class Pieces:
    """``encode`` maps a list of words to a dict of their id bytes. At ``limit`` words the older half goes; a word that was looked up
    since is in the younger half. Words over LONG characters are not kept."""

    def __init__(self, encode: Callable[[list[str]], dict], limit: int = 400_000):
        self.encode, self.limit, self.table, self.old = encode, limit, {}, {}

    def _fill(self, words: set[str]) -> set[str]:
        """Puts all of ``words`` into the table; returns those that had to be encoded."""
        if len(self.table) > self.limit // 2:
            self.old, self.table = self.table, {}
        table, old = self.table, self.old
        new = words.difference(table)
        if old:
            known = [w for w in new if w in old]  # the older half may be far larger than what is new
            table.update(zip(known, map(old.__getitem__, known)))
            new.difference_update(known)
        if new:
            table.update(self.encode(list(new)))
        return new

    def _forget(self, new: set[str]) -> None:
        for word in new:
            if len(word) > LONG:
                del self.table[word]

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """Id bytes of each list of words."""
        new = self._fill(set().union(*texts))
        out = [b"".join(map(self.table.__getitem__, t)) for t in texts]
        self._forget(new)
        return out

    def each(self, words: list[str]) -> list[bytes]:
        """Id bytes of each word."""
        new = self._fill(set(words))
        out = list(map(self.table.__getitem__, words))
        self._forget(new)
        return out
