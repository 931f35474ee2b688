"""Ids of text pieces that recur: each distinct piece is encoded once and then looked up.

The encoder gives the ids of a list of pieces, one after the other, and the number of ids of each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class _Known(dict):
    """Numbers pieces in the order in which they are first asked for; ``new`` lists those without ids as yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece):
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Interned:
    """Keeps the ids of known pieces in flat arrays; beyond ``most`` pieces or ``most_chars`` letters the third used most stays."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, most_chars: int = 16_000_000):
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self.known = _Known()
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = self.chars = 0

    def _shrink(self):
        names = list(self.known)
        n = len(names)
        stay = np.sort(np.argsort(-self.hits[:n], kind="stable")[: self.most // 3])
        budget = np.cumsum([len(names[i]) for i in stay.tolist()])
        stay = stay[: int(np.searchsorted(budget, self.most_chars // 3, "right"))]
        self.known = _Known()
        self.known.update((names[i], k) for k, i in enumerate(stay.tolist()))
        sizes, starts = self.sizes[stay], self.starts[stay]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.flat[: len(flat)] = flat
        self.used, self.chars = len(flat), int(budget[len(stay) - 1]) if len(stay) else 0
        hits = self.hits[stay] // 2
        self.starts[:], self.sizes[:], self.hits[:] = 0, 0, 0
        self.starts[: len(stay)], self.sizes[: len(stay)], self.hits[: len(stay)] = ends - sizes, sizes, hits

    def _learn(self) -> None:
        n = len(self.known) - len(self.known.new)
        for at in range(0, len(self.known.new), 1 << 17):
            part = self.known.new[at : at + (1 << 17)]
            flat, sizes = self.encode(part)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(part) > len(self.starts):
                self.starts, self.sizes, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.hits))
            self.flat[self.used : self.used + len(flat)] = flat
            self.sizes[n : n + len(part)] = sizes
            self.starts[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            self.chars += sum(map(len, part))
            n += len(part)
        self.known.new = []

    def ids(self, pieces: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are ``counts`` pieces long each, one after the other, and the number of ids of each text."""
        if len(self.known) > self.most or self.chars > self.most_chars:
            self._shrink()
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.known.new:
            self._learn()
        n = len(self.known)
        self.hits[:n] += np.bincount(which, minlength=n)
        sizes, starts = self.sizes[which], self.starts[which]
        ends = np.cumsum(sizes)
        out = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        sums = np.concatenate([[0], ends]).astype(np.int64)
        upto = np.cumsum(np.array(counts, np.int64))
        return out, sums[upto] - sums[upto - np.array(counts, np.int64)]
