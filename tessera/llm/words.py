"""Token ids of whole texts by way of their words.

The vocabularies used here never join characters across white space, so a text's ids are its words' ids in a row. Each task keeps the
words it has met lately in two generations of bounded size, and the public tokenizer encodes only those in neither.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np

#: The ids of each word, as lists or as (all in a row, how many each has).
Encoder = Callable[[list], Sequence[Sequence[int]] | tuple[np.ndarray, np.ndarray]]


class _Generation:
    """Words by number, and the ids of each."""

    def __init__(self):
        self.known: dict = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list, flat: np.ndarray, size: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.used += len(flat)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        at = np.repeat(self.at[numbers] - (np.cumsum(size) - size), size)
        return self.flat[at + np.arange(len(at))], size


class WordIds:
    """When a generation has its most words it becomes the old one; words of the old one that are met again move to the new."""

    def __init__(self, encode: Encoder, most: int = 300_000, step: int = 20_000):
        self.encode, self.most, self.step = encode, most, step
        self.new, self.old = _Generation(), _Generation()

    def _encoded(self, words: list) -> None:
        for lo in range(0, len(words), self.step):
            part = words[lo : lo + self.step]
            ids = self.encode(part)
            if not isinstance(ids, tuple):
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                ids = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), size
            self.new.add(part, *ids)

    def numbers(self, words: list) -> np.ndarray:
        """A number for each word, equal words alike; they hold until the next call."""
        if len(self.new.known) > self.most:
            self.new, self.old = _Generation(), self.new
        return self._numbers(words, self._encoded)

    def _numbers(self, words: list, add: Callable[[list], None]) -> np.ndarray:
        out = self.new.numbers(words)
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            wanted = [words[i] for i in missing]
            other = list(dict.fromkeys(wanted))
            before = self.old.numbers(other)
            if (had := before >= 0).any():
                self.new.add([w for w, h in zip(other, had.tolist(), strict=True) if h], *self.old.ids(before[had]))
                other = [w for w, h in zip(other, had.tolist(), strict=True) if not h]
            if other:
                add(other)
            out[missing] = self.new.numbers(wanted)
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each word has."""
        return self.new.ids(numbers)
