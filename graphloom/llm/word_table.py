"""Words by number with their token ids, as a worker keeps them from task to task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Numbers(dict):
    """Numbers words as they come; new: those that have no ids yet."""

    def __init__(self, words=()):
        super().__init__((w, i) for i, w in enumerate(words))
        self.new: list = []

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def in_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of n words from (words, ids, lengths) of some of them each."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    which, flat, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts, size, begin = np.cumsum(lengths) - lengths, np.zeros(n, np.int64), np.zeros(n, np.int64)
    size[which], begin[which] = lengths, starts
    return gather(flat, begin, size), size


class WordTable:
    """Words, their numbers and their ids. encode: (ids, lengths) of a list of words. Beyond `limit` words, those come out that were
    met once or twice, or all if that does not halve it, so memory is bounded and frequent words stay."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit, self.numbers = encode, limit, Numbers()
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def make_room(self) -> bool:
        """Drop words if there are too many; numbers given before are void then."""
        n = len(self.numbers)
        if n < self.limit:
            return False
        keep = np.flatnonzero(self.met[:n] > 2)
        keep = keep if len(keep) <= self.limit // 2 else keep[:0]
        words = list(self.numbers)
        self.numbers = Numbers([words[i] for i in keep.tolist()])
        ids, lengths, met = gather(self.ids, self.starts[keep], self.lengths[keep]), self.lengths[keep], self.met[keep]
        self.used = 0
        self.add(ids, lengths, 0)
        self.met[: len(keep)], self.met[len(keep) :] = met, 0
        return True

    def add(self, ids: np.ndarray, lengths: np.ndarray, at: int) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while at + len(lengths) > len(self.starts):
            self.starts, self.lengths, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[at : at + len(lengths)] = lengths
        self.starts[at : at + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)

    def settle(self, drafts: list[np.ndarray]) -> None:
        """Give the new words their ids, and count the words (numbers) of the drafts."""
        new = self.numbers.new
        if new:
            ids, lengths = self.encode(new)
            self.add(ids, lengths, len(self.numbers) - len(new))
            self.numbers.new = []
        if drafts:
            met = np.bincount(np.concatenate(drafts), minlength=len(self.numbers))
            self.met[: len(met)] += met

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        return gather(self.ids, self.starts[numbers], self.lengths[numbers])
