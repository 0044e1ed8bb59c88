"""Runs of characters as arrays: numbers of many words at once, and tables that remember them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

LONG_RUN = 64
_MULT = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            x = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def hashes(cp: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run ``cp[at:stop]``; different runs may share one."""
    n = len(cp)
    up, down = _grown(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[stop] - total[at]) * down[at]
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(stop - at > LONG_RUN).tolist():
        h[i] = xxhash.xxh64_intdigest(cp[at[i] : stop[i]].tobytes(), 1)
    return h


class Known:
    """Words met so far, each with its number in the order in which it was met.

    Words are found by their hashes and then compared letter by letter, since
    different words may share a hash; those that do are kept by their letters.
    """

    def __init__(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.letters, self.used = np.zeros(1 << 16, "<u4"), 0
        self.others: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.start)

    def _add(self, keys: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.places = np.insert(self.keys, at, keys[order]), np.insert(self.places, at, len(self) + order)

    def _hold(self, cp: np.ndarray, at: np.ndarray, stop: np.ndarray) -> None:
        size = stop - at
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(size) else 0
        if self.used + total > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(max(len(self.letters), total), "<u4")])
        self.letters[self.used : self.used + total] = cp[_places(at, size)]
        self.start, self.size = np.append(self.start, self.used + upto - size), np.append(self.size, size)
        self.used += total

    def _differ(self, number: np.ndarray, cp: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which runs aren't the word of their number."""
        size = stop - at
        bad = size != self.size[number]
        same = np.flatnonzero(~bad)
        size = size[same]
        unequal = np.flatnonzero(cp[_places(at[same], size)] != self.letters[_places(self.start[number[same]], size)])
        if len(unequal):
            bad[same[np.searchsorted(np.cumsum(size), unequal, side="right")]] = True
        return np.flatnonzero(bad)

    def numbers(self, cp: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each run ``cp[at:stop]``, and for those that are new, in order, which run has them."""
        number, new = self._by_hash(hashes(cp, at, stop))
        self._hold(cp, at[new], stop[new])
        more: list[int] = []
        for i in self._differ(number, cp, at, stop).tolist():
            word = cp[at[i] : stop[i]].tobytes()
            if word not in self.others:
                self.others[word] = len(self) + len(more)
                more.append(i)
            number[i] = self.others[word]
        if more:
            self._hold(cp, at[more], stop[more])
        return number, np.append(new, np.array(more, dtype=np.int64))

    def _by_hash(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, keys = pd.factorize(h)
        rising = np.argsort(keys)
        place = np.empty(len(keys), dtype=np.int64)
        place[rising] = np.searchsorted(self.keys, keys[rising])
        new = np.ones(len(keys), dtype=bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        example = np.zeros(0, dtype=np.int64)
        if new.any():
            first = np.empty(len(keys), dtype=np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            example = first[new]
            self._add(keys[new])
            place[rising] = np.searchsorted(self.keys, keys[rising])
        return self.places[place][code], example


def _places(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs that start ``at``."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(size) else 0) + np.repeat(at - (upto - size), size)
