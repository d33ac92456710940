"""Many texts as one array of code points, and hashes of their words."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chars:
    """``texts`` end to end: ``cp`` code points, ``starts`` offsets (one more than texts)."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=self.starts[1:])


def word_hash(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each of the ascending spans [start, end), none of which overlaps another.

    It is the sum of a mixed value of every (place in the span, character), so it doesn't depend on where the span
    stands, and has none of the collisions that polynomials modulo 2**64 have on self-similar words.
    """
    place = np.arange(len(cp), dtype=np.int64)
    first = np.zeros(len(cp), np.int64)
    first[start] = start
    place -= np.maximum.accumulate(first)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(mix((place.view(np.uint64) << np.uint64(21)) | cp), out=total[1:])
    return mix(total[end] - total[start] + (end - start).astype(np.uint64))


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``rows`` of a ragged array, end to end, and the number of values of each."""
    count = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - (ends - count), count)
    return values[at], count


class Kept:
    """A bounded memory of ids by hash, in sorted arrays: what a batch uses is always held, the rest goes when full."""

    def __init__(self, rows: int, ids: int, extra: int = 0):
        self.most, self.most_ids, self.extra = rows, ids, extra
        self._clear()

    def _clear(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.values = np.zeros((self.extra, 0), np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it isn't held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.row[at], -1)

    def rows(self, keys: np.ndarray, make) -> np.ndarray:
        """Rows of the distinct ``keys``; ``make`` gets the places of those not held and gives (ids, count of each, extra values)."""
        at = self.find(keys)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        ids, count, *values = make(new)
        if len(self.keys) + len(new) > self.most or len(self.ids) + len(ids) > self.most_ids:
            held = np.flatnonzero(at >= 0)
            old, each = ragged(self.ids, self.offsets, at[held])
            kept = self.values[:, at[held]]
            self._clear()
            self._add(keys[held], old, each, kept)
        self._add(keys[new], ids, count, np.array(values, np.int64).reshape(self.extra, len(new)))
        return self.find(keys)

    def _add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        row = len(self.offsets) - 1 + order
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.row = np.insert(self.keys, at, keys[order]), np.insert(self.row, at, row)
        self.ids = np.concatenate((self.ids, ids.astype(np.int32, copy=False)))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(count)))
        self.values = np.concatenate((self.values, values), axis=1)
