"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
#: A random value for each byte, and odd multipliers: fixed by the seed, so equal in all workers.
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 500_000)
            cls.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, _BASE))])
            cls.down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, _INVERSE))])


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text; A-Z count as a-z, words end at ASCII space.

    A text with fewer words has one shingle, of all its words; one without words has none.
    """
    return [s for a, b in bounded(texts) for s in _some(texts[a:b], words)]


def bounded(texts: list[bytes], most: int = 400_000):
    """Stretches ``(start, stop)`` of the texts with at most so many bytes, or of one longer text."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < most):
            size += len(texts[stop]) + 1
            stop += 1
        yield start, stop
        start = stop


class Words:
    """The words of many UTF-8 texts: where they begin and end in ``data``, the texts behind each other with a
    line feed after each, and their hashes. ``at`` has the first word of each text, and the end of the last."""

    def __init__(self, texts: list[bytes]):
        self.data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        space = _SPACE[self.data]
        before = np.concatenate([[True], space[:-1]])
        self.first = np.flatnonzero(~space & before)
        self.last = np.flatnonzero(space & ~before)
        _Powers.upto(len(self.data) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[self.data] * _Powers.up[: len(self.data)])])
        self.hashes = mix((total[self.last] - total[self.first]) * _Powers.down[self.first] + (self.last - self.first).astype(np.uint64))
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.at = np.searchsorted(self.first, self.offsets)
        self._sums = None

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the words from ``a`` to before ``b``."""
        if self._sums is None:
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * _Powers.up[: len(self.hashes)])])
        return mix((self._sums[b] - self._sums[a]) * _Powers.down[a] + (b - a).astype(np.uint64) * _PLACE[50])


def _some(texts: list[bytes], words: int) -> list[np.ndarray]:
    found = Words(texts)
    word, at = found.hashes, found.at
    if len(word) >= words:
        run = word[: len(word) - words + 1] * _PLACE[0]
        for k in range(1, words):
            run = run + mix(word[k : len(word) - words + 1 + k] + _PLACE[k]) * _PLACE[k]
        run = mix(run)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = mix(np.array([(int(h) * 0x9E3779B97F4A7C15 + int(w)) & (2**64 - 1)], np.uint64))[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    a = int(mix(s ^ _PLACE[40]).sum(dtype=np.uint64)) if len(s) else 0
    b = int(mix(s ^ _PLACE[41]).sum(dtype=np.uint64)) if len(s) else 0
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)
