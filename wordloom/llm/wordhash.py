"""Words of many texts at once, as numpy arrays: where they begin and end, and 64-bit hashes of them.

A word's hash is made of two polynomials over tables of random octet values, each taken from a running sum over
the whole buffer and so independent of where the word stands; there is no loop over words.  ``Table`` maps
such hashes to numbers by open addressing, for arrays of questions at once."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ROOTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_rng = np.random.default_rng(20240)
_OCTETS = [np.where(_BLANK, np.uint64(0), _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)) for _ in _ROOTS]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
PART = 1 << 20


def _powers(i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root and of its inverse, up to the n-th at least."""
    have = _POWERS.get(i)
    if have is None or len(have[0]) < n:
        size = max(n, PART + 1)
        root = int(_ROOTS[i])
        steps = [np.full(size, root, dtype=np.uint64), np.full(size, pow(root, -1, 1 << 64), dtype=np.uint64)]
        for s in steps:
            s[0] = 1
            np.multiply.accumulate(s, out=s)
        have = steps[0], steps[1]
        if size <= 8 * PART:
            _POWERS[i] = have
    return have


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _hash(part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begin), dtype=np.uint64)
    for i, octets in enumerate(_OCTETS):
        up, down = _powers(i, len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(octets[part] * up[: len(part)], out=sums[1:])
        out = _mix(out + (sums[end] - sums[begin]) * down[begin])
    return out.view(np.int64)


class Batch:
    """Words of texts, ASCII letters lower-cased: ``begin`` and ``end`` in ``buffer``, ``hash``, and ``count`` by text."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.buffer = (b"\n".join(texts) + b"\n").lower()
        octets = np.frombuffer(self.buffer, dtype=np.uint8)
        blank = _BLANK[octets]
        edge = np.empty(len(blank), dtype=bool)
        edge[0] = not blank[0]
        np.not_equal(blank[1:], blank[:-1], out=edge[1:])
        at = np.flatnonzero(edge)  # the buffer ends with a blank: begins and ends alternate
        self.begin, self.end = at[::2], at[1::2]
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        first = np.searchsorted(self.begin, np.cumsum(length) - length)
        self.count = np.diff(np.append(first, len(self.begin)))
        # parts of about PART octets, cut between words
        hashes, done = [], 0
        while done < len(self.begin):
            low = int(self.begin[done])
            upto = max(done + 1, int(np.searchsorted(self.end, low + PART, side="right")))
            high = int(self.end[upto - 1])
            hashes.append(_hash(octets[low:high], self.begin[done:upto] - low, self.end[done:upto] - low))
            done = upto
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.int64)
        self.octets = octets

    def words(self, which: np.ndarray) -> list[bytes]:
        b = self.buffer
        return [b[i:j] for i, j in zip(self.begin[which].tolist(), self.end[which].tolist(), strict=True)]

    def last(self, n: int) -> np.ndarray:
        """The last n octets of each word as one number; 0 for what a short word lacks."""
        out = np.zeros(len(self.begin), dtype=np.int64)
        for k in range(1, n + 1):
            at = self.end - k
            out = out * 256 + np.where(at >= self.begin, self.octets[np.maximum(at, 0)], 0)
        return out


class Table:
    """Hash to number, -1 for what is not there."""

    def __init__(self, capacity: int = 1 << 16):
        self.bits = max(4, int(capacity - 1).bit_length() + 1)
        self.keys, self.values, self.size = np.zeros(1 << self.bits, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int64), 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        slot = self._slot(h)
        out = self.values[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.keys) - 1)
            v, same = self.values[slot], self.keys[slot] == h[todo]
            out[todo] = v
            more = (v >= 0) & ~same
            todo, slot = todo[more], slot[more]
        return out

    def put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """New hashes, each once."""
        if 2 * (self.size + len(h)) > len(self.keys):
            full = self.values >= 0
            old = self.keys[full], self.values[full]
            self.__init__(2 * (self.size + len(h)))
            self.put(*old)
        slot, todo = self._slot(h), np.arange(len(h))
        while len(todo):
            free = self.values[slot] < 0
            # of those that want one free slot, the last to be written has it
            self.values[slot[free]] = numbers[todo[free]]
            self.keys[slot[free]] = h[todo[free]]
            lost = ~(free & (self.keys[slot] == h[todo]))
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.keys) - 1)
        self.size += len(h)
