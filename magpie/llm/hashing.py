"""Hashes of byte ranges, words and whole texts (numpy).

* ``Modular`` gives the hash of any byte range of a text in constant time: polynomials modulo the
  prime 2**61 - 1, so two different ranges of n bytes collide for at most n of the 2**61 multipliers,
  whatever their structure. Two multipliers together decide whether windows are equal.
* ``rolling`` hashes all windows of one size modulo 2**64. It is faster, but texts of a regular
  structure can collide, so it only nominates candidates.
* ``digest`` is BLAKE2b, for whole texts and sets.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_M = (1 << 64) - 1
P61 = (1 << 61) - 1
_P, _M30, _M31, _M32 = (np.uint64(x) for x in (P61, (1 << 30) - 1, (1 << 31) - 1, (1 << 32) - 1))
_S29, _S30, _S31, _S32, _S61 = (np.uint64(x) for x in (29, 30, 31, 32, 61))
#: Ranges of that many bytes or more are hashed by BLAKE2b; texts are taken in segments of so many.
LONGEST = 1 << 20


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a x b modulo 2**61 - 1, of numbers below it."""
    a0, a1, b0, b1 = a & _M31, a >> _S31, b & _M31, b >> _S31
    low, mid = a0 * b0, a1 * b0 + a0 * b1
    # 2**62 is 2, and 2**61 is 1
    return _reduce(((a1 * b1) << np.uint64(1)) + (mid >> _S30) + ((mid & _M30) << _S31) + (low & _P) + (low >> _S61))


class Powers:
    """The powers of one multiplier (lower and upper 32 bits) and of its inverse, as many as were needed so far."""

    def __init__(self, seed: int):
        r = int(np.random.default_rng(seed).integers(1 << 59, P61))
        self.bases = (r, pow(r, -1, P61))
        self.low, self.high, self.down = np.ones(1, np.uint32), np.zeros(1, np.uint32), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.low) <= n:
            m = len(self.low)
            up, down = (np.uint64(pow(base, m, P61)) for base in self.bases)
            more = times(self.low.astype(np.uint64) | (self.high.astype(np.uint64) << _S32), up)
            self.low = np.concatenate([self.low, (more & _M32).astype(np.uint32)])
            self.high = np.concatenate([self.high, (more >> _S32).astype(np.uint32)])
            self.down = np.concatenate([self.down, times(self.down, down)])


POWERS = (Powers(1201), Powers(3307))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Modular:
    """Hashes of byte ranges of one text under one multiplier, from prefix sums of the lower 32 bits of its powers and of the upper ones.

    The sums may overflow; the difference over a range is exact, since it stays below 2**64. Texts
    are taken in segments, so that the powers and sums of very long ones stay bounded.
    """

    def __init__(self, data: np.ndarray, family: int = 0):
        self.data, self.p = data, POWERS[family]
        self.at, self.sums = -1, (data, data)

    def _segment(self, k: int) -> None:
        """Prefix sums of the k-th segment and the one after it, in which its ranges end."""
        if self.at != k:
            x = self.data[k * LONGEST : (k + 2) * LONGEST].astype(np.uint64) + np.uint64(1)
            n = len(x)
            self.p.grow(n)
            self.at, self.sums = k, (np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64))
            np.cumsum(x * self.p.low[:n], out=self.sums[0][1:])
            np.cumsum(x * self.p.high[:n], out=self.sums[1][1:])

    def _ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (_reduce(x[end] - x[start]) for x in self.sums)
        whole = _reduce((((high << _S32) & _P) | (high >> _S29)) + low)
        return mix(times(whole, self.p.down[start]))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.data) <= 2 * LONGEST and (not len(start) or int((end - start).max()) < LONGEST):
            self._segment(0)
            return self._ranges(start, end)
        out = np.zeros(len(start), np.uint64)
        long = end - start >= LONGEST
        for k in np.unique(start[~long] // LONGEST):
            mine = np.flatnonzero(~long & (start // LONGEST == k))
            self._segment(int(k))
            out[mine] = self._ranges(start[mine] - k * LONGEST, end[mine] - k * LONGEST)
        for k in np.flatnonzero(long):
            out[k] = digest(self.data[start[k] : end[k]].tobytes())[0]
        return out


_BYTES = np.random.default_rng(911).integers(0, _M, 256, dtype=np.uint64, endpoint=True)
_ODD = 0x9E3779B97F4A7C15
_TABLES = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all byte windows of one size (at most ``LONGEST``), to nominate candidates."""
    need = min(len(data), LONGEST + size)
    if len(_TABLES[0]) < need:
        _TABLES[:] = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(need, 1 << 17), x, np.uint64)]), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    up, down = _TABLES
    parts = []
    for a in range(0, max(len(data) - size + 1, 0), LONGEST):
        x = data[a : a + LONGEST + size - 1]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTES[x] * up[: len(x)], out=sums[1:])
        n = len(x) - size + 1
        parts.append(mix((sums[size:] - sums[:n]) * down[:n]))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def digest(data: bytes) -> tuple[int, int]:
    """128 bits of BLAKE2b, as two numbers."""
    x = blake2b(data, digest_size=16).digest()
    return int.from_bytes(x[:8], "little"), int.from_bytes(x[8:], "little")


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, joined by one space, with their byte ranges."""

    def __init__(self, text: bytes):
        self.text = b" ".join(text.split())
        self.data = np.frombuffer(self.text, np.uint8)
        if self.text:
            gaps = np.flatnonzero(self.data == 32)
            self.start = np.concatenate([np.zeros(1, np.int64), gaps + 1])
            self.end = np.append(gaps, len(self.data))
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.n = len(self.start)

    def windows(self, size: int, family: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of so many words, all or those that start at the words given."""
        if self.n < size:
            return np.zeros(0, np.uint64)
        if at is None:
            at = np.arange(self.n - size + 1)
        return Modular(self.data, family).ranges(self.start[at], self.end[at + size - 1])


def covered(n: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of n positions the ranges [start, start + size) cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, np.minimum(start + size, n), -1)
    return np.cumsum(steps[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]
