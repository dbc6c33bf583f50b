"""Vectorised hashing of words, shingles and byte windows with numpy."""

from __future__ import annotations

import numpy as np

_MULT = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit integers."""
    z = z ^ (z >> _U(30))
    z = z * _U(0xBF58476D1CE4E5B9)
    z = z ^ (z >> _U(27))
    z = z * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up, self.down = self._grown(1 << 12)

    @staticmethod
    def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
        def powers(base: int) -> np.ndarray:
            steps = np.full(n, base, dtype=_U)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = self._grown(max(n, 2 * len(self.up)))
        return self.up[:n], self.down[:n]


_POWERS: list[Powers] = []
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_MULT))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of bytes (one longer than ``raw``) and the inverse powers."""
    if not _POWERS:
        _POWERS.append(Powers())
    up, down = _POWERS[0].to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum(_BYTES[raw] * up[:-1], out=sums[1:])
    return sums, down


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words between white space (bytes 9-13 and 32)."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=_U)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[b]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    sums, down = prefix_sums(b)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.

    A-Z are lower-cased, other letters stay.  With fewer than ``width`` words
    the whole sequence is one shingle; without words the set is empty.
    """
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    z = np.full(n, min(width, len(w)), dtype=_U)
    for k in range(min(width, len(w))):
        z = mix(z * _U(_MULT) + w[k : k + n])
    return np.unique(z)
