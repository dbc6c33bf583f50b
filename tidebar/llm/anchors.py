"""Content-defined anchors: equal windows of bytes share an anchor, wherever they stand."""

from __future__ import annotations

import numpy as np

from .hashing import mix, prefix_sums

GRAM = 32
_U = np.uint64


def _sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over every full window of w values, in two passes over blocks of w."""
    count = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, fill, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:count], ahead[w - 1 : w - 1 + count])


def anchors(raw: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the grams that are least in some window of ``length`` bytes.

    Every window of that length contains at least one anchor, and equal windows
    contain equal anchors at equal places: the least gram of either.
    """
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    sums, down = prefix_sums(raw)
    g = mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    w = length - gram + 1
    least = _sliding(g, w, np.minimum, ~_U(0))
    spread = np.zeros(len(least) + 2 * (w - 1), dtype=_U)
    spread[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(spread, w, np.maximum, _U(0)) == g)
    return at, g[at]
