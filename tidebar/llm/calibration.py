"""Isotonic calibration over binned scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores are summed in this many equal bins between the bounds, which bounds what reaches the driver.
BINS = 4000


def isotonic(scored: DataFrame, score: str, label: str, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of a non-decreasing fit of ``label`` on ``score``.

    Pool-adjacent-violators over the bins; each block gives its two ends, and
    scores between blocks are interpolated.  No rows give a flat 0.5.
    """
    step = (high - low) / BINS
    at = F.least(F.greatest(F.floor((F.col(score) - low) / step), F.lit(0)), F.lit(BINS))
    rows = scored.groupBy(at.alias("bin")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")).orderBy("bin").collect()  # BINS + 1 rows at most
    blocks: list[list[float]] = []
    for r in rows:
        blocks.append([r["y"], r["n"], r["lo"], r["hi"]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2], hi]
    if not blocks:
        return np.array([low, high]), np.array([0.5, 0.5])
    x = np.array([v for b in blocks for v in (b[2], b[3])], dtype=float)
    # half a case on either side keeps small blocks off certainty; the maximum keeps the order
    y = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)]))
    return x, y


def calibrated(scores: np.ndarray, knots: tuple[np.ndarray, np.ndarray], low: float, high: float) -> np.ndarray:
    """Probabilities in [0, 1]; a thousandth of the raw score keeps the order inside flat blocks."""
    x, y = knots
    tie = np.clip((scores - low) / (high - low), 0, 1)
    return np.clip(0.999 * np.interp(scores, x, y) + 0.001 * tie, 0, 1)
