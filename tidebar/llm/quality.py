"""Quality scores: random Fourier features over document statistics.

Sixteen statistics of the whole text are measured where it is read.  A Gaussian
kernel over them is approximated by random Fourier features; the normal
equations of the ridge fit are summed within partitions and then over them, so
only a features-by-features matrix reaches the driver; isotonic regression on
rows kept out of the fit turns ridge scores into probabilities.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1,
at most ``MAX_LABELLED`` of them, chosen by a hash of the id.

Defined cases: a null text is measured as an empty one; a null doc_id is scored
and counts as not held out; rows without labels are only scored; with no usable
label every score is exactly 0.5, which the filtering stage keeps; repeated rows
are scored each.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import calibrated, isotonic
from .common import held_out, table
from .scratch import settle

#: The model's parameters.
MAX_LABELLED = 200_000
FEATURES = 256
RIDGE = 1e-3
SEED = 7
LOW, HIGH = -0.5, 1.5

STATISTICS = [
    "log_words", "log_bytes", "word_length", "upper", "digits", "symbols", "exclaims", "bars",
    "stops", "non_ascii", "spaces", "log_lines", "distinct_words", "top_word", "distinct_lines", "long_words",
]


def _byte_class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=np.float64)
    mask[list(chars)] = 1
    return mask


_CLASSES = np.stack(
    [
        _byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _byte_class(b"0123456789"),
        _byte_class(b"#$%&*+/<=>@\\^_`{}~[]()"),
        _byte_class(b"!"),
        _byte_class(b"|"),
        _byte_class(b".,;:?"),
        _byte_class(bytes(range(128, 256))),
        _byte_class(b" \t\n\r\x0b\x0c"),
    ],
    axis=1,
)


def statistics(text: str | None) -> list[float]:
    """The sixteen statistics of a whole text, in the order of ``STATISTICS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    upper, digits, symbols, exclaims, bars, stops, high, spaces = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    counts = Counter(words)
    nw = max(1, len(words))
    return [
        math.log1p(len(words)), math.log1p(len(raw)), (len(raw) - spaces * n) / nw, upper, digits, symbols, exclaims, bars,
        stops, high, spaces, math.log1p(len(lines)), len(counts) / nw, max(counts.values(), default=0) / nw, len(set(lines)) / max(1, len(lines)), sum(c for w, c in counts.items() if len(w) > 14) / nw,
    ]


def _measure(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for k in range(0, len(ids), 1000):
            rows = [statistics(t) for t in texts.slice(k, 1000).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids.slice(k, 1000), pa.array(rows, type=pa.list_(pa.float64()))], names=["doc_id", "x"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, "doc_id long, x array<double>")


def labelled(stats: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows to learn from: (doc_id, x, y), none of them held out; of several texts of one id that of the least statistics."""
    y = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.filter(~held_out())
    n = y.count()
    if n > MAX_LABELLED:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * MAX_LABELLED // n)
    return stats.join(y, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y"))


class Model:
    """Standardisation, Fourier directions, ridge weights and calibration knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED, features: int = FEATURES):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / math.sqrt(d), (d, features))
        self.phases = rng.uniform(0, 2 * math.pi, features)
        self.weights = np.zeros(features + 1)
        self.fitted = False
        self.knots = np.array([LOW, HIGH]), np.array([0.5, 0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([math.sqrt(2 / len(self.phases)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        return calibrated(self.raw(x), self.knots, LOW, HIGH)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _summed(parts: DataFrame) -> np.ndarray:
    """Sums by index of what partitions emit as (i, v)."""
    rows = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # as many as the model has entries
    return np.array([r["v"] for r in rows])


def fit(train: DataFrame) -> Model:
    """Fit on settled rows (doc_id, x, y); every fifth by hash only calibrates."""
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    d = len(STATISTICS)

    def moments(batches):
        s = np.zeros(2 * d + 1)
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["x"])
                s += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield pd.DataFrame({"i": np.arange(2 * d + 1), "v": s})

    sums = _summed(train.filter(~calibrates).mapInPandas(moments, "i int, v double"))
    n = sums[-1] if len(sums) else 0
    if n == 0:
        return Model(np.zeros(d), np.ones(d))
    mean = sums[:d] / n
    scale = np.sqrt(np.maximum(sums[d : 2 * d] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    width = FEATURES + 1

    def equations(batches):
        gram = np.zeros((width, width + 1))
        for pdf in batches:
            if len(pdf):
                z = model.lift(_matrix(pdf["x"]))
                gram += z.T @ np.hstack([z, pdf[["y"]].to_numpy(np.float64)])
        yield pd.DataFrame({"i": np.arange(gram.size), "v": gram.ravel()})

    gram = _summed(train.filter(~calibrates).mapInPandas(equations, "i int, v double")).reshape(width, width + 1)
    model.weights = np.linalg.solve(gram[:, :-1] + RIDGE * n / width * np.eye(width), gram[:, -1])
    model.fitted = True

    def raw(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"s": model.raw(_matrix(pdf["x"])), "y": pdf["y"]})

    model.knots = isotonic(train.filter(calibrates).mapInPandas(raw, "s double, y int"), "s", "y", LOW, HIGH)
    return model


def apply(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every measured row."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(x)) if len(x) else [])

    return stats.select("doc_id", score("x").alias("score"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = settle(measure(docs))
    model = fit(settle(labelled(stats, labels, "quality")))
    return apply(stats, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts good; it is fitted on the labelled ones among them.

    Scored where they are read: no text is shuffled for it.
    """
    y = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    n = y.count()
    share = min(1.0, 2 * MAX_LABELLED / max(1, n))
    ids = settle(y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * share).select("doc_id").distinct())
    ids = F.broadcast(ids) if ids.count() <= 4 * MAX_LABELLED else ids  # a sample of about 2 * MAX_LABELLED ids, counted
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    model = fit(settle(labelled(settle(measure(some)), y, "quality")))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in text]).reshape(len(text), -1)) if len(text) else [])

    return docs.filter(score(F.col("text").cast("string")) >= 0.5)


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
