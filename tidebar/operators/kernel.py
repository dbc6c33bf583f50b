"""The one Python kernel: linear recursions along a symbol's bars.

Every recursion here is a chain of maps value -> a value + b, one for each bar
that has a source value.  Chains compose, so nothing has to walk bar by bar:

* inside a batch all prefixes of the chain are composed by doubling, in numpy;
* without ``stretch`` a symbol's bars come in order of time in batches and only
  the state of each series (its last value, the bars since then, how many it
  has seen) is carried on: one exchange by symbol, which the windows share;
* with ``stretch`` (a duration) every symbol is cut into stretches of time that
  many tasks hold.  Each sums up its part of the chain in a few numbers, the
  sums of a symbol are strung together in order, and each stretch starts from
  the state so found.  A symbol with all the bars there are is spread over as
  many tasks as it has stretches.

The percent rank over a sliding frame goes with them: what it hands on is the
frame's values but one, and an order-statistic structure (a skip list) makes its
cost independent of the frame's length.

All series that a job needs are asked for in one call.  With stretches a series
over another one (the signal line) waits for it: one such pass for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Series:
    """A series along a symbol's bars: out = kind(source, n).

    kinds: ``ema`` (weight 2/(n+1)), ``wilder`` (weight 1/n), ``vma`` (weight
    from column ``by``, first value as it is), ``macdv`` (100 (source - by) / over,
    which is no recursion itself).
    """

    out: str
    kind: str
    source: str
    n: int = 0
    by: str = ""
    over: str = ""


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps x -> a x + b, one after the other, composed from the first to each."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:] = a[d:] * b[:-d] + b[d:]
        a[d:] = a[d:] * a[:-d]
        d *= 2
    return a, b


class Recursion:
    """A mean that weighs each new value against the old mean and starts with the first value.

    ``alpha``: a fixed weight; over k missing bars the old mean weighs
    (1 - alpha)^(k + 1) against alpha, the mean stands on missing bars, and it
    is given from the n-th value on.  Without it each bar has a weight of its
    own (none is 0), and missing bars have no mean.
    """

    #: Numbers of a state: value, bars since, values seen.
    START = (np.nan, 0.0, 0.0)

    def __init__(self, alpha: float | None = None, n: int = 0):
        self.alpha, self.n = alpha, n

    def maps(self, gap, x, w):
        """(a, b) of a bar with ``gap`` missing bars before it."""
        if self.alpha is None:
            w = np.where(np.isnan(w), 0.0, w)
            return 1 - w, w * x
        old = (1 - self.alpha) ** (gap + 1)
        return old / (old + self.alpha), self.alpha * x / (old + self.alpha)

    def summary(self, x: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
        """Bars, missing bars before the first value, first value, its weight, the chain after it (a, b), values, missing bars after the last."""
        at = np.flatnonzero(~np.isnan(x))
        if not len(at):
            return len(x), len(x), 0.0, 0.0, 1.0, 0.0, 0.0, len(x)
        a, b = composed(*self.maps(np.diff(at) - 1.0, x[at[1:]], w[at[1:]]))
        return len(x), at[0], x[at[0]], w[at[0]], a[-1] if len(a) else 1.0, b[-1] if len(b) else 0.0, len(at), len(x) - 1 - at[-1]

    def joined(self, s, t) -> tuple[float, ...]:
        """Summary of two neighbours."""
        if not s[6]:
            return s[0] + t[0], s[0] + t[1], *t[2:]
        if not t[6]:
            return s[0] + t[0], *s[1:7], s[7] + t[0]
        a, b = self.maps(s[7] + t[1], t[2], t[3])
        return s[0] + t[0], *s[1:4], t[4] * a * s[4], t[4] * (a * s[5] + b) + t[5], s[6] + t[6], t[7]

    def after(self, state, s) -> tuple[float, ...]:
        """The state behind a stretch."""
        value, gap, seen = state
        if not s[6]:
            return value, gap + s[0] if seen else 0.0, seen
        a, b = self.maps(gap + s[1], s[2], s[3]) if seen else (0.0, s[2])
        first = a * value + b if seen else b
        return s[4] * first + s[5], s[7], seen + s[6]

    def __call__(self, state, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, tuple[float, ...]]:
        """The mean at every bar, and the state behind them."""
        value, gap, seen = state
        at = np.flatnonzero(~np.isnan(x))
        out = np.full(len(x), value if self.alpha is not None and seen else np.nan)
        if not len(at):
            return (np.where(seen >= self.n, out, np.nan), (value, gap + len(x) if seen else 0.0, seen))
        a, b = self.maps(np.diff(at, prepend=-1 - gap) - 1.0, x[at], w[at])
        if not seen:
            a[0], b[0] = 0.0, x[at[0]]
        a, b = composed(a, b)
        mean = (a * value if seen else 0.0) + b
        if self.alpha is None:
            out[at] = mean
        else:
            out[at[0] :] = np.repeat(mean, np.diff(at, append=len(x)))
            so_far = seen + np.cumsum(~np.isnan(x))
            out = np.where(so_far >= self.n, out, np.nan)
        return out, (mean[-1], float(len(x) - 1 - at[-1]), seen + len(at))


class Rank:
    """Percentage of the last n values that are no greater than the last, where all n are there; states and summaries are the last n - 1."""

    START = ()

    def __init__(self, n: int):
        self.n = n

    def summary(self, x: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
        return tuple(x[max(0, len(x) - self.n + 1) :].tolist())

    def joined(self, s, t) -> tuple[float, ...]:
        return (*s, *t)[max(0, len(s) + len(t) - self.n + 1) :]

    after = joined

    def __call__(self, state, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, tuple[float, ...]]:
        frame = np.concatenate([np.asarray(state, dtype=float), x])
        rank = pd.Series(frame).rolling(self.n, min_periods=self.n).rank(method="max").to_numpy()[len(state) :]
        return rank * 100.0 / self.n, self.summary(frame, frame)


def recursion(s: Series) -> Recursion | Rank | None:
    return {"ema": lambda: Recursion(2 / (s.n + 1), s.n), "wilder": lambda: Recursion(1 / s.n, s.n), "vma": Recursion, "macdv": lambda: None, "pctrank": lambda: Rank(s.n)}[s.kind]()


def levels(wanted: list[Series]) -> list[list[Series]]:
    """Series in passes: a recursion comes a pass after what it is made of."""
    depth: dict[str, int] = {}
    for s in wanted:
        depth[s.out] = max([0, *(depth[c] + (s.kind != "macdv") for c in (s.source, s.by, s.over) if c in depth)])
    return [[s for s in wanted if depth[s.out] == k] for k in range(1 + max(depth.values(), default=-1))]


class States:
    """The states of all wanted series of one symbol."""

    def __init__(self, wanted: list[Series], states: list | None = None):
        self.steps = [(s, recursion(s)) for s in wanted]
        self.held = states or [None if step is None else step.START for _, step in self.steps]

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        made: dict[str, np.ndarray] = {}
        column = lambda c: made[c] if c in made else _numbers(pdf, c)
        for k, (s, step) in enumerate(self.steps):
            x = column(s.source)
            if step is None:
                over = column(s.over)
                made[s.out] = (x - column(s.by)) / np.where(over == 0, np.nan, over) * 100
            else:
                made[s.out], self.held[k] = step(self.held[k], x, column(s.by) if s.by else x)
        return pdf.assign(**{c: pd.Series(v, index=pdf.index).astype(object).where(~np.isnan(v), None) for c, v in made.items()})


def _numbers(pdf: pd.DataFrame, c: str) -> np.ndarray:
    return pdf[c].to_numpy("float64", na_value=np.nan)


def _runs(pdf: pd.DataFrame, by: list[str]):
    """Rows of one key after the other, with the key."""
    new = np.logical_or.reduce([(pdf[c].ne(pdf[c].shift()) & ~(pdf[c].isna() & pdf[c].shift().isna())).to_numpy() for c in by])
    cuts = [*np.flatnonzero(new | (np.arange(len(pdf)) == 0)).tolist(), len(pdf)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        key = tuple(pdf[c].iat[a] for c in by)
        yield tuple(None if pd.isna(k) else k for k in key), pdf.iloc[a:b]


def recursions(df: DataFrame, wanted: list[Series], key: str = "symbol", stretch: str | None = None) -> DataFrame:
    """``df`` with the wanted series as doubles, NULL where undefined; equal requests are computed once.

    ``stretch``: a duration as ``window`` takes it, such as ``30 days``; the
    result is the same with any and without.  Bars must have a time.
    """
    wanted = list(dict.fromkeys(wanted))
    if stretch is not None:
        given = df.columns
        for level in levels(wanted):
            df = _scanned(df, level, key, stretch)
        return df.select(*given, *[s.out for s in wanted])
    schema = T.StructType([*df.schema.fields, *[T.StructField(s.out, T.DoubleType()) for s in wanted]])
    columns = df.columns

    def run(batches):
        states = None
        for pdf in batches:
            numbers = pdf["_nth"].to_numpy()
            starts = np.flatnonzero(numbers == 1)  # a symbol's first bar
            cuts = np.unique(np.concatenate([[0], starts, [len(pdf)]]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if numbers[a] == 1:
                    states = States(wanted)
                yield states(pdf.iloc[a:b][columns])

    # the number clusters symbols and orders their bars, and where that is so already it costs no exchange and no sort
    numbered = df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("ts"))).sortWithinPartitions(key, "ts")
    return numbered.mapInPandas(run, schema)


def _scanned(df: DataFrame, level: list[Series], key: str, stretch: str) -> DataFrame:
    """One pass over stretches: sum up, string together, apply."""
    chains = [(s, r) for s in level if (r := recursion(s)) is not None]
    columns, names = df.columns, {f.name: f for f in df.schema.fields}
    cut = df.withColumn("_stretch", F.window("ts", stretch).start)
    place = T.StructType([names[key], T.StructField("_stretch", cut.schema["_stretch"].dataType), T.StructField("_state", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def summed(batches):
        last, held = None, []
        frame = lambda: pd.DataFrame({key: [last[0]], "_stretch": [last[1]], "_state": [[[float(v) for v in s] for s in held]]})
        for pdf in batches:
            for at, part in _runs(pdf, [key, "_stretch"]):
                new = [r.summary(_numbers(part, s.source), _numbers(part, s.by or s.source)) for s, r in chains]
                if at == last:
                    held = [r.joined(a, b) for (_, r), a, b in zip(chains, held, new, strict=True)]
                else:
                    if last is not None:
                        yield frame()
                    last, held = at, new
        if last is not None:
            yield frame()

    def strung(batches):
        last, states = None, []
        for pdf in batches:
            out = []
            for (at,), part in _runs(pdf, [key]):
                if at != last or not states:
                    last, states = at, [r.START for _, r in chains]
                for sums in part["_state"]:
                    out.append([[float(v) for v in s] for s in states])
                    states = [r.after(s, t.tolist()) for (_, r), s, t in zip(chains, states, sums, strict=True)]
            yield pdf.assign(_state=out)

    def applied(batches):
        states = None
        for pdf in batches:
            for _, part in _runs(pdf, [key, "_stretch"]):
                if part["_state"].iat[0] is not None:
                    given = iter(part["_state"].iat[0])
                    states, part = States(level, [None if recursion(s) is None else tuple(next(given).tolist()) for s in level]), part.iloc[1:]
                if len(part):
                    yield states(part[columns])

    sums = cut.select(key, "_stretch", "ts", *dict.fromkeys(c for s, _ in chains for c in (s.source, s.by) if c)).repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "ts").mapInPandas(summed, place)
    states = sums.repartition(key).sortWithinPartitions(key, "_stretch").mapInPandas(strung, place)
    # states come as rows before the bars of their stretch, so that what belongs together is dealt out whole
    both = cut.withColumn("_state", F.lit(None).cast("array<array<double>>")).unionByName(states, allowMissingColumns=True).withColumn("_own", F.col("_state").isNull())
    dealt = both.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "_own", "ts")
    return dealt.mapInPandas(applied, T.StructType([*df.schema.fields, *[T.StructField(s.out, T.DoubleType()) for s in level]]))
