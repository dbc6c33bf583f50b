"""What a desk does with scored combos: screens, views, health checks, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_value, norm_symbol, score_summary

SIGNALS = ["long", "short", "watch", "anti"]
ROLES = ("lower", "middle", "upper")


def run_screen(df: DataFrame, rules: list[str], sort: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows that meet all rules (Spark SQL conditions); sort keys like "-score", of which the last listed decides first."""
    for rule in rules:
        df = df.filter(F.expr(rule))
    if sort:
        df = df.orderBy(*[F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in reversed(sort)])
    return df.limit(limit) if limit else df


def with_combo_defaults(df: DataFrame) -> DataFrame:
    for c, kind in (("signal", "string"), ("signal_side", "string"), ("mtf_long_score", "double"), ("mtf_short_score", "double")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.withColumn("signal_side", F.coalesce("signal_side", "signal"))


def filter_signal(df: DataFrame, signal: str) -> DataFrame:
    return df if signal == "all" else df.filter(F.col("signal" if "signal" in df.columns else "signal_side") == signal)


def sort_view(df: DataFrame, signal: str = "all") -> DataFrame:
    """By the side's score, or by the greater of both sizes; symbols break ties."""
    long, short = F.col("mtf_long_score"), F.col("mtf_short_score")
    by = {"long": long, "short": short}.get(signal, F.greatest(F.abs(long), F.abs(short)))
    return df.orderBy(by.desc_nulls_last(), "symbol")


def sort_archived(df: DataFrame) -> DataFrame:
    """By long score, then short score, both falling; symbols break ties."""
    return df.orderBy(F.col("mtf_long_score").desc_nulls_last(), F.col("mtf_short_score").desc_nulls_last(), "symbol")


def select_view(df: DataFrame, catalog: list[str]) -> DataFrame:
    """The catalog's columns that are there; the roles' dates follow the signal."""
    dates = [f"{r}_date" for r in ROLES if f"{r}_date" in df.columns]
    names = [c for c in catalog if c in df.columns and c not in dates]
    at = names.index("signal") + 1 if "signal" in names else len(names)
    return df.select(*names[:at], *dates, *names[at:])


def view(df: DataFrame, signal: str, catalog: list[str]) -> DataFrame:
    out = sort_view(filter_signal(with_combo_defaults(df), signal), signal)
    return select_view(out.withColumn("score_summary", score_summary(F.col("mtf_long_score"), F.col("mtf_short_score"))), catalog)


def _role(name: str) -> str:
    return next((r for r in ROLES if name.startswith(f"{r}_")), "meta")


def nest_roles(df: DataFrame) -> DataFrame:
    """Columns of a role as one struct, the others under meta."""
    groups: dict[str, list[Column]] = {}
    for c in df.columns:
        r = _role(c)
        groups.setdefault(r, []).append(F.col(c).alias(c if r == "meta" else c[len(r) + 1 :]))
    return df.select(*[F.struct(*groups[g]).alias(g) for g in ("meta", *ROLES) if g in groups])


def select_groups(df: DataFrame, hidden: set[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if _role(c) not in hidden])


def inspect(df: DataFrame, symbol: str, fields: list[str]) -> DataFrame:
    """One symbol in long form: (field, lower, middle, upper)."""
    cell = lambda r, x: format_value(F.col(f"{r}_{x}").cast("double")) if f"{r}_{x}" in df.columns else F.lit("—")
    rows = F.array(*[F.struct(F.lit(x).alias("field"), *[cell(r, x).alias(r) for r in ROLES]) for x in fields])
    return df.filter(norm_symbol(F.col("symbol")) == symbol.strip().upper()).select(F.explode(rows).alias("r")).select("r.*")


def missing_symbols(df: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.select(norm_symbol(F.col("symbol")).alias("symbol")).distinct().join(df.select(norm_symbol(F.col("symbol")).alias("symbol")).distinct(), "symbol", "left_anti")


def check_nonempty(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("name"), F.lit("nonempty").alias("check"), (F.col("found") > 0).alias("ok"), "found")


def check_coverage(df: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    return missing_symbols(df, expected).agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("name"), F.lit("coverage").alias("check"), (F.col("found") == 0).alias("ok"), "found")


def diff_symbols(current: DataFrame, before: DataFrame) -> DataFrame:
    """(symbol, change): entered or exited."""
    a, b = current.select("symbol").distinct(), before.select("symbol").distinct()
    return a.join(b, "symbol", "left_anti").withColumn("change", F.lit("entered")).unionByName(b.join(a, "symbol", "left_anti").withColumn("change", F.lit("exited")))


def combo_asof(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(*[F.max(f"{r}_date") for r in ROLES if f"{r}_date" in df.columns]).alias("asof"))


def signals_of_interest(df: DataFrame) -> DataFrame:
    """Rows whose signal is one of ``SIGNALS``, whatever its case and blanks, with their symbols in capitals."""
    return df.withColumns({"symbol": norm_symbol(F.col("symbol")), "signal": F.lower(F.trim("signal"))}).filter(F.col("signal").isin(SIGNALS) & (F.col("symbol") != ""))


def _side(df: DataFrame) -> Column:
    """The trimmed side of a signal; empty where there is none."""
    return F.trim(F.coalesce("signal_side", F.lit(""))) if "signal_side" in df.columns else F.lit("")


def alert_digest(df: DataFrame, cap: int = 40) -> DataFrame:
    """For each signal the first ``cap`` symbols in order, how many there are and how many are over.

    Numbered per signal before they are gathered, so that only the capped ones are.
    """
    distinct = signals_of_interest(df).select("signal", "symbol").distinct()
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("signal").orderBy("symbol")))
    top = ranked.filter(F.col("r") <= cap).groupBy("signal").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))
    n = distinct.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
    return top.join(n, "signal").withColumn("overflow", F.greatest(F.col("n") - cap, F.lit(0)))


def alert_rows(df: DataFrame, cap: int = 75) -> DataFrame:
    """The long form: for each signal its first ``cap`` rows in order of symbols, with side and scores, and how many are over."""
    known = signals_of_interest(with_combo_defaults(df.withColumn("_side", F.nullif(_side(df), F.lit(""))))).select("signal", "symbol", F.col("_side").alias("side"), F.col("mtf_long_score").cast("double").alias("long"), F.col("mtf_short_score").cast("double").alias("short"))
    w = Window.partitionBy("signal")
    ranked = known.withColumns({"place": F.row_number().over(w.orderBy("symbol", "side", "long", "short")), "n": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("place") <= cap).withColumn("overflow", F.greatest(F.col("n") - cap, F.lit(0)))


def fingerprint(df: DataFrame, signals: list[str] = SIGNALS) -> DataFrame:
    """SHA-256 over "signal:symbols" of scored rows, signals in the given order, all their symbols sorted, none left out.

    What is hashed is as long as the alert's symbols together, which the universe bounds.
    """
    distinct = signals_of_interest(df).filter(F.col("signal").isin(signals)).select("signal", "symbol").distinct()
    groups = distinct.groupBy("signal").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))
    part = F.struct(F.array_position(F.lit(signals), F.col("signal")).alias("at"), F.concat_ws(":", "signal", "symbols").alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"])
    return groups.agg(F.sha2(F.array_join(parts, "|").cast("binary"), 256).alias("fingerprint"))


def fingerprint_rows(df: DataFrame) -> DataFrame:
    """The other fingerprint: all sorted (symbol, signal, side) triples as JSON without blanks."""
    rows = signals_of_interest(df).select(F.struct("symbol", "signal", F.lower(_side(df)).alias("side")).alias("t"))
    triple = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.to_json(F.array(t["symbol"], t["signal"], t["side"])))
    return rows.agg(F.concat(F.lit("["), F.array_join(triple, ","), F.lit("]")).alias("fingerprint"))


def changed_only(digests: DataFrame, state: DataFrame) -> DataFrame:
    """Digests (alert_key, fingerprint) that differ from the last state, or have none."""
    last = state.groupBy("alert_key").agg(F.max_by("fingerprint", "saved_at").alias("last"))
    return digests.join(last, "alert_key", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("last"))).drop("last")


def qa_sample(df: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """A sample that depends on rows and seed only: the n least keyed hashes of fuzzy matches."""
    key = F.md5(F.concat_ws("|", F.col("symbol").cast("string"), F.lit(str(seed))))
    return df.filter("etf_match_source = 'fuzzy'").orderBy(key, "symbol").limit(n)
