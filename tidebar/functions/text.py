"""Scalar text functions: symbols, keys, tokens and their similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about what a fund holds.
STOP_WORDS = [
    "500", "&", "-", "alcoholic", "and", "care", "corp", "corporation", "diversified", "dynamic", "equal", "etf", "exchange", "expanded",
    "first", "fund", "global", "inc", "index", "invesco", "ishares", "kbw", "nasdaq", "regional", "s&p", "sector", "select", "services",
    "spdr", "the", "trust", "u.s.", "usd", "vaneck", "weight",
]
#: Words whose last s is no plural.
NO_PLURALS = ["ms", "us", "gas", "as", "is", "this", "yes"]
#: Words of one sector under one name.
STEMS = {
    "healthcare": "health", "health": "health", "jets": "airlines", "airlines": "airlines", "discretionary": "cyclical", "cyclical": "cyclical",
    "staples": "defensive", "defensive": "defensive", "telecom": "telecommunications", "telecommunications": "telecommunications",
}


def norm_symbol(c: Column) -> Column:
    return F.upper(F.trim(c))


def safe_key(c: Column) -> Column:
    """Blanks and slashes become underscores."""
    return F.translate(c, " /\\", "___")


def normalize_token(t: Column) -> Column:
    stem = F.create_map(*[F.lit(x) for pair in STEMS.items() for x in pair])
    return (
        F.when(F.array_contains(F.map_keys(stem), t), stem[t])
        .when((F.length(t) <= 3) | t.isin(NO_PLURALS), t)
        .when(t.endswith("ies") & (F.length(t) > 4), F.concat(F.substr(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )


def tokenize(c: Column) -> Column:
    """Distinct normalised words; empty for NULL."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    raw = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~F.array_contains(stop, t))
    return F.array_distinct(F.filter(F.transform(raw, normalize_token), lambda t: (F.length(t) > 0) & ~F.array_contains(stop, t)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def score_summary(long: Column, short: Column) -> Column:
    """"L.l / S.s", empty when both are NULL."""
    return F.when(long.isNull() & short.isNull(), F.lit("")).otherwise(F.format_string("%.1f / %.1f", F.coalesce(long, F.lit(0.0)), F.coalesce(short, F.lit(0.0))))


def format_value(c: Column) -> Column:
    """A dash for NULL, whole numbers without decimals, others with two."""
    return F.when(c.isNull(), F.lit("—")).when(c == F.floor(c), F.format_string("%d", c.cast("long"))).otherwise(F.format_string("%.2f", c))


def score_tier(c: Column) -> Column:
    return F.when(c >= 6, "strong").when(c >= 4, "mild").otherwise("none")
