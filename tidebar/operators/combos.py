"""Joining snapshots of three timeframes into combos, and ETF context.

No side is broadcast by hint: Spark does so where its statistics, or those of
the running query, show that a side is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_symbol, tokenize

#: Tokens that more than this share of the funds hold make no pairs.
COMMON = 0.5


def with_role(df: DataFrame, role: str) -> DataFrame:
    return df.select("symbol", *[F.col(c).alias(f"{role}_{'date' if c == 'ts' else c}") for c in df.columns if c != "symbol"])


def build_combo(lower: DataFrame, middle: DataFrame, upper: DataFrame) -> DataFrame:
    """Inner join of the three roles on symbol; all three are hashed the same way."""
    return with_role(lower, "lower").join(with_role(middle, "middle"), "symbol").join(with_role(upper, "upper"), "symbol")


def restrict(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Only symbols of the universe; an empty universe does not restrict, which the job itself finds out."""
    listed = universe.select("symbol").distinct()
    none = universe.select("symbol").limit(1).agg(F.count(F.lit(1)) == 0).scalar()
    return df.join(listed.withColumn("_listed", F.lit(True)), "symbol", "left").filter(F.col("_listed").isNotNull() | none).drop("_listed")


def symbols_for(universes: dict[str, DataFrame], exclusions: DataFrame, shortlists: tuple[str, ...] = ("shortlist_stocks", "shortlist_futures")) -> DataFrame:
    """Symbols of all universes; exclusions strike those that stand in no shortlist."""
    tagged = None
    for name, df in universes.items():
        part = df.select(norm_symbol(F.col("symbol")).alias("symbol"), F.lit(name in shortlists).alias("short"))
        tagged = part if tagged is None else tagged.unionByName(part)
    known = tagged.filter("symbol <> ''").groupBy("symbol").agg(F.bool_or("short").alias("short"))
    out = exclusions.select(norm_symbol(F.col("symbol")).alias("symbol"))
    return known.filter("short").select("symbol").unionByName(known.filter("not short").select("symbol").join(out.distinct(), "symbol", "left_anti"))


def eligible(meta: DataFrame, min_cap: float = 1e9) -> DataFrame:
    return meta.filter(F.col("has_options") & (F.col("market_cap") >= min_cap)).select("symbol", "market_cap", "name", "sector", "industry", "sub_industry")


def match_by_tokens(stocks: DataFrame, etfs: DataFrame, overrides: DataFrame | None = None, industry_th: float = 0.20, sector_th: float = 0.50, default: str = "SPY") -> DataFrame:
    """Best ETF of each stock by token similarity of industry and of sector.

    An inverted index instead of all pairs: distinct texts are tokenised once,
    tokens meet by an equi-join, and shared tokens are counted.  Tokens of more
    than ``COMMON`` of the funds make no pairs: they are carried along and counted
    where a rarer token has met, and funds that share nothing else with a text
    are told apart by their common tokens and size only, so the first fund of
    each such kind stands for all.  ``etfs`` has symbol, name and pos (its order,
    which breaks ties).

    Nothing filters on tokens before they are exploded, and none of them can be
    NULL: such a filter would be pushed below ``distinct``, and every row of
    ``stocks`` be tokenised for it.
    """
    stocks = stocks.filter("sector is not null and industry is not null")
    funds = etfs.select(F.col("symbol").alias("etf"), F.col("name").alias("etf_name"), "pos", tokenize(F.col("name")).alias("ft"))
    counts = funds.select(F.explode_outer("ft").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # at most 1 / COMMON times the tokens of a mean name
    common = counts.filter(F.col("n") > COMMON * funds.agg(F.count(F.when(F.size("ft") > 0, 1))).scalar()).agg(F.collect_list("token")).scalar()
    common = F.coalesce(common, F.array().cast("array<string>"))

    def split(df: DataFrame, tokens: str, size: str, hot: str, cold: str) -> DataFrame:
        return df.withColumns({size: F.size(tokens), hot: F.sort_array(F.array_intersect(tokens, common)), cold: F.array_except(tokens, common)})

    funds = split(funds, "ft", "nf", "fh", "fc")
    by_token = funds.select("etf", "etf_name", "pos", "nf", "fh", F.explode_outer("fc").alias("token"))
    by_kind = funds.groupBy("fh", "nf").agg(F.min(F.struct("pos", "etf", "etf_name")).alias("f")).select("fh", "nf", "f.*", F.explode_outer("fh").alias("token"))
    both = F.size(F.array_intersect("th", "fh"))

    def best(column: str) -> DataFrame:
        texts = split(stocks.select(column).distinct().withColumn("t", tokenize(F.col(column))), "t", "nt", "th", "tc")
        names = ["etf", "etf_name", "pos", "nf"]
        rare = texts.select(column, "nt", "th", F.explode_outer("tc").alias("token")).join(by_token, "token").groupBy(column, "nt", *names, both.alias("kh")).agg(F.count(F.lit(1)).alias("kc")).select(column, "nt", *names, (F.col("kh") + F.col("kc")).alias("k"))
        # what shares common tokens only: kinds of texts against kinds of funds, of which the first stands for all
        kinds = texts.select("nt", "th").distinct().withColumn("token", F.explode_outer("th")).join(by_kind, "token").select("nt", "th", *names, both.alias("k")).distinct()
        hits = rare.unionByName(texts.select(column, "nt", "th").join(kinds, ["nt", "th"]).select(column, "nt", *names, "k"))
        scored = hits.withColumn("score", F.col("k") / (F.col("nt") + F.col("nf") - F.col("k")))
        top = scored.groupBy(column).agg(F.max_by(F.struct("etf", "etf_name", "score"), F.struct("score", -F.col("pos"))).alias("b"))
        return top.select(column, F.col("b.etf").alias(f"{column}_etf"), F.col("b.etf_name").alias(f"{column}_etf_name"), F.col("b.score").alias(f"{column}_score"))

    out = stocks.join(best("industry"), "industry", "left").join(best("sector"), "sector", "left")
    out = out.withColumns({f"{c}_score": F.coalesce(f"{c}_score", F.lit(0.0)) for c in ("industry", "sector")})
    by_industry, by_sector = F.col("industry_score") >= industry_th, F.col("sector_score") >= sector_th
    primary = F.when(by_industry, F.col("industry_etf")).when(by_sector, F.col("sector_etf")).otherwise(F.lit(default))
    out = out.withColumn("p", primary)
    second = F.when(by_industry & (F.col("industry_etf") != F.col("p")), F.col("industry_etf")).when(by_sector & (F.col("sector_etf") != F.col("p")), F.col("sector_etf"))
    out = out.withColumns({"s": second, "etf_match_source": F.lit("fuzzy"), "etf_override_notes": F.lit(None).cast("string")})
    if overrides is not None:
        o = overrides.select("symbol", F.col("etf_symbol_primary").alias("op"), F.col("etf_symbol_secondary").alias("os"), F.col("notes").alias("on"))
        out = out.join(o, "symbol", "left").withColumns({
            "p": F.coalesce("op", "p"), "s": F.when(F.col("op").isNotNull(), F.col("os")).otherwise(F.col("s")),
            "etf_match_source": F.when(F.col("op").isNotNull(), "override").otherwise(F.col("etf_match_source")), "etf_override_notes": F.col("on"),
        })
    return out.select(
        "symbol", "name", "sector", "industry", "industry_etf", "industry_etf_name", "industry_score", "sector_etf", "sector_etf_name", "sector_score",
        F.col("p").alias("etf_symbol_primary"), F.col("s").alias("etf_symbol_secondary"), "etf_match_source", "etf_override_notes",
    )


def attach_etf(combo: DataFrame, etf_map: DataFrame, lower: DataFrame, middle: DataFrame, universe: str = "options_eligible") -> DataFrame:
    """ETF scores of both ranks and both lower timeframes; the middle ones also under plain names."""
    if universe != "options_eligible":
        return combo
    out = combo.join(etf_map.select("symbol", "etf_symbol_primary", "etf_symbol_secondary"), "symbol", "left")
    for rank in ("primary", "secondary"):
        for tf, scores in (("lower", lower), ("middle", middle)):
            side = scores.select(F.col("etf_symbol").alias("_e"), F.col("etf_long_score").alias(f"etf_{tf}_{rank}_long_score"), F.col("etf_short_score").alias(f"etf_{tf}_{rank}_short_score"))
            out = out.join(side, F.col(f"etf_symbol_{rank}") == F.col("_e"), "left").drop("_e")
        out = out.withColumns({f"etf_{rank}_{s}_score": F.col(f"etf_middle_{rank}_{s}_score") for s in ("long", "short")})
    return out
