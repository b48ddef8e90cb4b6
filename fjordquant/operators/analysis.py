"""The full analysis record of every (as_of, symbol), today or at past dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordquant.functions.ordering import reread_quantiles
from fjordquant.operators import indicators as I
from fjordquant.operators import peers as PE
from fjordquant.operators import pit as P
from fjordquant.operators import scoring as SC
from fjordquant.operators import technical as T
from fjordquant.operators import ttm as TTM
from fjordquant.operators import universe as U
from fjordquant.operators import valuation as V

FEATURES = [
    "year", "net_income_parent", "net_income", "equity", "minority_interest", "pbt",
    "interest_expense", "depreciation", "cash", "short_investments", "g_raw", "ni_cagr",
    "top_line_cagr", "fcff3", "debt", "avg_debt", "interest", "roe3", "cfo_to_ni3", "past", "n_years",
    "failed_checks", "roe_last", "debt_to_equity_last", "cir", "credit_cost", "equity_to_assets",
    "current_ratio", "interest_coverage",
]
# what scores, ratings and reports read of a valuation
VALUED = [
    "company_type", "price", "shares", "year", "roe_last", "cir", "credit_cost", "equity_to_assets",
    "debt_to_equity_last", "current_ratio", "cfo_to_ni3", "interest_coverage", "top_line_cagr", "ni_cagr",
    "failed_checks", "n_years", "ke", "n_methods", "dispersion", "confidence", "target_bear", "target_base",
    "target_bull", "upside",
]
PEER_COLUMNS = ["pe_p25", "pe_p50", "pe_p75", "pb_p25", "pb_p50", "pb_p75", "pb_p90"]


def universe_as_of(securities: DataFrame, bars: DataFrame, annual: DataFrame,
                   deduped_quarters: DataFrame, signal_dates: DataFrame) -> DataFrame:
    """The market table at every signal date, from what was known on it."""
    prices = P.prices_as_of(I.session_panel(bars), signal_dates)
    metrics = U.annual_metrics(annual)
    known = [c for c in metrics.columns if c not in ("symbol", "available_from")]
    df = P.attach_as_of(prices, metrics, ["symbol"], "as_of", "available_from", known, ["fin_year"])
    df = P.attach_as_of(df, TTM.ttm_history(deduped_quarters), ["symbol"], "as_of",
                        "available_from", ["ni_ttm", "ttm_label"], ["q"])
    df = securities.join(df, "symbol").withColumn("ret_ytd", F.lit(None).cast("double"))
    return U.with_multiples(df)


def features_as_of(universe: DataFrame, features: DataFrame) -> DataFrame:
    """(as_of, symbol) with the newest visible yearly feature row."""
    named = features.withColumnsRenamed(
        {"roe": "roe_last", "debt_to_equity": "debt_to_equity_last"})
    keys = universe.select("as_of", "symbol")
    return P.attach_as_of(keys, named, ["symbol"], "as_of", "visible_from", FEATURES, ["year"])


def features_now(universe: DataFrame, features: DataFrame) -> DataFrame:
    """(as_of, symbol) with the newest yearly feature row, by year."""
    named = features.withColumnsRenamed(
        {"roe": "roe_last", "debt_to_equity": "debt_to_equity_last"})
    newest = named.groupBy("symbol").agg(F.max_by(F.struct(*FEATURES), "year").alias("f"))
    return universe.select("as_of", "symbol").join(newest, "symbol", "left").select(
        "as_of", "symbol", "f.*")


def valuation(universe: DataFrame, features: DataFrame, betas: DataFrame,
              levels: DataFrame | None = None) -> DataFrame:
    """Peer multiples, own history, methods and the blended target.

    ``levels`` are the ``peer_levels`` where the caller reads them more than once.
    """
    levels = PE.peer_levels(universe) if levels is None else levels
    comparison = PE.peer_comparison(universe, levels).select("as_of", "symbol", *PEER_COLUMNS)
    fit = PE.pb_roe_regression(universe, levels).select("as_of", "symbol", "pb_target")
    base = universe.select(
        "as_of", "symbol", "company_type", "price", "shares", "ni_ttm")
    keys = ["as_of", "symbol"]
    df = base.join(features, keys, "left").join(comparison, keys, "left").join(
        fit, keys, "left").join(betas, keys, "left")
    df = df.withColumn("pb_target", F.when(F.col("pb_p50").isNotNull(), F.col("pb_target")))
    # the published analysis passes no EV/EBITDA multiples into this step
    df = df.withColumns({f"ev_{t}": F.lit(None).cast("double") for t in ("p25", "p50", "p75")})
    return V.blend(V.methods(V.historical_multiples(df)))


def sector_view(universe: DataFrame, index_rets: DataFrame, impacts: DataFrame | None,
                levels: DataFrame | None = None) -> DataFrame:
    """(as_of, symbol, sector score of the chosen peer node)."""
    levels = PE.peer_levels(universe) if levels is None else levels
    stats = PE.node_stats(universe, index_rets).select(
        *PE.NODE, "ret_3m_vs_index", "ret_1y_vs_index")
    roe = PE.node_quantiles(universe, ["roe"], {"roe_median": 0.5}, quantiles=reread_quantiles).select(
        *PE.NODE, "roe_median")
    # one row a node and date, sent to the members
    df = levels.join(F.broadcast(stats), PE.NODE).join(F.broadcast(roe), PE.NODE, "left").join(
        universe.select("as_of", "symbol", "company_type"), ["as_of", "symbol"])
    if impacts is None:
        df = df.withColumn("impact", F.lit(None).cast("double"))
    else:
        df = df.join(impacts, "company_type", "left")
    return df.withColumn("score_sector", PE.sector_score(
        F.col("ret_3m_vs_index"), F.col("ret_1y_vs_index"), F.col("roe_median"), F.col("impact"),
    )).select("as_of", "symbol", "score_sector", F.col("impact").alias("score_macro"))


def technical_totals(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """(symbol, as_of_price, total score) at the universe's bars with 120 sessions."""
    at = universe.select("symbol", F.col("as_of_price").alias("time"))
    scored = T.with_scores(T.technical_state(bars, wanted=at))
    return scored.where(F.col("i") >= 119).select(
        "symbol", F.col("time").alias("as_of_price"), F.col("total_score").alias("tech_total"))


def score_universe(universe: DataFrame, valued: DataFrame, sector: DataFrame, tech: DataFrame,
                   sentiment: DataFrame | None = None) -> DataFrame:
    """Composite score, rating and eligibility of every (as_of, symbol)."""
    keys = ["as_of", "symbol"]
    statics = universe.select(
        *keys, "name", "exchange", "icb1", "icb4", "market_cap", "avg_value_20d", "has_bctc",
        "n_sessions", "traded_today", "as_of_price", "liquidity_flag")
    df = statics.join(valued.drop("ni_ttm"), keys).join(sector, keys, "left").join(
        tech, ["symbol", "as_of_price"], "left")
    if sentiment is None:
        df = df.withColumn("score_sentiment", F.lit(None).cast("double"))
    else:
        df = df.join(sentiment, "symbol", "left")
    df = df.withColumns({
        "score_quality": SC.quality_score(), "score_growth": SC.growth_score(),
        "score_valuation": SC.valuation_score(), "score_technical": SC.technical_score(),
    })
    return SC.with_eligibility(SC.with_rating(SC.with_composite(df)))
