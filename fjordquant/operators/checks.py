"""Data quality checks, one row per (symbol, check), and table invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import lookup


def universe_invariants(universe: DataFrame) -> DataFrame:
    leaf = universe.groupBy("symbol").agg(
        F.min("icb4").alias("a"), F.max("icb4").alias("b"), F.count(F.lit(1)).alias("k"))
    per = leaf.agg(
        F.bool_and(F.col("k") == 1).alias("unique_symbols"),
        F.bool_and(F.col("a") == F.col("b")).alias("one_leaf_per_symbol"))
    tops = universe.groupBy("icb1").agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k")).scalar()
    n = F.count(F.lit(1))
    return universe.agg(
        n.alias("n_universe"), F.count("price").alias("n_with_price"),
        F.count_if("has_bctc").alias("n_with_bctc"), F.count_if("liquidity_flag").alias("n_liquid"),
    ).withColumns({
        "nodes_add_up": tops == F.col("n_universe"),
        "unique_symbols": per.select("unique_symbols").scalar(),
        "one_leaf_per_symbol": per.select("one_leaf_per_symbol").scalar()})


def _status(bad: Column, level: str, skip: Column | None = None) -> Column:
    s = F.when(bad, level).otherwise("PASS")
    return s if skip is None else F.when(skip, "SKIP").otherwise(s)


def financial_checks(annual: DataFrame, this_year: Column | int, min_years: int = 3) -> DataFrame:
    """Statement checks per symbol; ``annual`` carries company_type and computed."""
    year = F.lit(this_year) if isinstance(this_year, int) else this_year
    le = F.col("total_liabilities") + F.col("equity")
    gap = F.abs(le - F.col("total_assets")) / F.greatest(F.abs("total_assets"), F.lit(1e-9))
    bank = F.col("company_type") == "BANK"
    last = F.max("year")

    def absent(c: str) -> Column:
        return F.count(c) == 0

    core_bank = absent("net_interest_income") | absent("loans") | absent("deposits")
    core_other = absent("revenue") | absent("net_income") | absent("equity") | absent("cfo")
    per = annual.groupBy("symbol", "company_type").agg(
        F.count(F.lit(1)).alias("n"), last.alias("last"),
        (absent("total_assets") | absent("total_liabilities") | absent("equity")
         | F.bool_or(F.contains("computed", F.lit("total_liabilities")))).alias("no_balance"),
        F.count_if(gap > 0.01).alias("n_gap"),
        F.count_if(F.col("total_assets") < 10e9).alias("n_tiny"),
        F.count_if(F.col("gross_profit") > F.col("revenue") * 1.001).alias("n_gross"),
        F.count_if((F.col("net_income") > 0)
                   & (F.col("net_income_parent") > F.col("net_income") * 1.05)).alias("n_parent"),
        F.max(F.struct("year", gap.alias("g")))["g"].alias("last_gap"),
        core_bank.alias("miss_bank"), core_other.alias("miss_other"))
    miss = F.when(bank, F.col("miss_bank")).otherwise(F.col("miss_other"))
    rows = [
        ("statements_present", F.lit("PASS")),
        ("enough_years", _status(F.col("n") < min_years, "WARN")),
        ("recent_year", _status(F.col("last") < year - 2, "WARN")),
        ("balance_closes", _status(F.col("n_gap") > 0, "FAIL", F.col("no_balance"))),
        ("currency_unit", _status(F.col("n_tiny") > 0, "WARN")),
        ("gross_within_revenue", _status(F.col("n_gross") > 0, "FAIL", bank)),
        ("parent_within_total", _status(F.col("n_parent") > 0, "WARN")),
        ("core_fields", _status(miss, "WARN")),
        ("balance_closes_latest", _status(F.col("last_gap") >= 0.005, "WARN")),
    ]
    return _stack(per, rows)


def _stack(per: DataFrame, rows: list[tuple[str, Column]]) -> DataFrame:
    checks = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), status.alias("status")) for name, status in rows]))
    return per.select("symbol", checks.alias("c")).select("symbol", "c.*")


def price_checks(bars: DataFrame, securities: DataFrame, as_of: Column) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("time")
    band = lookup(S.PRICE_BAND, F.col("exchange"), F.lit(0.15))
    change = F.abs(F.col("close") / F.lag("close").over(w) - 1)
    df = bars.join(securities.select("symbol", "exchange"), "symbol").withColumn(
        "breach", change > band + S.BAND_TOLERANCE)
    lowest = F.least("open", "high", "low", "close")
    per = df.groupBy("symbol").agg(
        F.max("time").alias("last"), F.count_if(lowest <= 0).alias("bad"),
        F.count_if("breach").alias("breaches")).withColumn("as_of", as_of)
    return _stack(per, [
        ("prices_present", F.lit("PASS")),
        ("prices_recent", _status(F.date_diff("as_of", "last") > 7, "WARN")),
        ("prices_positive", _status(F.col("bad") > 0, "FAIL")),
        ("moves_within_band", _status(F.col("breaches") > 0, "WARN")),
    ])


def cross_checks(ratios: DataFrame, source: DataFrame, own_pe: DataFrame) -> DataFrame:
    """Own ROE and P/E against the vendor's figures (per symbol and year)."""
    j = ratios.select("symbol", "year", "roe").join(source, ["symbol", "year"], "full")
    newest = F.max_by("src_pe", F.when(F.col("src_pe").isNotNull(), F.col("year")))
    per = j.groupBy("symbol").agg(
        F.count_if(F.col("roe").isNotNull() & F.col("src_roe").isNotNull()).alias("both"),
        F.count_if(F.abs(F.col("src_roe") / 100 - F.col("roe")) > 0.03).alias("off"),
        newest.alias("src_pe")).join(own_pe, "symbol", "left")
    rel = F.abs(F.col("pe") - F.col("src_pe")) / F.greatest(F.abs("src_pe"), F.lit(1e-9))
    return _stack(per, [
        ("roe_matches_source", _status(F.col("off") > 0, "WARN", F.col("both") == 0)),
        ("pe_matches_source", _status(rel > 0.15, "WARN", rel.isNull())),
    ])


def summarise(checks: DataFrame) -> DataFrame:
    """Counts per symbol, SKIP left out."""
    s = F.col("status")
    return checks.groupBy("symbol").agg(
        F.count_if(s == "PASS").alias("passed"), F.count_if(s != "SKIP").alias("total"),
        F.count_if(s == "WARN").alias("warn"), F.count_if(s == "FAIL").alias("fail"))


def store_health(bars: DataFrame, today: Column, stale_days: int = 3) -> DataFrame:
    """Size and freshness of the bar store."""
    return bars.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"),
        F.max("time").alias("last_update")).withColumn(
        "stale", F.date_diff(today, "last_update") > stale_days)


def recompute_audit(published: DataFrame, rel: float = 0.03, abs_tol: float = 0.01) -> DataFrame:
    """Recompute the published figures and compare within tolerance.

    ``published`` carries price, shares, net income, equity and the figures as
    published (``pub_*``).
    """
    formulas = {
        "market_cap": F.col("price") * F.col("shares"),
        "pe": F.when(F.col("net_income_parent") > 0,
                     F.col("price") * F.col("shares") / F.col("net_income_parent")),
        "pb": F.when(F.col("equity_parent") > 0,
                     F.col("price") * F.col("shares") / F.col("equity_parent")),
        "upside": F.col("target_price") / F.col("price") - 1,
    }
    items = F.explode(F.array(*[F.struct(
        F.lit(k).alias("figure"), F.col(f"pub_{k}").alias("published"), v.alias("expected"))
        for k, v in formulas.items()]))
    x = published.select("symbol", items.alias("x")).select("symbol", "x.*")
    gap = F.abs(F.col("published") - F.col("expected"))
    status = (
        F.when(F.col("published").isNull() | F.col("expected").isNull(), "SKIP")
        .when(gap <= F.greatest(F.lit(abs_tol), rel * F.abs("expected")), "PASS")
        .otherwise("WARN"))
    return x.withColumn("status", status)
