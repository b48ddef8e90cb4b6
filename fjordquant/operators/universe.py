"""Price metrics, yearly company metrics, the market universe and its index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import change, ratio_if_positive, zero


def price_metrics(bars: DataFrame) -> DataFrame:
    """Newest price, session-lag returns, year-to-date return, traded value."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("time"))
    year_start = F.trunc(bars.agg(F.max("time")).scalar(), "year")
    df = bars.withColumn("rn", F.row_number().over(newest)).withColumn("y0", year_start)

    def back(n: int) -> Column:
        return F.max(F.when(F.col("rn") == n + 1, F.col("close")))

    last = back(0)
    prior_year = F.max_by("close", F.when(F.col("time") < F.col("y0"), F.col("time")))
    return df.groupBy("symbol").agg(
        F.max("time").alias("as_of_price"),
        last.alias("price"),
        F.count(F.lit(1)).alias("n_sessions"),
        *[change(last, back(n)).alias(name) for name, n in
          (("change_1d", 1), ("ret_1m", 21), ("ret_3m", 63), ("ret_1y", 250))],
        change(last, prior_year).alias("ret_ytd"),
        F.avg(F.when(F.col("rn") <= 20, F.col("close") * F.col("volume")))
        .alias("avg_value_20d"),
    )


def series_overlap(a: DataFrame, b: DataFrame, limit: float = 0.001) -> DataFrame:
    """Largest relative gap of two copies of a series, the last session aside."""
    both = a.select("time", F.col("close").alias("x")).join(
        b.select("time", F.col("close").alias("y")), "time")
    last = both.agg(F.max("time")).scalar()
    gap = F.max(F.abs(F.col("x") - F.col("y")) / F.col("y"))
    return both.where(F.col("time") < last).agg(
        F.count(F.lit(1)).alias("n_common"), gap.alias("max_gap"), (gap <= limit).alias("accepted"))


def annual_metrics(annual: DataFrame) -> DataFrame:
    """Profitability, growth, leverage of every (symbol, year)."""
    w = Window.partitionBy("symbol").orderBy("year")
    nip = F.when(
        F.count("net_income_parent").over(Window.partitionBy("symbol")) > 0,
        F.col("net_income_parent")).otherwise(F.col("net_income"))
    df = annual.withColumns({
        "ni": nip, "equity_parent": F.col("equity") - zero("minority_interest"),
    })
    adjacent = F.lag("year").over(w) == F.col("year") - 1
    df = df.withColumns({
        "prev_equity": F.when(adjacent, F.lag("equity_parent").over(w)),
        "prev_ni": F.when(adjacent, F.lag("ni").over(w)),
    })
    known = F.col("short_debt").isNotNull() | F.col("long_debt").isNotNull()
    debt = F.when(known, zero("short_debt") + zero("long_debt"))
    both = (F.col("equity_parent") != 0) & (F.col("prev_equity") != 0)
    avg_equity = F.when(both, (F.col("equity_parent") + F.col("prev_equity")) / 2).otherwise(
        F.col("equity_parent"))
    ebitda = F.col("pbt") + F.abs(zero("interest_expense")) + F.abs(F.col("depreciation"))
    return df.where(F.col("ni").isNotNull()).select(
        "symbol", F.col("year").alias("fin_year"),
        F.make_date(F.col("year") + 1, F.lit(S.ANNUAL_VISIBLE[0]), F.lit(S.ANNUAL_VISIBLE[1]))
        .alias("available_from"),
        F.col("ni").alias("net_income_parent"), "equity_parent", "total_assets", "revenue",
        ratio_if_positive(F.col("ni"), avg_equity).alias("roe"),
        ratio_if_positive("ni", "revenue").alias("net_margin"),
        change("ni", "prev_ni").alias("ni_growth"),
        F.when(ebitda != 0, ebitda).alias("ebitda"),
        (zero(debt) - zero("cash") - zero("short_investments")).alias("net_debt"),
        ratio_if_positive(debt, F.col("equity_parent")).alias("debt_to_equity"),
    )


def with_multiples(df: DataFrame) -> DataFrame:
    """Market value, price multiples and flags of a joined universe row."""
    cap = F.col("price") * F.col("shares")
    df = df.withColumn("market_cap", cap)
    trading = (F.col("ebitda") > 0) & (F.col("company_type") == "NON_FINANCIAL")
    return df.withColumns({
        "pe": ratio_if_positive("market_cap", "net_income_parent"),
        "pb": ratio_if_positive("market_cap", "equity_parent"),
        "ev_ebitda": F.when(
            trading, (F.col("market_cap") + zero("net_debt")) / F.col("ebitda")),
        "eps": ratio_if_positive("net_income_parent", "shares"),
        "pe_ttm": ratio_if_positive("market_cap", "ni_ttm"),
        "eps_ttm": ratio_if_positive("ni_ttm", "shares"),
        "liquidity_flag": F.coalesce(
            F.col("avg_value_20d") >= S.MIN_LIQUID_VALUE, F.lit(False)),
        "has_bctc": F.col("fin_year").isNotNull(),
    })


def latest_universe(securities: DataFrame, bars: DataFrame, annual: DataFrame,
                    ttm_now: DataFrame) -> DataFrame:
    """Today's market table: one row per symbol with prices, statements, multiples."""
    metrics = annual_metrics(annual)
    newest = Window.partitionBy("symbol").orderBy(F.desc("fin_year"))
    latest = metrics.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1)
    prices = price_metrics(bars)
    market_last = bars.agg(F.max("time")).scalar()
    return with_multiples(
        securities.join(prices, "symbol", "left")
        .join(latest.drop("_rn", "available_from"), "symbol", "left")
        .join(ttm_now.select("symbol", "ni_ttm", "ttm_label"), "symbol", "left")
    ).withColumn("traded_today", F.coalesce(F.col("as_of_price") == market_last, F.lit(False)))


def nodes(universe: DataFrame, *keep: str) -> DataFrame:
    """Each row once per industry level: (level, node, ...)."""
    levels = F.array(*[
        F.struct(F.lit(k).alias("level"), F.col(f"icb{k}").alias("node")) for k in (1, 2, 3, 4)
    ])
    columns = keep or tuple(c for c in universe.columns if not c.startswith("icb"))
    return universe.select(*columns, F.explode(levels).alias("_l")).select(
        "_l.level", "_l.node", *columns)


def aligned_panel(bars: DataFrame, calendar: DataFrame, flags: DataFrame) -> DataFrame:
    """All symbols on one market calendar, missing bars null, never pivoted."""
    last = calendar.agg(F.max("idx")).scalar()
    grid = bars.select("symbol").distinct().withColumn("last", last).select(
        "symbol", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("idx"))
    adv = F.avg(F.col("close") * F.col("volume")).over(
        Window.partitionBy("symbol").orderBy("time").rowsBetween(-19, 0))
    own = bars.withColumn("adv20", adv).join(
        flags.select("symbol", "time", "locked"), ["symbol", "time"]
    ).join(calendar, "time").select("symbol", "idx", "open", "close", "adv20", "locked")
    return (
        grid.join(own, ["symbol", "idx"], "left").join(calendar, "idx")
        .withColumn("locked", F.coalesce("locked", F.lit(False)))
        .select("symbol", "time", "open", "close", "adv20", "locked")
    )


def node_index(universe: DataFrame, bars: DataFrame, calendar: DataFrame,
               sessions: int = 260) -> DataFrame:
    """Capital-weighted index of every industry node, rebased to 100.

    Forward-filled closes times fixed shares change only on days with a bar, so
    the level of a node is the running sum of its members' changes: no grid of
    symbols by days is built.  Only symbols priced on the first day count.
    """
    last = calendar.agg(F.max("idx")).scalar()
    own = bars.join(calendar, "time").where(F.col("idx") > last - sessions)
    w = Window.partitionBy("symbol").orderBy("idx")
    first = calendar.agg(F.max("idx")).scalar() - (sessions - 1)
    moves = own.withColumns({
        "start": F.min("idx").over(Window.partitionBy("symbol")) == F.greatest(first, F.lit(0)),
        "move": F.col("close") - F.coalesce(F.lag("close").over(w), F.lit(0.0)),
    }).where("start")
    members = nodes(universe.where(F.col("shares").isNotNull()), "symbol", "shares")
    daily = moves.join(members, "symbol").groupBy("level", "node", "time").agg(
        F.sum(F.col("move") * F.col("shares")).alias("delta"))
    order = Window.partitionBy("level", "node").orderBy("time")
    value = F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("cap", value).select(
        "level", "node", "time", (F.col("cap") / F.first("cap").over(order) * 100).alias("value"))
