"""Target weights, set-based portfolio returns, performance and walk-forward choice.

Portfolio returns are defined on sets: weights decided at a signal date are due
``delay`` market sessions later.  Each symbol moves to its new weight at its own
first open on or after that session, and keeps the old one until then; half the
round-trip fee is paid on every weight change and the sales tax on every reduction.
There is no order book, no lot and no settlement queue, so a date never depends on
Python state of the date before.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.session import materialise

RANKING = ["score", "upside", "avg_value_20d"]


# --------------------------------------------------------------------- targets
def sector_cap(n: int, share: float = S.SECTOR_CAP) -> int:
    return max(1, int(share * n))


def select_top(scores: DataFrame, n: int, cap_share: float = S.SECTOR_CAP,
               exclude: DataFrame | None = None) -> DataFrame:
    """Best n per date with at most ``cap`` per top industry.

    Taking greedily under a per-industry cap equals keeping the best ``cap`` of
    each industry and then the best n of what is left; both are top-k filters,
    which Spark cuts down before the shuffle.
    """
    pool = scores.where("eligible")
    if exclude is not None:
        pool = pool.join(exclude.select("symbol"), "symbol", "left_anti")
    keys = [*[F.desc_nulls_last(c) for c in RANKING], F.asc("symbol")]
    per = Window.partitionBy("as_of", "icb1").orderBy(*keys)
    all_ = Window.partitionBy("as_of").orderBy(*keys)
    capped = pool.withColumn("_r", F.row_number().over(per)).where(
        F.col("_r") <= sector_cap(n, cap_share))
    return capped.withColumn("rank", F.row_number().over(all_)).where(F.col("rank") <= n).select(
        "as_of", "symbol", "icb1", "rank")


def rebalance_dates(freq: str) -> Column:
    return F.lit(True) if freq == "M" else F.month("as_of").isin(3, 6, 9, 12)


def strategy_targets(scores: DataFrame, n: int, freq: str,
                     exclude: DataFrame | None = None) -> DataFrame:
    """(as_of, symbol, weight) = 1/N; fewer than N symbols leave the rest in cash."""
    return select_top(scores.where(rebalance_dates(freq)), n, exclude=exclude).select(
        "as_of", "symbol", F.lit(1.0 / n).alias("weight"))


def equal_weight_targets(scores: DataFrame, freq: str = "M") -> DataFrame:
    day = scores.where(rebalance_dates(freq))
    n = day.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"))
    return day.join(n, "as_of").select("as_of", "symbol", (1.0 / F.col("n")).alias("weight"))


def cap_targets(scores: DataFrame, n: int, freq: str = "M") -> DataFrame:
    order = Window.partitionBy("as_of").orderBy(F.desc_nulls_last("market_cap"), "symbol")
    return scores.where(rebalance_dates(freq)).withColumn(
        "_r", F.row_number().over(order)).where(F.col("_r") <= n).select(
        "as_of", "symbol", F.lit(1.0 / n).alias("weight"))


def named(targets: DataFrame, name: str, freq: str = "M") -> DataFrame:
    return targets.withColumn("strategy", F.lit(name)).withColumn("freq", F.lit(freq))


def grid_targets(scores: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(strategy, freq, as_of, symbol, weight) of all configurations."""
    out = None
    for n, freq in S.GRID:
        t = named(strategy_targets(scores, n, freq, exclude), f"top{n}_{freq}", freq)
        out = t if out is None else out.unionByName(t)
    return out


def in_scenarios(targets: DataFrame, scenarios: list[tuple[str, int, float]]) -> DataFrame:
    """Targets once per scenario (name, delay in sessions, round-trip fee), as columns."""
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(d).alias("delay"),
                              F.lit(f).alias("fee")) for s, d, f in scenarios])
    return targets.withColumn("_s", F.explode(rows)).select(*targets.columns, "_s.*")


# ------------------------------------------------------------------ daily returns
def rebalances(dates: DataFrame, calendar: DataFrame, plans: DataFrame) -> DataFrame:
    """(freq, delay, k, as_of, from, until): signal dates and the sessions they rule.

    ``dates`` holds all signal dates (as_of), ``plans`` the (freq, delay) in use.  A date
    without targets still rules its sessions: everything is sold.
    """
    signal = dates.join(calendar.withColumnsRenamed({"time": "as_of", "idx": "_s"}), "as_of")
    last = calendar.agg(F.max("idx")).scalar()
    frequencies = F.explode(F.when(rebalance_dates("Q"), F.array(F.lit("M"), F.lit("Q")))
                            .otherwise(F.array(F.lit("M"))))
    due = signal.withColumn("freq", frequencies).join(plans, "freq").withColumn(
        "from", F.col("_s") + F.col("delay")).where(F.col("from") <= last)
    w = Window.partitionBy("freq", "delay").orderBy("as_of")
    return due.select("freq", "delay", F.row_number().over(w).alias("k"), "as_of", "from",
                      F.coalesce(F.lead("from").over(w), last + 1).alias("until"))


def weight_moves(targets: DataFrame, bars: DataFrame, calendar: DataFrame, dates: DataFrame
                 ) -> DataFrame:
    """(scenario, strategy, fee, time, gross, traded, sold): per session, before costs.

    A weight that is in force after a bar earns the move to the symbol's next bar: to
    its close while the weight rules on, else to its open, where the weight is sold.
    On the first own bar since it is due, it is bought at the open.
    """
    spans = rebalances(dates, calendar, targets.select("freq", "delay").distinct())
    # the sessions and the weights read the schedules, which are worked out once
    spans = materialise(spans.withColumn("key", F.concat_ws(":", "freq", "delay", "k")))
    # calendar and schedules hold a row a session and plan, so they are sent to the bars
    sessions = F.broadcast(spans.select("key", "from", "until", F.explode(
        F.sequence("from", F.col("until") - 1)).alias("idx")))
    own = Window.partitionBy("symbol").orderBy("idx")
    placed = bars.select("symbol", "time", "open", "close").join(
        targets.select("symbol").distinct(), "symbol", "left_semi").join(
        F.broadcast(calendar), "time").select(
        "symbol", "idx", "time", "open", "close", F.lag("idx").over(own).alias("before"),
        F.lead(F.struct("idx", "time", "open", "close")).over(own).alias("next"))
    # all weights of a symbol by schedule: one row a symbol, bounded by the signal dates, so
    # bars, weights and the sums of a symbol's moves share one partitioning by symbol
    held = targets.join(F.broadcast(spans.select("freq", "delay", "as_of", "key")),
                        ["freq", "delay", "as_of"]).repartition("symbol").groupBy("symbol", "key").agg(
        F.collect_list(F.struct("scenario", "strategy", "fee", "weight")).alias("of")).groupBy(
        "symbol").agg(F.map_from_entries(F.collect_list(F.struct("key", "of"))).alias("held"))
    ruled = placed.join(held, "symbol").join(sessions, "idx").withColumn(
        "h", F.explode(F.try_element_at("held", F.col("key")))).select(
        "symbol", "time", "open", "close", "before", "next", "from", "until", "h.*")
    first = F.col("before").isNull() | (F.col("before") < F.col("from"))
    on = F.col("next.idx") < F.col("until")
    zero = F.lit(0.0)
    legs = ruled.select(
        "scenario", "strategy", "fee", "symbol", F.explode(F.array(
            F.struct(F.col("time"),
                     F.when(first, F.col("weight") * (F.col("close") / F.col("open") - 1))
                     .otherwise(zero).alias("gross"),
                     F.when(first, F.col("weight")).otherwise(zero).alias("change")),
            F.struct(F.col("next.time").alias("time"),
                     (F.col("weight") * (F.when(on, F.col("next.close")).otherwise(F.col("next.open"))
                                         / F.col("close") - 1)).alias("gross"),
                     F.when(on, zero).otherwise(-F.col("weight")).alias("change")))).alias("x"))
    legs = legs.select("scenario", "strategy", "fee", "symbol", "x.*").where("time IS NOT NULL")
    return legs.groupBy("scenario", "strategy", "fee", "symbol", "time").agg(
        F.sum("gross").alias("gross"), F.sum("change").alias("change")).groupBy(
        "scenario", "strategy", "fee", "time").agg(
        F.sum("gross").alias("gross"), F.sum(F.abs("change")).alias("traded"),
        F.sum(F.greatest(-F.col("change"), zero)).alias("sold"))


def daily_returns(targets: DataFrame, bars: DataFrame, calendar: DataFrame, dates: DataFrame,
                  tax: float = S.SELL_TAX) -> DataFrame:
    """(scenario, strategy, time, r, traded) of every session from the first one due.

    ``targets``: scenario, strategy, freq, delay, fee, as_of, symbol, weight.  All
    scenarios and strategies are one plan over one scan of the bars.
    """
    plans = targets.select("scenario", "strategy", "freq", "delay").distinct()
    begin = rebalances(dates, calendar, plans.select("freq", "delay").distinct()).groupBy(
        "freq", "delay").agg(F.min("from").alias("from"))
    last = calendar.agg(F.max("idx")).scalar()
    days = plans.join(begin, ["freq", "delay"]).select(
        "scenario", "strategy", F.explode(F.sequence("from", last)).alias("idx")).join(calendar, "idx")
    moves = weight_moves(targets, bars, calendar, dates)
    cost = F.col("traded") * F.col("fee") / 2 + F.col("sold") * tax
    return days.join(moves, ["scenario", "strategy", "time"], "left").select(
        "scenario", "strategy", "time", F.coalesce(F.col("gross") - cost, F.lit(0.0)).alias("r"),
        F.coalesce("traded", F.lit(0.0)).alias("traded"))


def equity(returns: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Compounded equity, 1 before the first session (one row per session)."""
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn(
        "equity", F.exp(F.sum(F.log1p(F.greatest("r", F.lit(-0.999999)))).over(w)))


# ------------------------------------------------------------------ performance
def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function: density times the sum of z^(2q+1) / (2q+1)!!."""
    x = F.abs(z)
    start = F.struct(x.alias("term"), x.alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(199)), start, lambda acc, q: F.struct(
        (acc["term"] * x * x / (2 * q + 3)).alias("term"),
        (acc["sum"] + acc["term"] * x * x / (2 * q + 3)).alias("sum")))["sum"]
    half = F.when(x > 8, 0.5).otherwise(
        F.least(F.lit(0.5), F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * total))
    return F.when(z.isNotNull() & ~F.isnan(z), 0.5 + F.signum(z) * half)


def expected_max_sharpe(n_trials: int, sr_variance: Column) -> Column:
    if n_trials <= 1:
        return F.lit(0.0)
    inv, g = NormalDist().inv_cdf, S.EULER_GAMMA
    import math

    factor = (1 - g) * inv(1 - 1 / n_trials) + g * inv(1 - 1 / (n_trials * math.e))
    return F.when(sr_variance > 0, F.sqrt(sr_variance) * factor).otherwise(0.0)


def moments(returns: DataFrame, by: list[str]) -> DataFrame:
    """Per-period Sharpe with skewness and raw kurtosis, annualised Sharpe, Sortino."""
    n, sd = F.count("r"), F.stddev_samp("r")
    down = F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)))
    year = F.sqrt(F.lit(float(S.TRADING_DAYS)))
    ok = (n >= 3) & (sd > 0)
    return returns.groupBy(*by).agg(
        n.alias("n_obs"),
        F.when(ok, F.avg("r") / sd).otherwise(0.0).alias("sr"),
        F.when(ok, F.skewness("r")).otherwise(0.0).alias("skew"),
        F.when(ok, F.kurtosis("r") + 3).otherwise(3.0).alias("kurtosis"),
        F.when(F.stddev_pop("r") > 0, F.avg("r") / F.stddev_pop("r") * year).otherwise(0.0)
        .alias("sharpe"),
        F.when(down > 0, F.avg("r") / down * year).otherwise(0.0).alias("sortino"))


def with_psr(df: DataFrame, benchmark: Column | float = 0.0, name: str = "psr") -> DataFrame:
    """Probability that the true Sharpe exceeds a benchmark Sharpe."""
    b = F.lit(benchmark) if isinstance(benchmark, float) else benchmark
    term = 1 - F.col("skew") * F.col("sr") + (F.col("kurtosis") - 1) / 4 * F.pow("sr", F.lit(2.0))
    z = F.when((F.col("n_obs") >= 2) & (term > 0),
               (F.col("sr") - b) * F.sqrt(F.col("n_obs") - 1) / F.sqrt(term))
    return df.withColumn(name, normal_cdf(z))


def drawdown_and_growth(equity_df: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    df = equity_df.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    n = F.count(F.lit(1))
    growth = F.max_by("equity", "time") / F.min_by("equity", "time")
    return df.groupBy(*by).agg(
        n.alias("n_sessions"), (growth - 1).alias("total_return"),
        F.when(n >= 2, F.pow(growth, S.TRADING_DAYS / n) - 1).otherwise(0.0).alias("cagr"),
        F.min("dd").alias("max_drawdown"))


def monthly_returns(equity_df: DataFrame, by: list[str]) -> DataFrame:
    """Month-end returns; the first month counts from its first value."""
    month = F.trunc("time", "month")
    ends = equity_df.groupBy(*by, month.alias("month")).agg(
        F.max_by("equity", "time").alias("last"), F.min_by("equity", "time").alias("first"),
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("month")
    prev = F.lag("last").over(w)
    r = F.when(prev.isNotNull(), F.col("last") / prev - 1).when(
        F.col("n") > 1, F.col("last") / F.col("first") - 1)
    return ends.withColumn("r", r).where(F.col("r").isNotNull()).select(*by, "month", "r")


def win_rates(equity_df: DataFrame, benchmark: DataFrame, by: list[str]) -> DataFrame:
    """Share of positive months and of months ahead of the benchmark."""
    mine = monthly_returns(equity_df, by)
    other = monthly_returns(benchmark.withColumn("_one", F.lit(1)), ["_one"]).select(
        "month", F.col("r").alias("rb"))
    return mine.join(other, "month", "left").groupBy(*by).agg(
        F.avg((F.col("r") > 0).cast("double")).alias("positive_months"),
        F.avg((F.col("r") > F.col("rb")).cast("double")).alias("months_ahead"),
        F.count(F.lit(1)).alias("n_months"))


def trade_statistics(trades: DataFrame, by: list[str]) -> DataFrame:
    """Profit factor, hit rate and mean of trade returns ``r``."""
    gain = F.coalesce(F.sum(F.when(F.col("r") > 0, F.col("r"))), F.lit(0.0))
    loss = F.coalesce(F.abs(F.sum(F.when(F.col("r") < 0, F.col("r")))), F.lit(0.0))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.when(loss > 0, gain / loss).when(gain > 0, float("inf")).otherwise(0.0)
        .alias("profit_factor"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.avg("r").alias("mean_return"))


def turnover_per_year(returns: DataFrame, by: list[str]) -> DataFrame:
    """One-way weight turnover per year."""
    years = F.count(F.lit(1)) / F.lit(float(S.TRADING_DAYS))
    return returns.groupBy(*by).agg((F.sum("traded") / 2 / years).alias("turnover"))


# ------------------------------------------------------------------ walk-forward
def train_test_windows(calendar: DataFrame, train: int = S.TRAIN_MONTHS,
                       test: int = S.TEST_MONTHS) -> DataFrame:
    """Rolling windows from the first to the last session; short last ones drop."""
    span = calendar.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    starts = F.explode(F.sequence("lo", "hi", F.expr(f"interval {test} months")))
    w = span.select("hi", starts.alias("train_start")).withColumn(
        "test_start", F.add_months("train_start", train))
    w = w.withColumn("test_end", F.least(F.add_months("test_start", test), F.col("hi")))
    return w.where((F.col("test_start") < F.col("hi"))
                   & (F.date_diff("test_end", "test_start") >= 20)).select(
        "train_start", "test_start", "test_end")


def _in_window(returns: DataFrame, windows: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of ``returns`` inside [lo, hi) of each window (a dozen windows)."""
    spans = F.collect_list(F.struct("train_start", "test_start", "test_end"))
    packed = returns.withColumn("_w", windows.agg(spans).scalar())
    hit = F.filter("_w", lambda x: (F.col("time") >= x[lo]) & (F.col("time") < x[hi]))
    return packed.withColumn("_x", F.explode(hit)).select(*returns.columns, "_x.*")


def walk_forward(returns: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trials per window, the chosen strategy per window, and the test returns."""
    trials = moments(_in_window(returns, windows, "train_start", "test_start"),
                     ["train_start", "test_start", "test_end", "strategy"])
    # ties go to the configuration listed first in the grid
    order = F.array_position(F.array(*[F.lit(f"top{n}_{f}") for n, f in S.GRID]), F.col("strategy"))
    best = F.max_by("strategy", F.struct("sharpe", -order))
    chosen = trials.groupBy("train_start", "test_start", "test_end").agg(
        best.alias("strategy"), F.max("sharpe").alias("train_sharpe"))
    test = _in_window(returns, windows, "test_start", "test_end").join(
        chosen.select("train_start", "strategy", "train_sharpe"), ["train_start", "strategy"])
    return trials, chosen, test.select("train_start", "strategy", "time", "r")


def fixed_choice(returns: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Test returns of choices made elsewhere: each window follows its chosen strategy."""
    spans = chosen.select("train_start", "test_start", "test_end").distinct()
    inside = _in_window(returns, spans, "test_start", "test_end")
    return inside.join(chosen.select("train_start", "strategy"), ["train_start", "strategy"]).select(
        *by, "train_start", "strategy", "time", "r")


def sharpe_report(trials: DataFrame, test: DataFrame, n_trials: int = len(S.GRID)) -> DataFrame:
    """PSR and deflated Sharpe of the stitched test returns."""
    per_day = F.col("sharpe") / F.sqrt(F.lit(float(S.TRADING_DAYS)))
    spread = trials.groupBy("train_start").agg(F.var_samp(per_day).alias("v"))
    variance = spread.agg(F.avg("v")).scalar()
    m = moments(test.withColumn("_one", F.lit(1)), ["_one"]).drop("_one").withColumn(
        "sr_variance", variance)
    m = m.withColumn("sr_star", expected_max_sharpe(n_trials, F.col("sr_variance")))
    return with_psr(with_psr(m), F.col("sr_star"), "dsr")


def top_winners(bars: DataFrame, start: Column, end: Column, share: float = 0.10) -> DataFrame:
    """The best share of symbols by total return in [start, end).

    The cut is an order statistic of the returns, found without sorting all
    symbols in one place.
    """
    from fjordquant.functions.ordering import value_counts

    span = bars.where((F.col("time") >= start) & (F.col("time") < end))
    total = span.groupBy("symbol").agg(
        F.count("close").alias("n"),
        (F.max_by("close", "time") / F.min_by("close", "time") - 1).alias("total"))
    total = total.where(F.col("n") > 1)
    ranked = value_counts(total.withColumn("_g", F.lit(1)), ["_g"], "total").select(
        F.col("_v").alias("total"),
        (F.col("_total") - F.col("_below") - F.col("_n")).alias("above"),
        F.ceil(F.col("_total") * share).alias("k"), F.col("_n").alias("ties"))
    hit = total.join(ranked, "total").where(F.col("above") < F.col("k"))
    whole = F.col("above") + F.col("ties") <= F.col("k")
    # only the values tied at the cut need an order among themselves
    tie = Window.partitionBy("total").orderBy("symbol")
    cut = hit.where(~whole).withColumn("_t", F.row_number().over(tie)).where(
        F.col("above") + F.col("_t") <= F.col("k"))
    return hit.where(whole).select("symbol", "total").unionByName(cut.select("symbol", "total"))


def order_sizes(targets: DataFrame, holdings: DataFrame, prices: DataFrame,
                capital: float) -> DataFrame:
    """Orders in shares: value gap capped at a tenth of daily value, whole lots.

    A holding without a target weight is sold in full.
    """
    j = targets.join(holdings, ["as_of", "symbol"], "full").join(prices, ["as_of", "symbol"])
    have = F.coalesce("shares_held", F.lit(0)).cast("double")
    weight = F.coalesce("weight", F.lit(0.0))
    diff = weight * capital - have * F.col("ref")
    cap = F.coalesce("adv20", F.lit(0.0)) * S.PARTICIPATION
    buy = F.floor(F.least(diff, cap) / F.col("ref") / S.LOT) * S.LOT
    sell = F.least(have, F.ceil(F.least(-diff, cap) / F.col("ref") / S.LOT) * S.LOT)
    qty = (F.when((weight == 0) & (have > 0), -have).when(diff > 0, buy).when(diff < 0, -sell)
           .otherwise(0))
    return j.select("as_of", "symbol", qty.cast("long").alias("quantity")).where(
        F.col("quantity") != 0)


def verdict(strategy: DataFrame, benchmarks: DataFrame, ic: DataFrame, doubled_fee: DataFrame
            ) -> DataFrame:
    """The four criteria, one row.

    ``strategy``: dsr and sharpe of the out-of-sample line; ``benchmarks``: name and
    sharpe, of the index also cagr; ``ic``: ic_mean and t_newey_west of the total score
    over three months; ``doubled_fee``: cagr of the same choices at twice the fee.
    """
    index = benchmarks.where("name = 'index'").select(F.col("cagr").alias("_index"))
    best = benchmarks.agg(F.max("sharpe").alias("_best"))
    row = strategy.join(best).join(index).join(doubled_fee.select(F.col("cagr").alias("_fee2"))).join(
        ic.select("ic_mean", "t_newey_west"), how="left")
    tests = {
        "significant": F.col("dsr") >= 0.95,
        "predictive": (F.col("ic_mean") > 0) & (F.col("t_newey_west") >= 2),
        "sharpe_ahead": F.col("sharpe") > F.col("_best"),
        "fees_survived": F.col("_fee2") > F.col("_index"),
    }
    row = row.select(*[F.coalesce(t, F.lit(False)).alias(c) for c, t in tests.items()])
    passed = sum((F.col(c).cast("int") for c in tests), F.lit(0))
    return row.withColumn("criteria_met", passed).withColumn("edge", passed == len(tests))
