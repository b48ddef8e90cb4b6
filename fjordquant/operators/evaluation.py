"""Forward returns, rank information coefficients and their tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.ordering import COARSE, RESOLUTION, order_bucket


def own_session_forward_returns(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """open[t+1+h] / open[t+1] - 1 on the symbol's own sessions."""
    w = Window.partitionBy("symbol").orderBy("time")
    entry = F.lead("open", 1).over(w)
    return bars.select("symbol", "time", *[
        (F.lead("open", 1 + h).over(w) / entry - 1).alias(f"fwd_{h}") for h in horizons])


def market_forward_returns(scores: DataFrame, bars: DataFrame, calendar: DataFrame,
                           delay: int = 1) -> DataFrame:
    """Forward open returns on the market calendar; null past its end or without a bar.

    Only the bars on a session that some signal date asks for are kept, and all prices of
    one (as_of, symbol) meet in one aggregate, so the bars are not shuffled per horizon.
    """
    sessions = F.broadcast(calendar)  # one row a session
    signal = scores.select("as_of").distinct().join(
        sessions.withColumnRenamed("time", "as_of"), "as_of")
    ahead = {"0": delay} | {str(months): delay + h for months, h in S.HORIZONS.items()}
    asked = signal.select("as_of", F.explode(F.array(*[
        F.struct(F.lit(k).alias("at"), (F.col("idx") + n).alias("idx")) for k, n in ahead.items()
    ])).alias("x")).select("as_of", "x.*")
    opens = bars.select("symbol", "time", "open").join(sessions, "time").join(
        F.broadcast(asked), "idx")
    prices = opens.groupBy("as_of", "symbol").agg(*[
        F.max(F.when(F.col("at") == k, F.col("open"))).alias(f"_o{k}") for k in ahead])
    out = scores.join(signal.select("as_of"), "as_of", "left_semi").join(
        prices, ["as_of", "symbol"], "left")
    return out.select(*scores.columns, *[
        (F.col(f"_o{months}") / F.col("_o0") - 1).alias(f"fwd_{months}m") for months in S.HORIZONS])


def with_cross_ranks(panel: DataFrame, factors: list[str], returns: list[str]) -> DataFrame:
    """One row per panel row: ``as_of`` and ``r_{factor}``, ``r_{return}``, the tie-averaged ranks
    at that date, as arrays.  A factor is ranked among the rows that have both it and a return,
    once for each return; a return once for each factor.

    ``panel`` is a written table.  All ranks of a series come from one sort: its values carry
    a flag for each series of the other side, and counts of the flags run along the values.
    A date's values are dealt over buckets in value order, so no task holds a date.
    """
    series = [*factors, *returns]

    def flags(k: int) -> Column:
        other = returns if k < len(factors) else factors
        return F.array(*[F.col(c).isNotNull().cast("int") for c in other])

    # numbers of a written table's rows: the same whenever a task runs again
    values = panel.withColumn("_id", F.monotonically_increasing_id()).select(
        "as_of", "_id", F.explode(F.array(*[
            F.struct(F.lit(k).alias("s"), F.col(c).cast("double").alias("v"), flags(k).alias("f"))
            for k, c in enumerate(series)])).alias("x")).select("as_of", "_id", "x.*").where(
        F.col("v").isNotNull() & F.col("as_of").isNotNull())
    values = values.withColumn("b", F.floor(order_bucket(F.col("v")) / (RESOLUTION // COARSE)))
    group, width = ["as_of", "s"], max(len(factors), len(returns))
    flag = [F.coalesce(F.get("f", F.lit(j)), F.lit(0)) for j in range(width)]
    upto = Window.partitionBy(*group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = values.groupBy(*group, "b").agg(
        *[F.sum(c).alias(f"_n{j}") for j, c in enumerate(flag)]).select(
        *group, "b", *[F.coalesce(F.sum(f"_n{j}").over(upto), F.lit(0)).alias(f"_o{j}")
                       for j in range(width)])
    bucket = Window.partitionBy(*group, "b").orderBy("v").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy(*group, "b", "v")
    ranked = values.select(*group, "b", "v", "_id", *[c.alias(f"_f{j}") for j, c in enumerate(flag)])
    ranked = ranked.withColumns({f"_c{j}": F.sum(f"_f{j}").over(bucket) for j in range(width)})
    ranked = ranked.withColumns({f"_t{j}": F.sum(f"_f{j}").over(ties) for j in range(width)})
    # few buckets a date and series, sent to the values
    ranked = ranked.join(F.broadcast(before), [*group, "b"])
    ranks = F.array(*[F.when(F.col(f"_f{j}") == 1, F.col(f"_o{j}") + F.col(f"_c{j}") - (
        F.col(f"_t{j}") - 1) / 2.0) for j in range(width)])
    return ranked.select("as_of", "_id", "s", ranks.alias("r")).groupBy("as_of", "_id").agg(*[
        F.max(F.when(F.col("s") == k, F.col("r"))).alias(f"r_{c}") for k, c in enumerate(series)])


def rank_ic(ranks: DataFrame, min_names: int = S.MIN_CROSS_SECTION) -> DataFrame:
    """Spearman correlation per (factor, horizon, as_of) of long rows
    (factor, horizon, as_of, rx, ry).

    Equal ranks have none: the deviation of merged parts is then a rounding error, not zero.
    """
    keys = ["factor", "horizon", "as_of"]
    both = ranks.where(F.col("rx").isNotNull() & F.col("ry").isNotNull())
    varies = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(varies, F.try_divide(
            F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("ic"),
    ).where((F.col("n") >= min_names) & F.col("ic").isNotNull())


def long_panel(scores: DataFrame, factors: list[str], horizons: list[int] | None = None) -> DataFrame:
    """(factor, horizon, as_of, rx, ry) from wide, written scores with forward returns."""
    returns = {m: f"fwd_{m}m" for m in horizons or S.HORIZONS}
    ranked = with_cross_ranks(scores, factors, list(returns.values()))
    pairs = F.explode(F.array(*[F.struct(
        F.lit(c).alias("factor"), F.lit(m).alias("horizon"), F.get(f"r_{c}", F.lit(j)).alias("rx"),
        F.get(f"r_{y}", F.lit(k)).alias("ry"))
        for k, c in enumerate(factors) for j, (m, y) in enumerate(returns.items())])).alias("p")
    return ranked.select("as_of", pairs).select("as_of", "p.*")


def summarise_ic(ic: DataFrame) -> DataFrame:
    """Mean, deviation, ICIR, t, Newey-West t and share of positive months.

    The coefficient series has one row per month, so its windows are small.
    """
    keys = ["factor", "horizon"]
    w = Window.partitionBy(*keys).orderBy("as_of")
    lag_count = F.lit(0)
    for months, lags in S.NEWEY_WEST_LAGS.items():
        lag_count = F.when(F.col("horizon") == months, lags).otherwise(lag_count)
    df = ic.withColumn("c", F.col("ic") - F.avg("ic").over(Window.partitionBy(*keys)))
    df = df.withColumn("lags", lag_count)
    deepest = max(S.NEWEY_WEST_LAGS.values())
    cross = F.lit(0.0)
    for k in range(1, deepest + 1):
        weight = F.when(F.col("lags") >= k, 1.0 - k / (F.col("lags") + 1.0)).otherwise(0.0)
        cross = cross + 2.0 * weight * F.coalesce(
            F.col("c") * F.lag("c", k).over(w), F.lit(0.0))
    df = df.withColumn("term", F.col("c") * F.col("c") + cross)
    n, mean, sd = F.count(F.lit(1)), F.avg("ic"), F.stddev_samp("ic")
    long_run = F.sum("term") / n
    return df.groupBy(*keys).agg(
        mean.alias("ic_mean"), sd.alias("ic_sd"),
        F.when(sd > 0, mean / sd).alias("icir"),
        F.when(sd > 0, mean / sd * F.sqrt(n)).alias("t_stat"),
        F.when((n >= 2) & (long_run > 0), mean / F.sqrt(long_run / n)).alias("t_newey_west"),
        F.avg((F.col("ic") > 0).cast("double")).alias("share_positive"),
        n.alias("n_months"),
    )
