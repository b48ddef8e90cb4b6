"""Per-bar technical indicators for all symbols in one pass.

Every window here is partitioned by symbol and ordered by time, so the whole
frame needs one shuffle of the (calendar-bounded) bars; the smoothed columns
come from running window sums (see ``functions.smoothing``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import clip
from fjordquant.functions.smoothing import with_ewm
from fjordquant.session import spread


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("time")


def by_pos() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("i")


def rows(n: int, order: WindowSpec | None = None) -> WindowSpec:
    return (order or by_time()).rowsBetween(-(n - 1), 0)


def guarded(agg: Column, value: Column | str, n: int, order: WindowSpec | None = None) -> Column:
    """An aggregate over the last n rows, null until n values are there."""
    return F.when(F.count(value).over(rows(n, order)) >= n, agg.over(rows(n, order)))


def sma(value: str, n: int) -> Column:
    return guarded(F.avg(value), value, n)


def slope(value: str, n: int) -> Column:
    return guarded(F.regr_slope(F.col(value), F.col("i").cast("double")), value, n, by_pos())


def midpoint(n: int) -> Column:
    """Middle of the highest high and the lowest low of n bars."""
    return F.when(
        F.count("high").over(rows(n)) >= n,
        (F.max("high").over(rows(n)) + F.min("low").over(rows(n))) / 2,
    )


def with_position(bars: DataFrame) -> DataFrame:
    """0-based bar number, previous close, true range, gain and loss."""
    df = spread(bars, "symbol").withColumns({
        "i": F.row_number().over(by_time()) - 1,
        "prev": F.lag("close").over(by_time()),
    })
    delta = F.col("close") - F.col("prev")
    return df.withColumns({
        "tr": F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - F.col("prev")),
            F.abs(F.col("low") - F.col("prev")),
        ),
        "gain": F.greatest(delta, F.when(delta.isNotNull(), 0.0)),
        "loss": F.greatest(-delta, F.when(delta.isNotNull(), 0.0)),
    })


def oscillators(bars: DataFrame) -> DataFrame:
    """EMA 12/26, MACD with signal and histogram, ATR 14, RSI 14."""
    df = with_position(bars)
    df = with_ewm(df, ["symbol"], "i", [
        {"name": "ema12", "value": "close", "alpha": 2 / 13, "start": 0, "min_periods": 12},
        {"name": "ema26", "value": "close", "alpha": 2 / 27, "start": 0, "min_periods": 26},
        {"name": "atr", "value": "tr", "alpha": 1 / 14, "start": 0, "min_periods": 14},
        {"name": "avg_gain", "value": "gain", "alpha": 1 / 14, "start": 1, "min_periods": 14},
        {"name": "avg_loss", "value": "loss", "alpha": 1 / 14, "start": 1, "min_periods": 14},
    ])
    df = df.withColumn("macd", F.col("ema12") - F.col("ema26"))
    df = with_ewm(df, ["symbol"], "i", [
        {"name": "signal", "value": "macd", "alpha": 2 / 10, "start": 25, "min_periods": 1},
    ])
    strength = F.try_divide(F.col("avg_gain"), F.col("avg_loss"))
    return df.withColumns({
        "hist": F.col("macd") - F.col("signal"),
        "rsi": F.when(
            F.col("avg_loss").isNotNull(),
            F.coalesce(100 - 100 / (1 + strength), F.lit(100.0)),
        ),
    })


def with_rsi_window(df: DataFrame, lookback: int = 252) -> DataFrame:
    return df.withColumn("_win", F.collect_list("rsi").over(rows(lookback, by_pos())))


def with_band_levels(df: DataFrame, lookback: int = 252) -> DataFrame:
    """One sorted array of at most ``lookback`` values serves both percentiles;
    a ``percentile`` aggregate would rebuild a hash map per bar."""
    df = df.withColumn("_win", F.sort_array("_win"))

    def at(p: float) -> Column:
        pos = (F.size("_win") - 1) * p
        lo = F.floor(pos).cast("int")
        a, b = F.col("_win")[lo], F.col("_win")[F.ceil(pos).cast("int")]
        return F.when(F.size("_win") >= min(60, lookback), a + (b - a) * (pos - lo))

    return df.withColumns({
        "upper": clip(at(0.9), *S.RSI_UPPER), "lower": clip(at(0.1), *S.RSI_LOWER),
    }).drop("_win")


def adaptive_bands(df: DataFrame, lookback: int = 252) -> DataFrame:
    """Rolling 90th/10th percentile of RSI, held inside fixed limits."""
    return with_band_levels(with_rsi_window(df, lookback), lookback)


def ichimoku(df: DataFrame, preset: str = "six_day_week", shift: int = 26) -> DataFrame:
    tenkan, kijun, senkou = S.ICHIMOKU_PRESETS[preset]
    df = df.withColumns({
        "tenkan": midpoint(tenkan),
        "kijun": midpoint(kijun),
        "base_b": midpoint(senkou),
        "chikou": F.lead("close", shift).over(by_time()),
    })
    df = df.withColumn("base_a", (F.col("tenkan") + F.col("kijun")) / 2)
    return df.withColumns({
        "senkou_a": F.lag("base_a", shift).over(by_time()),
        "senkou_b": F.lag("base_b", shift).over(by_time()),
    })


def cloud_zone(close: Column, a: Column, b: Column) -> Column:
    known = close.isNotNull() & a.isNotNull() & b.isNotNull()
    return F.when(
        known,
        F.when(close > F.greatest(a, b), "tren_may")
        .when(close < F.least(a, b), "duoi_may")
        .otherwise("trong_may"),
    )


def swing(value: str, order: int = 5) -> Column:
    """'H' or 'L' where the bar is the first extreme of its +-order window."""
    around = by_pos().rowsBetween(-order, order)
    earlier = by_pos().rowsBetween(-order, -1)
    v = F.col(value)
    full = F.count(value).over(around) == 2 * order + 1
    high = (v >= F.max(value).over(around)) & (v > F.max(value).over(earlier))
    low = (v <= F.min(value).over(around)) & (v < F.min(value).over(earlier))
    return F.when(full & high, "H").when(full & low, "L")


def crossed(fast: str, slow: str) -> tuple[Column, Column]:
    """(sign of fast-slow, bar number if the sign changed on this bar)."""
    sign = F.signum(F.col(fast) - F.col(slow))
    return sign, F.when(sign != F.lag(sign).over(by_pos()), F.col("i"))


def session_panel(bars: DataFrame) -> DataFrame:
    """Per bar: session number, session-lag returns, 20-session traded value."""
    close = F.col("close")

    def back(n: int) -> Column:
        base = F.lag("close", n).over(by_time())
        return F.when(base > 0, close / base - 1)

    return bars.select(
        "symbol", "time", close.alias("price"),
        F.row_number().over(by_time()).alias("n_sessions"),
        back(1).alias("change_1d"), back(21).alias("ret_1m"),
        back(63).alias("ret_3m"), back(250).alias("ret_1y"),
        F.avg(close * F.col("volume")).over(rows(20)).alias("avg_value_20d"),
    )


def calendar_returns(bars: DataFrame) -> DataFrame:
    """Per symbol at its last bar: returns over 30/91/182/365 calendar days
    (last value on or before), 52-week range, 20-bar averages."""
    day = F.unix_date("time")
    order = Window.partitionBy("symbol").orderBy("d")
    df = bars.withColumn("d", day).withColumn("rn", F.row_number().over(
        Window.partitionBy("symbol").orderBy(F.desc("time"))))
    spans = {"1m": 30, "3m": 91, "6m": 182, "1y": 365}
    df = df.withColumns({
        f"base_{k}": F.last("close").over(order.rangeBetween(Window.unboundedPreceding, -n))
        for k, n in spans.items()
    } | {"last_d": F.max("d").over(Window.partitionBy("symbol"))})
    in_year = F.col("d") > F.col("last_d") - 365
    recent = F.col("rn") <= 20
    return df.groupBy("symbol").agg(
        F.max("time").alias("last_date"),
        F.max_by("close", "d").alias("close"),
        *[(F.max_by("close", "d") / F.max_by(f"base_{k}", "d") - 1).alias(f"ret_{k}")
          for k in spans],
        F.max(F.when(in_year, F.col("close"))).alias("high_52w"),
        F.min(F.when(in_year, F.col("close"))).alias("low_52w"),
        F.avg(F.when(recent, F.col("volume"))).alias("avg_volume_20d"),
        F.avg(F.when(recent, F.col("close") * F.col("volume"))).alias("avg_value_20d"),
    )


def weekly_pairs(bars: DataFrame, index: DataFrame) -> DataFrame:
    """(symbol, week, r, rb): weekly returns of each symbol next to the index.

    A week without a bar keeps the last close (its return is zero), as a
    forward-filled weekly series has it.
    """
    friday = F.next_day(F.date_sub("time", 1), "FRI")
    # one exchange by symbol serves the weekly closes, their windows and those of the caller
    bars = spread(bars.select("symbol", "time", "close"), "symbol")

    def weekly(df: DataFrame, by: list[str]) -> DataFrame:
        last = df.groupBy(*by, friday.alias("week")).agg(F.max_by("close", "time").alias("c"))
        w = Window.partitionBy(*by).orderBy("week") if by else Window.orderBy("week")
        until = F.coalesce(F.date_sub(F.lead("week").over(w), 7), F.col("week"))
        moves = last.withColumns({"r": F.col("c") / F.lag("c").over(w) - 1, "until": until})
        # the week itself carries the return, the empty weeks after it carry zero
        every = F.explode(F.sequence("week", "until", F.expr("interval 7 days")))
        return moves.select(*by, every.alias("w"), "week", "r").select(
            *by, F.when(F.col("w") == F.col("week"), F.col("r")).otherwise(0.0).alias("r"),
            F.col("w").alias("week"))

    s = weekly(bars, ["symbol"]).where(F.col("r").isNotNull())
    b = weekly(index, []).where(F.col("r").isNotNull()).withColumnRenamed("r", "rb")
    return s.join(F.broadcast(b), "week")  # one row a week of the calendar


def rolling_beta(pairs: DataFrame, weeks: int = 104) -> DataFrame:
    """Slope of weekly returns on the index over the last 104 common weeks.

    The weeks of a symbol are cut into blocks of 104.  Any 104 weeks are the end of one block
    and the beginning of the next, so running sums from both sides of the blocks give every
    window without reading it again, and nothing is subtracted from longer sums.
    """
    row = Window.partitionBy("symbol").orderBy("week")
    df = pairs.select("symbol", "week", "r", "rb").withColumn("_at", F.row_number().over(row) - 1)
    df = df.withColumn("_block", F.floor(F.col("_at") / weeks))
    block = Window.partitionBy("symbol", "_block")
    head = block.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    tail = block.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    r, rb = F.col("r"), F.col("rb")
    parts = {"x": F.sum(r), "y": F.sum(rb), "xy": F.sum(r * rb), "yy": F.sum(rb * rb),
             "lo": F.min(rb), "hi": F.max(rb)}
    df = df.withColumns({f"_t_{k}": agg.over(tail) for k, agg in parts.items()})
    df = df.withColumns({f"_h_{k}": agg.over(head) for k, agg in parts.items()})
    back = Window.partitionBy("symbol").orderBy("_at")
    # the last row of a block needs nothing of the block before
    earlier = {k: F.when(F.col("_at") % weeks < weeks - 1, F.lag(f"_t_{k}", weeks - 1).over(back))
               for k in parts}
    df = df.withColumns({f"_e_{k}": c for k, c in earlier.items()})
    n = F.least(F.col("_at") + 1, F.lit(weeks)).cast("long")

    def total(k: str) -> Column:
        return F.col(f"_h_{k}") + F.coalesce(f"_e_{k}", F.lit(0.0))

    spread_out = F.greatest("_h_hi", "_e_hi") > F.least("_h_lo", "_e_lo")
    cxy, cyy = n * total("xy") - total("x") * total("y"), n * total("yy") - total("y") * total("y")
    return df.select(
        "symbol", "week", n.alias("n_weeks"),
        F.when((n >= 26) & spread_out & (cyy > 0), cxy / cyy).alias("beta"))


def weekly_beta(bars: DataFrame, index: DataFrame) -> DataFrame:
    rolled = rolling_beta(weekly_pairs(bars, index))
    return rolled.groupBy("symbol").agg(
        F.max_by("n_weeks", "week").alias("n_weeks"), F.max_by("beta", "week").alias("beta"))
