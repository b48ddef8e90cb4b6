"""Bar cleaning, calendar rules and eligibility filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import lookup

# header aliases of vendor bar files (fixed values)
HEADER_ALIASES = {
    "<ticker>": "symbol", "ticker": "symbol",
    "<dtyyyymmdd>": "time", "dtyyyymmdd": "time", "date": "time", "tradingdate": "time",
    "<open>": "open", "<high>": "high", "<low>": "low", "<close>": "close",
    "<volume>": "volume", "vol": "volume",
}
PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]


def normalise_headers(df: DataFrame) -> DataFrame:
    names = {}
    for c in df.columns:
        plain = c.strip().lstrip("﻿").lower()
        names[c] = HEADER_ALIASES.get(plain, plain)
    return df.withColumnsRenamed(names)


def parse_time(df: DataFrame) -> DataFrame:
    """``time`` to a date: all-yyyyMMdd integers, else epoch seconds, else text."""
    kind = df.schema["time"].dataType.typeName()
    if kind in ("string", "date", "timestamp", "timestamp_ntz"):
        parsed = F.col("time").cast("date") if kind != "string" else F.to_date(
            F.expr("try_cast(time AS timestamp)")
        )
        return df.withColumn("time", parsed)
    bounds = df.agg(
        F.coalesce(F.bool_and(F.col("time").between(19000101, 29991231)), F.lit(True))
    )
    compact = F.to_date(F.try_to_timestamp(F.col("time").cast("string"), F.lit("yyyyMMdd")))
    epoch = F.to_date(F.timestamp_seconds(F.col("time")))
    return df.withColumn("time", F.when(bounds.scalar(), compact).otherwise(epoch))


def repair_range(df: DataFrame) -> DataFrame:
    """The low covers and the high tops open and close."""
    return df.withColumns({
        "low": F.least("low", "open", "close"),
        "high": F.greatest("high", "open", "close"),
    })


def clean_bars(df: DataFrame, ordinal: str) -> DataFrame:
    """Typed, filtered, one row per (symbol, time): the one that came last.

    The duplicate choice is a ``max_by`` aggregate with map-side combine, so a
    day delivered a million times never meets in one task.
    """
    work = parse_time(normalise_headers(df))
    work = work.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in PRICE_COLUMNS})
    work = work.withColumn("symbol", F.upper(F.trim(F.col("symbol").cast("string"))))
    work = work.where(
        F.col("time").isNotNull() & (F.col("close") > 0)
        & (F.coalesce(F.col("volume"), F.lit(0.0)) >= 0)
    )
    last = F.max_by(F.struct(*PRICE_COLUMNS), ordinal).alias("bar")
    return repair_range(work.groupBy("symbol", "time").agg(last).select("symbol", "time", "bar.*"))


def price_band(exchange: Column, default: float) -> Column:
    return lookup(S.PRICE_BAND, exchange, F.lit(default))


def tick_size(price: Column, exchange: Column) -> Column:
    hose = F.when(price < 10_000, 10.0).when(price < 50_000, 50.0).otherwise(100.0)
    return F.when(F.upper(exchange) == "HOSE", hose).otherwise(100.0)


def session_flags(bars: DataFrame, securities: DataFrame) -> DataFrame:
    """Per bar: daily change, band breach, and locked at the floor price."""
    w = Window.partitionBy("symbol").orderBy("time")
    df = bars.join(securities.select("symbol", "exchange"), "symbol")
    df = df.withColumn("prev", F.lag("close").over(w))
    band = price_band(F.col("exchange"), 0.07)
    floor = F.col("prev") * (1 - band) + tick_size(F.col("prev"), F.col("exchange"))
    change = F.col("close") / F.col("prev") - 1
    return df.withColumns({
        "change": change,
        "band": band,
        "breach": F.coalesce(F.abs(change) > band + S.BAND_TOLERANCE, F.lit(False)),
        "tick": tick_size(F.col("prev"), F.col("exchange")),
        "locked": F.coalesce(
            (F.col("close") <= floor) & (F.col("low") >= F.col("close") * (1 - 1e-6)),
            F.lit(False),
        ),
    })


def tradable_symbols(
    bars: DataFrame, as_of: str | None = None, min_volume: float = S.TRADABLE["min_volume"],
    min_bars: int = S.TRADABLE["min_bars"], top: int = 0,
) -> DataFrame:
    """Symbols liquid and priced inside the limits at a date."""
    if as_of is not None:
        bars = bars.where(F.col("time") <= F.lit(as_of).cast("date"))
    recent = Window.partitionBy("symbol").orderBy(F.desc("time"))
    per = (
        bars.withColumn("rn", F.row_number().over(recent))
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("n_bars"),
            F.max("time").alias("last_time"),
            F.max_by("close", "time").alias("last_close"),
            F.avg(F.when(F.col("rn") <= 20, F.col("volume"))).alias("avg_volume"),
        )
    )
    market_last = bars.agg(F.max("time")).scalar()
    out = per.where(
        (F.col("n_bars") >= min_bars)
        & (F.col("last_time") >= F.date_sub(market_last, S.TRADABLE["stale_days"]))
        & F.col("last_close").between(S.TRADABLE["min_price"], S.TRADABLE["max_price"])
        & (F.col("avg_volume") >= min_volume)
    )
    return out.orderBy(F.desc("avg_volume"), "symbol").limit(top) if top else out


def eligible_universe(universe: DataFrame) -> DataFrame:
    return universe.where(
        (F.col("n_sessions") >= S.MIN_SESSIONS)
        & (F.col("avg_value_20d") >= S.MIN_OPPORTUNITY_VALUE)
        & F.col("has_bctc") & F.col("traded_today")
    )


def clean_multiples(universe: DataFrame) -> DataFrame:
    """Liquid rows only, multiples outside their plausible range nulled."""
    def keep(c: str, hi: float) -> Column:
        return F.when((F.col(c) > 0) & (F.col(c) <= hi), F.col(c))

    return universe.where(F.coalesce("liquidity_flag", F.lit(False))).withColumns({
        "pe": keep("pe", 100.0), "pb": keep("pb", 20.0), "ev_ebitda": keep("ev_ebitda", 50.0),
    })


def drop_unusable_multiples(df: DataFrame, columns=("pe", "pb", "ev_ebitda")) -> DataFrame:
    """The peer table's own rule: null anything not in (0, 200] or not finite."""
    return df.withColumns({
        c: F.when((F.col(c) > 0) & (F.col(c) <= 200), F.col(c)) for c in columns
    })
