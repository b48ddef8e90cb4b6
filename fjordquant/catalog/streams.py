"""Streaming jobs drained over the event table; each must equal its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.catalog.registry import query
from fjordquant.functions.numeric import rounded
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_
from fjordquant.streaming import live as L


@query("stream_latest_quotes", "STM-1", with_("quotes", """
SELECT symbol, max_by(price, (ts, event_id)) AS price, max_by(volume, (ts, event_id)) AS volume, epoch_us(max(ts)) AS ts_us FROM quotes GROUP BY 1"""))
def stream_latest_quotes(spark, d):
    out = L.drain(L.latest_quotes(L.quote_stream(spark, d)), "update", ["symbol"])
    return out.select("symbol", "price", "volume", F.unix_micros("ts").alias("ts_us"))


@query("stream_daily_bars", "STM-6 STM-1", with_("quotes", """
SELECT symbol, CAST(ts AS DATE) AS time, min_by(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, max_by(price, (ts, event_id)) AS close, sum(volume) AS volume FROM quotes GROUP BY 1, 2"""))
def stream_daily_bars(spark, d):
    return L.drain(L.daily_bars(L.quote_stream(spark, d)), "update", ["symbol", "time"])


@query("stream_once_per_id", "STM-5 SNK-5", with_("quotes", "SELECT event_id, symbol, price FROM quotes"))
def stream_once_per_id(spark, d):
    twice = L.quote_stream(spark, d).unionByName(L.quote_stream(spark, d))
    return L.drain(L.once_per_id(twice, "event_id", "ts"), "append").select("event_id", "symbol", "price")


define("last_bar", """
SELECT symbol, max(CASE WHEN rn = 1 THEN close END) AS ref, max(CASE WHEN rn = 1 THEN volume END) AS last_volume, min(close) AS lo, max(close) AS hi
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rn FROM bars) WHERE rn <= 250 GROUP BY 1""", ("bars",))


@query("stream_quote_changes", "STM-2", with_("quotes last_bar", """
SELECT event_id, symbol, round(price * 5000, 4) AS price, round(price * 5000 - ref, 7) AS change, round(price * 5000 / ref - 1, 8) AS change_pct, round(price * 5000 * coalesce(volume, last_volume), 2) AS turnover,
  epoch(date_trunc('second', (SELECT max(ts) FROM quotes))) - epoch(date_trunc('second', ts)) > 900 AS stale
FROM quotes LEFT JOIN last_bar USING (symbol)"""))
def stream_quote_changes(spark, d):
    static = L.last_two_bars(D.bars(spark, d))
    out = L.drain(L.with_change(L.quote_stream(spark, d), static, 5000.0), "append")
    # stale is told when the table is read, against the newest quote
    stale = L.is_stale(F.col("ts"), out.agg(F.max("ts")).scalar())
    return rounded(out.select("event_id", "symbol", "price", "change", "change_pct", "turnover",
                              stale.alias("stale")),
                   {"price": 4, "change": 7, "change_pct": 8, "turnover": 2})


@query("stream_plausible_quotes", "STM-3", with_("quotes last_bar", """
SELECT event_id, symbol FROM quotes JOIN last_bar USING (symbol) WHERE price * 5000 >= 0.5 * lo AND price * 5000 <= 2 * hi"""))
def stream_plausible_quotes(spark, d):
    static = L.last_two_bars(D.bars(spark, d))
    quotes = L.with_change(L.quote_stream(spark, d), static, 5000.0)
    return L.drain(L.plausible(quotes), "append").select("event_id", "symbol")


@query("turnover_units", "STM-4", with_("quotes", """
SELECT event_id, CASE WHEN price > 0 AND volume > 0 THEN list_min(list_filter([price, price * 1e3, price * 1e6], lambda a: a / volume BETWEEN 1e3 AND 1e6)) END AS turnover FROM quotes"""))
def turnover_units(spark, d):
    return D.quotes(spark, d).select("event_id", L.repaired_turnover(F.col("price"), F.col("volume")).alias("turnover"))
