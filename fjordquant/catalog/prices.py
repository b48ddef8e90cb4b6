"""Bars: cleaning, calendar rules, windows and per-symbol returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.catalog.registry import query
from fjordquant.functions.numeric import rounded
from fjordquant.operators import cleaning as C
from fjordquant.operators import indicators as I
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_


@query("daily_bars", "SRC-1 SRC-4 SRC-20", with_("bars", """
SELECT symbol, time, open AS open, high AS high, low AS low,
       close AS close, volume FROM bars"""))
def daily_bars(spark, d):
    return D.bars(spark, d)


@query("bar_slice", "SRC-1 SRC-18 SRC-21", with_("bars", """
SELECT symbol, time, close AS close, volume FROM bars
WHERE symbol IN (1, 2, 5) AND time BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"""))
def bar_slice(spark, d):
    df = D.bars(spark, d).where(
        F.col("symbol").isin(1, 2, 5) & F.col("time").between("1998-01-01", "1999-12-31")
    )
    return df.select("symbol", "time", "close", "volume")


@query("recent_bars_with_index", "SRC-21", with_("bars benchmark_index", """
SELECT b.symbol, b.time, b.close AS close, round(x.close, 4) AS index_close
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rn FROM bars) b
JOIN benchmark_index x USING (time) WHERE rn <= 60"""))
def recent_bars_with_index(spark, d):
    from pyspark.sql import Window

    bars = D.bars(spark, d)
    recent = bars.withColumn(
        "rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))
    ).where(F.col("rn") <= 60)
    index = D.benchmark(bars).select("time", F.col("close").alias("index_close"))
    return rounded(
        recent.join(index, "time").select("symbol", "time", "close", "index_close"),
        {"index_close": 4},
    )


@query("clean_vendor_bars", "CLN-1 CLN-2 CLN-3", """
WITH raw AS (
  SELECT ' s' || l_suppkey || ' ' AS ticker, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS d,
         l_extendedprice / l_quantity AS o, l_extendedprice AS h, l_extendedprice / l_quantity + l_tax AS l,
         CASE WHEN l_discount = 0 THEN -1e0 ELSE l_extendedprice / l_quantity * (1 - l_discount) END AS c, l_quantity AS v,
         l_orderkey * 10 + l_linenumber + l_extendedprice / l_quantity / 1e7 AS k FROM lineitem),
ok AS (SELECT upper(trim(ticker)) AS symbol, CAST(strptime(CAST(d AS VARCHAR), '%Y%m%d') AS DATE) AS time, o, h, l, c, v,
         row_number() OVER (PARTITION BY ticker, d ORDER BY k DESC) AS rn FROM raw WHERE c > 0 AND v >= 0)
SELECT symbol, time, o AS open, greatest(h, o, c) AS high, least(l, o, c) AS low,
       c AS close, v AS volume FROM ok WHERE rn = 1""")
def clean_vendor_bars(spark, d):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    raw = D.table(spark, d, "lineitem").select(
        F.concat(F.lit(" s"), F.col("l_suppkey"), F.lit(" ")).alias("﻿<Ticker>"),
        F.date_format("l_shipdate", "yyyyMMdd").cast("long").alias("<DTYYYYMMDD>"),
        unit.alias("<Open>"),
        F.col("l_extendedprice").alias("<High>"),
        (unit + F.col("l_tax")).alias("<Low>"),
        F.when(F.col("l_discount") == 0, -1.0).otherwise(unit * (1 - F.col("l_discount")))
        .alias("<Close>"),
        F.col("l_quantity").alias("<Volume>"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + unit / 1e7).alias("ordinal"),
    )
    return C.clean_bars(raw, "ordinal")


@query("session_flags", "CLN-4 CLS-3", with_("numbered securities", """
SELECT symbol, time, round(close / prev - 1, 8) AS change, band,
       coalesce(abs(close / prev - 1) > band + 0.005e0, false) AS breach,
       CASE WHEN exchange <> 'HOSE' THEN 100e0 WHEN prev < 10000 THEN 10e0 WHEN prev < 50000 THEN 50e0 ELSE 100e0 END AS tick,
       coalesce(close <= prev * (1 - band) + (CASE WHEN exchange <> 'HOSE' THEN 100e0 WHEN prev < 10000 THEN 10e0
                WHEN prev < 50000 THEN 50e0 ELSE 100e0 END) AND low >= close * (1 - 1e-6), false) AS locked
FROM (SELECT n.*, exchange, CASE exchange WHEN 'HOSE' THEN 0.07e0 WHEN 'HNX' THEN 0.10e0 ELSE 0.15e0 END AS band
      FROM numbered n JOIN securities USING (symbol))"""))
def session_flags(spark, d):
    df = C.session_flags(D.bars(spark, d), D.securities(spark, d))
    return rounded(
        df.select("symbol", "time", "change", "band", "breach", "tick", "locked"), {"change": 8}
    )


@query("tradable_symbols", "FLT-1", with_("bars", """
SELECT symbol, n_bars, last_time, last_close AS last_close, round(avg_volume, 4) AS avg_volume
FROM (SELECT symbol, count(*) AS n_bars, max(time) AS last_time, max_by(close, time) AS last_close,
             avg(CASE WHEN rn <= 20 THEN volume END) AS avg_volume
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rn FROM bars) GROUP BY symbol)
WHERE n_bars >= 250 AND last_time >= (SELECT max(time) FROM bars) - 14
  AND last_close BETWEEN 5000 AND 300000 AND avg_volume >= 25000"""))
def tradable_symbols(spark, d):
    return rounded(
        C.tradable_symbols(D.bars(spark, d), min_volume=25_000.0),
        {"avg_volume": 4},
    )


@query("moving_average_volume_ratio", "WIN-1 UDF-1", with_("bars", """
SELECT symbol, time, round(CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END, 4) AS sma20,
       round(CASE WHEN count(volume) OVER w >= 20 THEN volume / avg(volume) OVER w END, 8) AS volume_ratio
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def moving_average_volume_ratio(spark, d):
    return rounded(D.bars(spark, d).select(
        "symbol", "time", I.sma("close", 20).alias("sma20"),
        (F.col("volume") / I.sma("volume", 20)).alias("volume_ratio"),
    ), {"sma20": 4, "volume_ratio": 8})


define("panel", """
SELECT symbol, time, close AS price, row_number() OVER w AS n_sessions,
       CASE WHEN lag(close, 1) OVER w > 0 THEN close / lag(close, 1) OVER w - 1 END AS change_1d,
       CASE WHEN lag(close, 21) OVER w > 0 THEN close / lag(close, 21) OVER w - 1 END AS ret_1m,
       CASE WHEN lag(close, 63) OVER w > 0 THEN close / lag(close, 63) OVER w - 1 END AS ret_3m,
       CASE WHEN lag(close, 250) OVER w > 0 THEN close / lag(close, 250) OVER w - 1 END AS ret_1y,
       avg(close * volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg_value_20d
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)""", ("bars",))


@query("session_panel", "WIN-13", with_("panel", """
SELECT symbol, time, price AS price, n_sessions, round(change_1d, 8) AS change_1d,
       round(ret_1m, 8) AS ret_1m, round(ret_3m, 8) AS ret_3m, round(ret_1y, 8) AS ret_1y,
       round(avg_value_20d, 1) AS avg_value_20d FROM panel"""))
def session_panel(spark, d):
    return rounded(I.session_panel(D.bars(spark, d)), {
        "change_1d": 8, "ret_1m": 8, "ret_3m": 8, "ret_1y": 8, "avg_value_20d": 1,
    })


define("price_metrics", """
SELECT symbol, max(time) AS as_of_price, max_by(close, time) AS price, count(*) AS n_sessions,
  CASE WHEN max(CASE WHEN rn = 2 THEN close END) > 0 THEN max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 2 THEN close END) - 1 END AS change_1d,
  CASE WHEN max(CASE WHEN rn = 22 THEN close END) > 0 THEN max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 22 THEN close END) - 1 END AS ret_1m,
  CASE WHEN max(CASE WHEN rn = 64 THEN close END) > 0 THEN max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 64 THEN close END) - 1 END AS ret_3m,
  CASE WHEN max(CASE WHEN rn = 251 THEN close END) > 0 THEN max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 251 THEN close END) - 1 END AS ret_1y,
  CASE WHEN max_by(close, time) FILTER (time < y0) > 0 THEN max_by(close, time) / (max_by(close, time) FILTER (time < y0)) - 1 END AS ret_ytd,
  avg(CASE WHEN rn <= 20 THEN close * volume END) AS avg_value_20d
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rn,
             CAST(date_trunc('year', (SELECT max(time) FROM bars)) AS DATE) AS y0 FROM bars) GROUP BY symbol""", ("bars",))


@query("price_metrics", "AGG-5", with_("price_metrics", """
SELECT symbol, as_of_price, price AS price, n_sessions, round(change_1d, 8) AS change_1d, round(ret_1m, 8) AS ret_1m,
       round(ret_3m, 8) AS ret_3m, round(ret_1y, 8) AS ret_1y, round(ret_ytd, 8) AS ret_ytd,
       round(avg_value_20d, 1) AS avg_value_20d FROM price_metrics"""))
def price_metrics(spark, d):
    from fjordquant.operators.universe import price_metrics as op

    return rounded(op(D.bars(spark, d)), {
        "change_1d": 8, "ret_1m": 8, "ret_3m": 8, "ret_1y": 8, "ret_ytd": 8,
        "avg_value_20d": 1,
    })


@query("calendar_returns", "WIN-14", with_("bars", """
WITH l AS (SELECT symbol, max(time) AS t, max_by(close, time) AS c FROM bars GROUP BY symbol),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rn FROM bars)
SELECT l.symbol, l.t AS last_date, l.c AS close,
  round(l.c / max_by(b.close, b.time) FILTER (b.time <= l.t - 30) - 1, 8) AS ret_1m,
  round(l.c / max_by(b.close, b.time) FILTER (b.time <= l.t - 91) - 1, 8) AS ret_3m,
  round(l.c / max_by(b.close, b.time) FILTER (b.time <= l.t - 182) - 1, 8) AS ret_6m,
  round(l.c / max_by(b.close, b.time) FILTER (b.time <= l.t - 365) - 1, 8) AS ret_1y,
  max(b.close) FILTER (b.time > l.t - 365) AS high_52w, min(b.close) FILTER (b.time > l.t - 365) AS low_52w,
  round(avg(b.volume) FILTER (rn <= 20), 4) AS avg_volume_20d,
  round(avg(b.close * b.volume) FILTER (rn <= 20), 1) AS avg_value_20d
FROM l JOIN r b USING (symbol) GROUP BY l.symbol, l.t, l.c"""))
def calendar_returns(spark, d):
    return rounded(I.calendar_returns(D.bars(spark, d)), {
        "ret_1m": 8, "ret_3m": 8, "ret_6m": 8, "ret_1y": 8, 
        "avg_volume_20d": 4, "avg_value_20d": 1,
    })


define("betas", """
WITH wk AS (SELECT symbol, CAST(time + CAST((5 - isodow(time) + 7) % 7 AS INTEGER) AS DATE) AS week, max_by(close, time) AS c FROM bars GROUP BY 1, 2),
bw AS (SELECT CAST(time + CAST((5 - isodow(time) + 7) % 7 AS INTEGER) AS DATE) AS week, max_by(close, time) AS c FROM benchmark_index GROUP BY 1),
allw AS (SELECT DISTINCT CAST(unnest(generate_series((SELECT min(week) FROM bw), (SELECT max(week) FROM bw), INTERVAL 7 DAY)) AS DATE) AS week),
sf AS (SELECT symbol, allw.week, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY allw.week) AS c
       FROM (SELECT symbol, min(week) AS lo, max(week) AS hi FROM wk GROUP BY symbol) s
       JOIN allw ON allw.week BETWEEN lo AND hi LEFT JOIN wk USING (symbol, week)),
bf AS (SELECT week, last_value(c IGNORE NULLS) OVER (ORDER BY week) AS c FROM allw LEFT JOIN bw USING (week)),
sr AS (SELECT symbol, week, c / lag(c) OVER (PARTITION BY symbol ORDER BY week) - 1 AS r FROM sf),
br AS (SELECT week, c / lag(c) OVER (ORDER BY week) - 1 AS rb FROM bf),
j AS (SELECT symbol, week, r, rb FROM sr JOIN br USING (week) WHERE r IS NOT NULL AND rb IS NOT NULL)
SELECT symbol, week, count(*) OVER w AS n_weeks, CASE WHEN count(*) OVER w >= 26 AND var_samp(rb) OVER w > 0 THEN covar_samp(r, rb) OVER w / var_samp(rb) OVER w END AS beta
FROM j WINDOW w AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 103 PRECEDING AND CURRENT ROW)""", ("bars", "benchmark_index"))
define("beta", "SELECT * FROM betas QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY week DESC) = 1", ("betas",))


@query("weekly_beta", "JN-12", with_("beta", "SELECT symbol, n_weeks, round(beta, 7) AS beta FROM beta"))
def weekly_beta(spark, d):
    bars = D.bars(spark, d)
    return rounded(I.weekly_beta(bars, D.benchmark(bars)), {"beta": 7})


@query("own_session_forward_returns", "JN-9", with_("bars", """
SELECT symbol, time, round(lead(open, 22) OVER w / lead(open, 1) OVER w - 1, 8) AS fwd_21,
       round(lead(open, 64) OVER w / lead(open, 1) OVER w - 1, 8) AS fwd_63,
       round(lead(open, 127) OVER w / lead(open, 1) OVER w - 1, 8) AS fwd_126
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)"""))
def own_session_forward_returns(spark, d):
    from fjordquant.operators.evaluation import own_session_forward_returns as op

    return rounded(op(D.bars(spark, d), [21, 63, 126]), {"fwd_21": 8, "fwd_63": 8, "fwd_126": 8})


@query("series_overlap", "JN-11", with_("bars benchmark_index", """
WITH o AS (SELECT a.time, avg(a.high + a.low) / 2 AS alt FROM bars a GROUP BY a.time),
j AS (SELECT time, abs(alt - close) / close AS gap, row_number() OVER (ORDER BY time DESC) AS rn FROM o JOIN benchmark_index USING (time))
SELECT count(*) AS n_common, round(max(gap), 8) AS max_gap, max(gap) <= 0.001e0 AS accepted FROM j WHERE rn > 1"""))
def series_overlap(spark, d):
    from fjordquant.operators.universe import series_overlap as op

    bars = D.bars(spark, d)
    alt = bars.groupBy("time").agg((F.avg(F.col("high") + F.col("low")) / 2).alias("close"))
    return rounded(op(alt, D.benchmark(bars).select("time", "close")), {"max_gap": 8})
