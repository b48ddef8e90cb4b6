"""Source fallbacks, reshaped statements, reused results, file round trips, coverage totals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fjordquant.catalog.market import now_universe
from fjordquant.catalog.registry import query
from fjordquant.catalog.vendor import LONG_CODES
from fjordquant.functions.numeric import rounded
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_
from fjordquant.session import checkpoint_root
from fjordquant.sources import store as STORE
from fjordquant.sources import vendor as V


# sources: the miner knows two exchanges, the manual file years of high margins, the router all
@query("financials_by_source", "SRC-16", with_("annual securities", """
WITH t AS (SELECT a.symbol, year, revenue, net_income, 1 AS p, 'miner' AS source FROM annual a JOIN securities s ON s.symbol = a.symbol AND exchange <> 'UPCOM'
  UNION ALL SELECT symbol, year, revenue, net_income, 2, 'manual' FROM annual WHERE net_income > 0.019e0 * revenue
  UNION ALL SELECT symbol, year, revenue, net_income, 3, 'router' FROM annual),
b AS (SELECT * FROM t QUALIFY p = min(p) OVER (PARTITION BY symbol))
SELECT symbol, year, source, round(revenue, 2) AS revenue, round(net_income, 2) AS net_income FROM b QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY year DESC) <= 5"""))
def financials_by_source(spark, d):
    a = D.annual(D.quarters(spark, d)).select("symbol", "year", "revenue", "net_income")
    listed = D.securities(spark, d).where("exchange <> 'UPCOM'").select("symbol")
    chain = [("miner", a.join(listed, "symbol", "left_semi")),
             ("manual", a.where("net_income > 0.019D * revenue")), ("router", a)]
    return rounded(V.fallback_chain(chain, "symbol", "year").select(
        "symbol", "year", "source", "revenue", "net_income"), {"revenue": 2, "net_income": 2})


@query("statement_periods", "PRJ-6", with_("annual", """
SELECT symbol, CAST(year AS VARCHAR) AS period, round(a.revenue, 2) AS is01, round(a.net_income, 2) AS is20, round(a.equity, 2) AS bs70, round(a.total_assets, 2) AS bs99
FROM (SELECT symbol, year FROM (SELECT DISTINCT symbol FROM annual), (SELECT DISTINCT year FROM annual)) LEFT JOIN annual a USING (symbol, year)"""))
def statement_periods(spark, d):
    a = D.annual(D.quarters(spark, d))
    long = V.wide_to_long(a.select("symbol", "year", *LONG_CODES), LONG_CODES)
    years = sorted(r.year for r in a.select("year").distinct().collect())
    wide = long.groupBy(F.col("ticker").alias("symbol"), F.col("item_code").alias("item_id")).pivot(
        "year", years).agg(F.first("value")).withColumn("item", F.col("item_id"))
    # as delivered: a heading without values first, and a provisional line before each final one
    heading = wide.where("item_id = 'is01'").select("symbol", F.lit("head").alias("item_id"), "item", *[
        F.lit(None).cast("double").alias(str(y)) for y in years], F.lit(0).alias("line"))
    early = wide.select("symbol", "item_id", "item", *[
        (F.col(str(y)) / 2).alias(str(y)) for y in years], F.lit(1).alias("line"))
    final = wide.withColumn("line", F.lit(2))
    out = V.reshape_periods(heading.unionByName(early).unionByName(final), "symbol", ["item"], "line",
                            list(LONG_CODES.values()))
    codes = list(LONG_CODES.values())
    return rounded(out.select("symbol", "period", *codes), dict.fromkeys(codes, 2))


@query("results_reused", "SNK-6 SRC-12", with_("bars", """
WITH m AS (SELECT max(time) AS mx FROM bars), r AS (SELECT symbol, count(*) AS n_bars, max_by(close, time) AS last_close, sum(volume) AS volume, max(time) AS last FROM bars GROUP BY 1)
SELECT symbol, n_bars, last_close, volume, last BETWEEN mx - 7 AND mx - 3 AS reused, CASE WHEN last BETWEEN mx - 7 AND mx - 3 THEN last ELSE mx END AS updated_at,
  (SELECT mx - max(time) > 7 FROM bars, m WHERE time <= mx - 3 GROUP BY mx) AS store_stale FROM r, m"""))
def results_reused(spark, d):
    """Results stored three days before the last session, brought up to date."""
    bars = D.bars(spark, d).select("symbol", "time", "close", "volume")
    now = bars.agg(F.max("time")).scalar()
    marked = ["time", "close", "volume"]

    def compute(rows):
        return rows.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n_bars"), F.max_by("close", "time").alias("last_close"),
            F.sum("volume").alias("volume"))

    known = bars.where(F.col("time") <= F.date_sub(now, 3))
    stored = compute(known).join(STORE.input_signature(known, marked, ["symbol"]).select(
        "symbol", "signature"), "symbol").join(
        known.groupBy("symbol").agg(F.max("time").alias("updated_at")), "symbol")
    out = STORE.refresh_results(stored, bars, ["symbol"], marked, compute, now)
    return out.select("symbol", "n_bars", "last_close", "volume", "reused", "updated_at").withColumn(
        "store_stale", V.stale(stored, now).scalar())


define("macro_file", """
SELECT series, year(date) || 'Q' || quarter(date) AS period, max_by(value, date) AS value, max(month(date)) % 3 = 0 AS complete FROM macro GROUP BY 1, 2""", ("macro",))


@query("macro_file_series", "SRC-14 SRC-15 SNK-4", with_("macro_file", "SELECT series AS indicator, period, round(value / 30000e0, 7) AS value, 'sổ \"tay\", quý' AS source, CAST(NULL AS VARCHAR) AS unit FROM macro_file WHERE complete"))
def macro_file_series(spark, d):
    """Quarterly values written as a spreadsheet file, '.' where the quarter is not over, and read back."""
    m = D.macro(spark, d)
    rows = m.groupBy(F.col("series").alias("Indicator"), F.concat(
        F.year("date"), F.lit("Q"), F.quarter("date")).alias("period")).agg(
        F.when(F.max(F.month("date")) % 3 == 0, (F.max_by("value", "date") / 30000.0).cast("string"))
        .otherwise(".").alias("value")).withColumns({
            "source": F.lit('sổ "tay", quý'), "note": F.lit("không dùng")})
    path = f"{checkpoint_root(spark)}/files/{uuid.uuid4().hex}"
    STORE.export_csv(rows, path, ["Indicator", "period", "value", "source", "note"])
    back = STORE.read_csv(spark, path, {
        "indicator": "string", "period": "string", "value": "double", "source": "string", "unit": "string"})
    return rounded(back.where("value IS NOT NULL"), {"value": 7})


@query("coverage_totals", "JN-15 AGG-2", with_("now_u annual", """
WITH c AS (SELECT a.symbol, max(year) AS last_year FROM annual a JOIN now_u u ON u.symbol = a.symbol WHERE exchange <> 'UPCOM' OR a.net_income > 0.017e0 * a.revenue GROUP BY 1),
j AS (SELECT u.exchange, coalesce(u.market_cap, 0) AS cap, last_year, (SELECT max(year) FROM annual) AS newest FROM now_u u LEFT JOIN c USING (symbol))
SELECT exchange, CAST(grouping(exchange) AS TINYINT) AS is_total, count(*) AS listed, count(last_year) AS with_statements, round(100e0 * count(last_year) / count(*), 2) AS coverage_pct,
  coalesce(round(100 * sum(CASE WHEN last_year IS NOT NULL THEN cap ELSE 0 END) / nullif(sum(cap), 0), 2), 0) AS cap_coverage_pct, count_if(last_year >= newest) AS with_newest, count_if(last_year < newest) AS only_older, count(*) - count(last_year) AS missing
FROM j GROUP BY ROLLUP (exchange)"""))
def coverage_totals(spark, d):
    u = now_universe(spark, d)
    a = D.annual(D.quarters(spark, d))
    covered = a.join(D.securities(spark, d).select("symbol", "exchange"), "symbol").where(
        "exchange <> 'UPCOM' OR net_income > 0.017D * revenue").groupBy("symbol").agg(
        F.max("year").alias("last_year"))
    return V.coverage_totals(u, covered, a.agg(F.max("year")).scalar())
