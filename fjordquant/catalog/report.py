"""Report sentences, chart tables, older peer index, source cross-checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.catalog.analysis import now_valuation
from fjordquant.catalog.registry import query
from fjordquant.catalog.statements import annual_typed
from fjordquant.functions.numeric import rounded
from fjordquant.operators import checks as CH
from fjordquant.operators import peers as PE
from fjordquant.operators import report as R
from fjordquant.operators import statements as ST
from fjordquant.operators import technical as T
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_
from fjordquant.sources import vendor as V

VI = "replace(replace(replace(format('{{:,.{1}f}}', {0}), ',', '_'), '.', ','), '_', '.')"


def _vi(x: str, n: int) -> str:
    return VI.format(x, n)


def _pct(x: str) -> str:
    return "(" + _vi(f"({x}) * 100", 1) + " || '%')"


define("growth_text", f"""
SELECT g.symbol, 'Năm ' || a.year || CASE WHEN g.company_type = 'BANK' THEN ', tổng thu nhập hoạt động đạt ' ELSE ', doanh thu thuần đạt ' END || {_vi("CASE WHEN g.company_type = 'BANK' THEN a.total_operating_income ELSE a.revenue END / 1e9", 0)}
  || ' tỷ đồng, LNST công ty mẹ ' || {_vi('a.net_income_parent / 1e9', 0)} || ' tỷ đồng; CAGR ' || first_year || '–' || last_year || CASE WHEN g.company_type = 'BANK' THEN ': thu nhập ' ELSE ': doanh thu ' END
  || coalesce({_pct('top_line_cagr')}, 'N/A') || ', LNST ' || coalesce({_pct('ni_cagr')}, 'N/A') || '.' AS paragraph
FROM growth g JOIN annual a ON a.symbol = g.symbol AND a.year = g.last_year""", ("growth", "annual"))


@query("company_paragraphs", "TXT-9 STR-4", with_("growth_text", "SELECT symbol, paragraph FROM growth_text"))
def company_paragraphs(spark, d):
    a = annual_typed(spark, d)
    return R.company_paragraph(a, ST.growth_summary(a))


define("thesis", """
WITH roe AS (SELECT as_of, level, node, median(roe) AS roe_median FROM now_clean WHERE roe IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT v.*, roe_median, coalesce(t.zone = 'duoi_may', false) AS vetoed, t.total_score AS tech FROM now_v2 v JOIN now_levels USING (as_of, symbol) LEFT JOIN roe USING (as_of, level, node) LEFT JOIN last_tech t ON t.symbol = v.symbol)
SELECT symbol, (coalesce(roe_last > roe_median * 1.1, false))::INT + (coalesce(ni_cagr >= 0, false))::INT + (coalesce(upside >= -0.05 AND confidence <> 'THẤP', false))::INT + (coalesce(company_type = 'BANK' AND cir < 0.35, false))::INT
   + (coalesce(company_type <> 'BANK' AND cfo_to_ni3 > 1, false))::INT + (coalesce(NOT vetoed AND tech > 20, false))::INT AS n_thesis,
  least(7, 1 + (coalesce(roe_last < roe_median * 0.8, false))::INT + (coalesce(ni_cagr < 0, false))::INT + (coalesce((upside < -0.05 AND confidence <> 'THẤP') OR confidence = 'THẤP', false))::INT + (coalesce(company_type = 'BANK' AND credit_cost > 0.015, false))::INT
   + (coalesce(company_type <> 'BANK' AND debt_to_equity_last > 1.5, false))::INT + (coalesce(company_type <> 'BANK' AND interest_coverage < 3, false))::INT + (coalesce(company_type <> 'BANK' AND cfo_to_ni3 < 0.8, false))::INT
   + (vetoed OR coalesce(tech < -20, false))::INT) AS n_risks FROM x""", ("now_v2", "now_levels", "now_clean", "last_tech"))


@query("thesis_and_risks", "FIN-4", with_("thesis", "SELECT symbol, n_thesis, n_risks FROM thesis"))
def thesis_and_risks(spark, d):
    bars, u, v = now_valuation(spark, d)
    roe = PE.node_quantiles(u, ["roe"], {"roe_median": 0.5}).select(*PE.NODE, "roe_median")
    med = PE.peer_levels(u).join(roe, PE.NODE, "left").select("symbol", "roe_median")
    tech = T.with_action(T.with_scores(T.technical_state(bars, wanted="last"))).select(
        "symbol", "vetoed", F.col("total_score").alias("tech_total"))
    years = F.concat((F.col("year") - F.col("n_years") + 1).cast("string"), F.lit("–"), F.col("year").cast("string"))
    df = v.join(med, "symbol", "left").join(tech, "symbol", "left").withColumn("years", years)
    df = R.with_thesis_and_risks(df.withColumn("vetoed", F.coalesce("vetoed", F.lit(False))))
    return df.select("symbol", F.size("thesis").alias("n_thesis"), F.size("risks").alias("n_risks"))


@query("method_ranges", "PRJ-9", with_("now_v1", """
SELECT symbol, method, round(list_min(v), 3) AS low, round(v[2], 3) AS base, round(list_max(v), 3) AS high FROM (SELECT symbol, unnest(['pe_relative', 'pb_relative', 'dcf_fcff', 'justified_pb']) AS method, unnest([m_pe, m_pb, m_dcf, m_jpb]) AS v FROM now_v1) WHERE v[2] IS NOT NULL"""))
def method_ranges(spark, d):
    v = now_valuation(spark, d)[2]
    return rounded(R.method_ranges(v, ["pe_relative", "pb_relative", "dcf_fcff", "justified_pb"]),
                   {"low": 3, "base": 3, "high": 3})


@query("equal_weight_sector_index", "JN-13", with_("bars securities", """
WITH y AS (SELECT b.symbol, icb1 AS node, time, close, first_value(close) OVER (PARTITION BY b.symbol ORDER BY time) AS base, count(*) OVER (PARTITION BY b.symbol) AS n FROM bars b JOIN securities USING (symbol) WHERE time >= (SELECT max(time) - 365 FROM bars)),
v AS (SELECT symbol, node, time, close / base AS v FROM y WHERE n > 20), dy AS (SELECT DISTINCT node, time FROM v), sy AS (SELECT DISTINCT node, symbol FROM v),
f AS (SELECT dy.node, sy.symbol, dy.time, last_value(v IGNORE NULLS) OVER (PARTITION BY sy.symbol ORDER BY dy.time) AS v FROM dy JOIN sy USING (node) LEFT JOIN v ON v.symbol = sy.symbol AND v.time = dy.time)
SELECT node, time, round(avg(v) * 100, 4) AS value FROM f GROUP BY 1, 2"""))
def equal_weight_sector_index(spark, d):
    bars = D.bars(spark, d)
    members = D.securities(spark, d).select("symbol", F.col("icb1").alias("node"))
    start = F.date_sub(bars.agg(F.max("time")).scalar(), 365)
    return rounded(R.equal_weight_index(bars, members, start), {"value": 4})


@query("filings_index", "SRC-19", """
SELECT page_id % 20 AS ticker, row_number() OVER (PARTITION BY page_id % 20 ORDER BY 2000 + page_id % 9 DESC, 'p' || page_id || '.pdf') AS rank, 'filings/' || (page_id % 20) || '/' || 'p' || page_id || '.pdf' AS link FROM pages""")
def filings_index(spark, d):
    k = F.col("page_id")
    f = D.table(spark, d, "pages").select(
        (k % 20).alias("ticker"), (2000 + k % 9).alias("year"), F.concat(F.lit("p"), k, F.lit(".pdf")).alias("file_name"))
    return R.filings_index(f, "filings/").select("ticker", "rank", "link")


@query("source_cross_checks", "CHK-1", with_("ratios now_u", """
WITH s AS (SELECT symbol, year, roe, roe * 100 + CASE WHEN symbol % 5 = 0 THEN 10 ELSE 0 END AS src FROM ratios),
p AS (SELECT symbol, count(src) AS n_both, count_if(abs(src / 100 - roe) > 0.03) AS bad FROM s GROUP BY 1)
SELECT p.symbol, unnest(['roe_matches_source', 'pe_matches_source']) AS name, unnest([CASE WHEN n_both = 0 THEN 'SKIP' WHEN bad > 0 THEN 'WARN' ELSE 'PASS' END, CASE WHEN pe IS NULL THEN 'SKIP' WHEN p.symbol % 4 = 0 THEN 'WARN' ELSE 'PASS' END]) AS status FROM p LEFT JOIN now_u USING (symbol)"""))
def source_cross_checks(spark, d):
    from fjordquant.catalog.market import now_universe

    ratios = ST.annual_ratios(annual_typed(spark, d))
    pe = now_universe(spark, d).select("symbol", "pe")
    shift = F.when(F.col("symbol") % 5 == 0, 10).otherwise(0)
    off = F.when(F.col("symbol") % 4 == 0, 1.5).otherwise(1.05)
    src = ratios.select("symbol", "year", (F.col("roe") * 100 + shift).alias("src_roe")).join(
        pe.select("symbol", (F.col("pe") * off).alias("src_pe")), "symbol", "left")
    return CH.cross_checks(ratios, src, pe)
