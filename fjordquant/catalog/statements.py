"""Statements: visibility, trailing sums, ratios, pages and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.catalog.registry import query
from fjordquant.functions.numeric import rounded
from fjordquant.operators import pit as P
from fjordquant.operators import statements as ST
from fjordquant.operators import ttm as TTM
from fjordquant.operators import universe as U
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_

DEDUP_FIELDS = [*D.FIELDS, "published_at"]

define("stamped", """
SELECT *, CASE WHEN published_at > pe THEN published_at + 1 ELSE rd END AS available_from,
       CASE WHEN published_at > pe THEN 'ngày công bố thật' ELSE 'quy tắc trễ chuẩn' END AS available_basis
FROM (SELECT *, last_day(make_date(year, quarter * 3, 1)) AS pe,
             last_day(make_date(year, quarter * 3, 1)) + CASE quarter WHEN 4 THEN 60 ELSE 45 END AS rd FROM raw_quarters)""",
       ("raw_quarters",))
define("restated", "SELECT * REPLACE (available_from + 90 * copy AS available_from) FROM stamped", ("stamped",))


def _stamped(spark, d):
    df = P.annotate(D.raw_quarters(spark, d))
    return df.withColumn("available_from", F.expr("date_add(available_from, 90 * copy)"))


@query("statement_visibility", "JN-1", with_("stamped", """
SELECT symbol, year, quarter, copy, pe AS period_end, available_from, available_basis FROM stamped"""))
def statement_visibility(spark, d):
    return P.annotate(D.raw_quarters(spark, d)).select(
        "symbol", "year", "quarter", "copy", "period_end", "available_from", "available_basis")


@query("annual_visibility", "JN-1 JN-4", with_("annual", """
SELECT symbol, year, make_date(year, 12, 31) AS period_end, make_date(year + 1, 4, 1) AS available_from,
       'quy tắc trễ chuẩn' AS available_basis FROM annual"""))
def annual_visibility(spark, d):
    a = D.annual(D.quarters(spark, d)).select("symbol", "year").withColumns({
        "quarter": F.lit(0), "published_at": F.lit(None).cast("date")})
    return P.annotate(a).select("symbol", "year", "period_end", "available_from", "available_basis")


@query("statements_visible_at", "JN-2", with_("restated", """
SELECT symbol, year, quarter, copy, available_from, round(net_income_parent, 1) AS net_income_parent FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, year, quarter ORDER BY available_from DESC, copy DESC) AS rn
  FROM restated WHERE available_from <= DATE '1998-06-30') WHERE rn = 1"""))
def statements_visible_at(spark, d):
    view = P.as_of_view(P.vintages(_stamped(spark, d), "copy"), "1998-06-30", "quarter")
    return rounded(view.select("symbol", "year", "quarter", "copy", "available_from", "net_income_parent"),
                   {"net_income_parent": 1})


@query("latest_statement_by_month", "JN-2", with_("restated month_ends", """
SELECT as_of, symbol, period_end, quarter, copy, round(net_income_parent, 1) AS net_income_parent FROM (
  SELECT as_of, symbol, pe AS period_end, quarter, copy, net_income_parent,
         row_number() OVER (PARTITION BY as_of, symbol ORDER BY pe DESC, quarter DESC, available_from DESC, copy DESC) AS rn
  FROM month_ends JOIN restated ON available_from <= as_of) WHERE rn = 1"""))
def latest_statement_by_month(spark, d):
    events = P.latest_periods(_stamped(spark, d), "copy", ["net_income_parent"])
    bars = D.bars(spark, d)
    symbols = D.securities(spark, d).select("symbol")
    dates = bars.groupBy(F.trunc("time", "month").alias("m")).agg(F.max("time").alias("as_of"))
    grid = symbols.withColumn("_all", dates.agg(F.collect_list("as_of")).scalar()).select(
        "symbol", F.explode("_all").alias("as_of"))
    out = P.attach_as_of(grid, events, ["symbol"], "as_of", "seen_from",
                         ["period_end", "quarter", "copy", "net_income_parent"], ["seen_order"])
    return rounded(out.where(F.col("period_end").isNotNull()).select(
        "as_of", "symbol", "period_end", "quarter", "copy", "net_income_parent"),
        {"net_income_parent": 1})


@query("annual_as_of", "JN-4 PRJ-5", with_("annual", """
SELECT symbol, year, round(revenue, 1) AS revenue, round(equity, 1) AS equity, round(total_liabilities, 1) AS total_liabilities
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS rn FROM annual
      WHERE make_date(year + 1, 4, 1) <= DATE '2000-06-30') WHERE rn <= 3"""))
def annual_as_of(spark, d):
    df = ST.fill_derived(P.annual_as_of(D.annual(D.quarters(spark, d)), "2000-06-30", 3))
    return rounded(df.select("symbol", "year", "revenue", "equity", "total_liabilities"),
                   {"revenue": 1, "equity": 1, "total_liabilities": 1})


@query("derived_fields", "PRJ-5", with_("annual", """
SELECT symbol, year, CASE WHEN symbol % 3 = 0 THEN 'cogs,total_liabilities' ELSE '' END AS computed,
       round(CASE WHEN symbol % 3 = 0 THEN gross_profit - revenue ELSE cogs END, 1) AS cogs,
       round(CASE WHEN symbol % 3 = 0 THEN total_assets - equity ELSE total_liabilities END, 1) AS total_liabilities FROM annual"""))
def derived_fields(spark, d):
    a = D.annual(D.quarters(spark, d))
    gone = F.col("symbol") % 3 == 0
    a = a.withColumns({"cogs": F.when(~gone, F.col("cogs")),
                       "total_liabilities": F.when(~gone, F.col("total_liabilities"))})
    return rounded(ST.fill_derived(a).select("symbol", "year", "computed", "cogs", "total_liabilities"),
                   {"cogs": 1, "total_liabilities": 1})


CMP = ", ".join(D.FIELDS)
define("dedup", """
SELECT symbol, year * 4 + quarter - 1 AS q, any_value(year) AS year, any_value(quarter) AS quarter, count(*) AS copies,
       count(DISTINCT net_income_parent) > 1 AS conflict, """ + ", ".join(f"min({c}) AS {c}" for c in D.FIELDS) + """,
       min(published_at) AS published_at FROM raw_quarters GROUP BY 1, 2""", ("raw_quarters",))


def deduped(spark, d, sums=None):
    return TTM.dedupe_quarters(D.raw_quarters(spark, d, sums), DEDUP_FIELDS)


@query("quarter_copies", "AGG-9 DT-1", with_("dedup", """
SELECT symbol, q, year, quarter, copies, conflict, (q // 4) || '-Q' || (q % 4 + 1) AS label FROM dedup"""))
def quarter_copies(spark, d):
    return deduped(spark, d).select("symbol", "q", "year", "quarter", "copies", "conflict",
                                    TTM.qlabel(F.col("q")).alias("label"))


@query("quarter_report", "AGG-9", with_("dedup", """
WITH l AS (SELECT symbol, max(q) AS last FROM dedup GROUP BY symbol),
w AS (SELECT symbol, last, unnest(generate_series(last - 3, last)) AS q FROM l),
j AS (SELECT w.symbol, w.last, w.q, (w.q // 4) || '-Q' || (w.q % 4 + 1) AS lab, d.copies, d.conflict FROM w LEFT JOIN dedup d ON d.symbol = w.symbol AND d.q = w.q)
SELECT symbol, (last // 4) || '-Q' || (last % 4 + 1) AS last_quarter,
       coalesce(string_agg(CASE WHEN copies IS NULL THEN lab END, ',' ORDER BY q), '') AS missing,
       coalesce(string_agg(CASE WHEN conflict THEN lab END, ',' ORDER BY q), '') AS conflicting,
       coalesce(string_agg(CASE WHEN copies > 1 AND NOT conflict THEN lab END, ',' ORDER BY q), '') AS identical
FROM j GROUP BY symbol, last"""))
def quarter_report(spark, d):
    return TTM.quarter_report(deduped(spark, d))


TTM_FLOWS = ["revenue", "net_income", "net_income_parent", "cfo"]
define("ttm_all", """
SELECT symbol, q, year, quarter, 'TTM Q' || quarter || '/' || year AS ttm_label,
  ((q - 3) // 4) || '-Q' || ((q - 3) % 4 + 1) || ',' || ((q - 2) // 4) || '-Q' || ((q - 2) % 4 + 1) || ',' || ((q - 1) // 4) || '-Q' || ((q - 1) % 4 + 1) || ',' || (q // 4) || '-Q' || (q % 4 + 1) AS ttm_periods,
  revenue_ttm, net_income_ttm, net_income_parent_ttm, cfo_ttm, total_assets, equity,
  CASE WHEN n5 = 5 AND b5 = 0 THEN e5 END AS equity_avg_5, known AS available_from, published AS ttm_published_at
FROM (SELECT s.*, sum(revenue) OVER w AS revenue_ttm, sum(net_income) OVER w AS net_income_ttm, sum(net_income_parent) OVER w AS net_income_parent_ttm,
        sum(cfo) OVER w AS cfo_ttm, count(*) OVER w AS n4, sum(CAST(conflict AS INTEGER)) OVER w AS b4, count(equity) OVER v AS n5,
        sum(CAST(conflict AS INTEGER)) OVER v AS b5, avg(equity) OVER v AS e5, max(af) OVER w AS known, max(published_at) OVER w AS published
      FROM (SELECT *, CASE WHEN published_at > last_day(make_date(year, quarter * 3, 1)) THEN published_at + 1
              ELSE last_day(make_date(year, quarter * 3, 1)) + CASE quarter WHEN 4 THEN 60 ELSE 45 END END AS af FROM dedup) s
      WINDOW w AS (PARTITION BY symbol ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW),
             v AS (PARTITION BY symbol ORDER BY q RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))
WHERE n4 = 4 AND b4 = 0""", ("dedup",))
TTM_NUM = {"revenue_ttm": 1, "net_income_ttm": 1, "net_income_parent_ttm": 1, "cfo_ttm": 1, "total_assets": 1,
           "equity": 1, "equity_avg_5": 0, "roe_ttm": 7}


@query("trailing_twelve_months", "AGG-8 UDF-3", with_("ttm_all", """
SELECT symbol, q, year, quarter, ttm_label, ttm_periods, round(revenue_ttm, 1) AS revenue_ttm, round(net_income_ttm, 1) AS net_income_ttm,
  round(net_income_parent_ttm, 1) AS net_income_parent_ttm, round(cfo_ttm, 1) AS cfo_ttm, round(total_assets, 1) AS total_assets,
  round(equity, 1) AS equity, round(equity_avg_5, 0) AS equity_avg_5, round(net_income_parent_ttm / equity_avg_5, 7) AS roe_ttm FROM ttm_all"""))
def trailing_twelve_months(spark, d):
    return rounded(TTM.with_ttm(deduped(spark, d), TTM_FLOWS, ["total_assets", "equity"]), TTM_NUM)


@query("ttm_history", "AGG-10", with_("ttm_all", """
SELECT symbol, q, available_from, round(net_income_parent_ttm, 1) AS ni_ttm, ttm_label, ttm_periods, ttm_published_at FROM ttm_all"""))
def ttm_history(spark, d):
    return rounded(TTM.ttm_history(deduped(spark, d)), {"ni_ttm": 1})


define("ttm_now", """
WITH l AS (SELECT symbol, max(q) AS q FROM dedup GROUP BY symbol),
m AS (SELECT q AS market FROM l GROUP BY q ORDER BY count(*) DESC, q DESC LIMIT 1)
SELECT l.symbol, (l.q // 4) || '-Q' || (l.q % 4 + 1) AS last_quarter, CASE WHEN l.q >= market - 1 THEN t.net_income_parent_ttm END AS ni_ttm,
  CASE WHEN l.q >= market - 1 THEN t.ttm_label END AS ttm_label, CASE WHEN l.q >= market - 1 THEN t.ttm_periods END AS ttm_periods,
  CASE WHEN l.q >= market - 1 THEN t.ttm_published_at END AS ttm_published_at,
  CASE WHEN l.q < market - 1 THEN 'stale' WHEN t.symbol IS NULL THEN 'incomplete' END AS skipped
FROM l CROSS JOIN m LEFT JOIN ttm_all t ON t.symbol = l.symbol AND t.q = l.q""", ("dedup", "ttm_all"))


@query("ttm_snapshot", "AGG-11 SRC-17", with_("ttm_now", """
SELECT symbol, last_quarter, round(ni_ttm, 1) AS ni_ttm, ttm_label, ttm_periods, ttm_published_at, skipped FROM ttm_now"""))
def ttm_snapshot(spark, d):
    return rounded(TTM.ttm_snapshot(deduped(spark, d)), {"ni_ttm": 1})


@query("single_quarters_from_ytd", "WIN-16", with_("raw_quarters", """
WITH y AS (SELECT symbol, year, quarter, copy, sum(cfo) OVER (PARTITION BY symbol, year, copy ORDER BY quarter) AS ytd FROM raw_quarters),
p AS (SELECT symbol, year, quarter, CASE WHEN min(ytd) = max(ytd) THEN min(ytd) END AS ytd FROM y GROUP BY 1, 2, 3)
SELECT symbol, year, quarter, round(CASE WHEN quarter = 1 THEN ytd WHEN lag(quarter) OVER w = quarter - 1 THEN ytd - lag(ytd) OVER w END, 0) AS cfo
FROM p WINDOW w AS (PARTITION BY symbol, year ORDER BY quarter)"""))
def single_quarters_from_ytd(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "year", "copy").orderBy("quarter").rowsBetween(
        Window.unboundedPreceding, 0)
    ytd = D.raw_quarters(spark, d).withColumn("cfo", F.sum("cfo").over(w))
    return rounded(TTM.deaccumulate(ytd, ["cfo"]), {"cfo": 0})


@query("annual_reconciliation", "JN-10", with_("dedup annual", """
WITH q AS (SELECT symbol, year, field, max(CAST(conflict AS INTEGER)) AS dup, count(*) AS n, sum(v) AS total
  FROM (SELECT symbol, year, conflict, unnest(['revenue', 'net_income_parent', 'cfo']) AS field, unnest([revenue, net_income_parent, cfo]) AS v FROM dedup) GROUP BY 1, 2, 3),
a AS (SELECT symbol, year, unnest(['revenue', 'net_income_parent', 'cfo']) AS field, unnest([revenue, net_income_parent, cfo * 1.01e0]) AS annual FROM annual)
SELECT symbol, year, field, round(CASE WHEN dup = 0 AND n = 4 THEN total END, 0) AS quarters_sum, round(annual, 2) AS annual,
  round(CASE WHEN dup = 0 AND n = 4 THEN (total - annual) / abs(annual) END, 7) AS diff_pct,
  CASE WHEN dup > 0 THEN 'quý trùng' WHEN coalesce(n, 0) <> 4 THEN 'thiếu quý' WHEN abs(total - annual) <= 0.02e0 * abs(annual) THEN 'khớp' ELSE 'lệch' END AS status
FROM q FULL JOIN a USING (symbol, year, field)"""))
def annual_reconciliation(spark, d):
    a = D.annual(D.quarters(spark, d)).withColumn("cfo", F.col("cfo") * 1.01)
    return rounded(
        TTM.reconcile_annual(deduped(spark, d), a, ["revenue", "net_income_parent", "cfo"]),
        {"quarters_sum": 0, "annual": 2, "diff_pct": 7})


@query("latest_quarters", "WIN-17", with_("quarters", """
SELECT symbol, year, quarter, round(revenue, 1) AS revenue FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC, quarter DESC) AS rn FROM quarters) WHERE rn <= 8"""))
def latest_quarters(spark, d):
    return rounded(ST.latest_quarters(D.quarters(spark, d)).select(
        "symbol", "year", "quarter", "revenue"), {"revenue": 1})


define("annual_typed", "SELECT a.*, company_type FROM annual a JOIN securities USING (symbol)", ("annual", "securities"))


def annual_typed(spark, d, sums=None):
    return D.annual(D.quarters(spark, d, sums)).join(
        D.securities(spark, d).select("symbol", "company_type"), "symbol")


define("ratios", """
WITH b AS (SELECT *, equity - coalesce(minority_interest, 0) AS ep, short_debt + long_debt AS debt, company_type = 'BANK' AS bank FROM annual_typed)
SELECT symbol, company_type, year,
  net_income_parent / nullif(coalesce((ep + lag(ep) OVER w) / 2, ep), 0) AS roe,
  net_income / nullif(coalesce((total_assets + lag(total_assets) OVER w) / 2, total_assets), 0) AS roa,
  CASE WHEN lag(net_income_parent) OVER w > 0 THEN net_income_parent / lag(net_income_parent) OVER w - 1 END AS ni_growth,
  CASE WHEN bank THEN net_interest_income / nullif(coalesce((total_assets + lag(total_assets) OVER w) / 2, total_assets), 0) END AS nim,
  CASE WHEN bank THEN abs(operating_expense) / nullif(total_operating_income, 0) END AS cir,
  CASE WHEN bank THEN abs(provision) / nullif(coalesce((loans + lag(loans) OVER w) / 2, loans), 0) END AS credit_cost,
  CASE WHEN bank THEN loans / nullif(deposits, 0) END AS ldr, CASE WHEN bank THEN equity / nullif(total_assets, 0) END AS equity_to_assets,
  CASE WHEN bank THEN loans / nullif(lag(loans) OVER w, 0) - 1 END AS loan_growth,
  CASE WHEN bank THEN total_operating_income / nullif(lag(total_operating_income) OVER w, 0) - 1 END AS toi_growth,
  CASE WHEN NOT bank THEN gross_profit / nullif(revenue, 0) END AS gross_margin, CASE WHEN NOT bank THEN operating_profit / nullif(revenue, 0) END AS operating_margin,
  CASE WHEN NOT bank THEN net_income / nullif(revenue, 0) END AS net_margin, CASE WHEN NOT bank THEN revenue / nullif(lag(revenue) OVER w, 0) - 1 END AS revenue_growth,
  CASE WHEN NOT bank THEN revenue / nullif(coalesce((total_assets + lag(total_assets) OVER w) / 2, total_assets), 0) END AS asset_turnover,
  CASE WHEN NOT bank THEN debt / nullif(equity, 0) END AS debt_to_equity, CASE WHEN NOT bank THEN total_liabilities / nullif(total_assets, 0) END AS liabilities_to_assets,
  CASE WHEN NOT bank THEN current_assets / nullif(current_liabilities, 0) END AS current_ratio,
  CASE WHEN NOT bank THEN (current_assets - inventory) / nullif(current_liabilities, 0) END AS quick_ratio,
  CASE WHEN NOT bank THEN (pbt + abs(interest_expense)) / nullif(abs(interest_expense), 0) END AS interest_coverage,
  CASE WHEN NOT bank THEN coalesce((inventory + lag(inventory) OVER w) / 2, inventory) / nullif(abs(cogs), 0) * 365 END AS inventory_days,
  CASE WHEN NOT bank THEN cfo / nullif(net_income, 0) END AS cfo_to_ni, CASE WHEN NOT bank THEN cfo + capex END AS fcf
FROM b WINDOW w AS (PARTITION BY symbol ORDER BY year)""", ("annual_typed",))
RATIO_DIGITS = {c: (1 if c == "fcf" else 7 if c in ("inventory_days", "cfo_to_ni", "ni_growth") else 9) for c in ST.ALL_RATIOS}


@query("annual_ratios", "WIN-15 FIN-1", with_("ratios", "SELECT symbol, company_type, year, "
       + ", ".join(f"round({c}, {n}) AS {c}" for c, n in RATIO_DIGITS.items()) + " FROM ratios"))
def annual_ratios(spark, d):
    return rounded(ST.annual_ratios(annual_typed(spark, d)), RATIO_DIGITS)


define("growth", """
SELECT symbol, company_type, CASE WHEN count(top) >= 2 AND min_by(top, year) > 0 AND max_by(top, year) > 0
    THEN power(max_by(top, year) / min_by(top, year), 1e0 / greatest(max(year) - min(year), 1)) - 1 END AS top_line_cagr,
  CASE WHEN count(net_income_parent) >= 2 AND min_by(net_income_parent, year) > 0 AND max_by(net_income_parent, year) > 0
    THEN power(max_by(net_income_parent, year) / min_by(net_income_parent, year), 1e0 / greatest(max(year) - min(year), 1)) - 1 END AS ni_cagr,
  min(year) AS first_year, max(year) AS last_year, CASE WHEN company_type = 'BANK' THEN 'Tổng thu nhập hoạt động' ELSE 'Doanh thu thuần' END AS top_line_label
FROM (SELECT *, CASE WHEN company_type = 'BANK' THEN total_operating_income ELSE revenue END AS top FROM annual_typed) GROUP BY symbol, company_type""",
       ("annual_typed",))


@query("growth_summary", "AGG-17", with_("growth", """
SELECT symbol, company_type, round(top_line_cagr, 8) AS top_line_cagr, round(ni_cagr, 8) AS ni_cagr, first_year, last_year, top_line_label FROM growth"""))
def growth_summary(spark, d):
    return rounded(ST.growth_summary(annual_typed(spark, d)), {"top_line_cagr": 8, "ni_cagr": 8})


define("annual_metrics", """
WITH b AS (SELECT *, equity - coalesce(minority_interest, 0) AS ep, short_debt + long_debt AS debt FROM annual),
p AS (SELECT *, CASE WHEN lag(year) OVER w = year - 1 THEN lag(ep) OVER w END AS pe, CASE WHEN lag(year) OVER w = year - 1 THEN lag(net_income_parent) OVER w END AS pn,
        pbt + abs(interest_expense) + abs(depreciation) AS eb FROM b WINDOW w AS (PARTITION BY symbol ORDER BY year)),
q AS (SELECT *, CASE WHEN ep <> 0 AND pe <> 0 THEN (ep + pe) / 2 ELSE ep END AS ae FROM p)
SELECT symbol, year AS fin_year, make_date(year + 1, 4, 1) AS available_from, net_income_parent, ep AS equity_parent, total_assets, revenue,
  CASE WHEN ae > 0 THEN net_income_parent / ae END AS roe, CASE WHEN revenue > 0 THEN net_income_parent / revenue END AS net_margin,
  CASE WHEN pn > 0 THEN net_income_parent / pn - 1 END AS ni_growth, CASE WHEN eb <> 0 THEN eb END AS ebitda,
  debt - cash - coalesce(short_investments, 0) AS net_debt, CASE WHEN ep > 0 THEN debt / ep END AS debt_to_equity FROM q""", ("annual",))
METRIC_DIGITS = {"net_income_parent": 1, "equity_parent": 1, "total_assets": 1, "revenue": 1, "roe": 9, "net_margin": 9,
                 "ni_growth": 7, "ebitda": 1, "net_debt": 1, "debt_to_equity": 8}


@query("annual_metrics", "AGG-6", with_("annual_metrics", "SELECT symbol, fin_year, available_from, "
       + ", ".join(f"round({c}, {n}) AS {c}" for c, n in METRIC_DIGITS.items()) + " FROM annual_metrics"))
def annual_metrics(spark, d):
    return rounded(U.annual_metrics(D.annual(D.quarters(spark, d))), METRIC_DIGITS)


@query("income_statement_page", "FIN-1", with_("annual", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS rn FROM annual),
i AS (SELECT symbol, year, revenue AS base, generate_subscripts(['revenue', 'cogs', 'gross_profit', 'operating_profit', 'pbt', 'net_income', 'net_income_parent'], 1) AS rank,
        unnest(['revenue', 'cogs', 'gross_profit', 'operating_profit', 'pbt', 'net_income', 'net_income_parent']) AS line,
        unnest([revenue, cogs, gross_profit, operating_profit, pbt, net_income, net_income_parent]) AS value FROM r WHERE rn <= 5)
SELECT symbol, year, rank, line, round(value, 1) AS value, round(value / base, 9) AS common_size,
  round(CASE WHEN lag(value) OVER w > 0 THEN value / lag(value) OVER w - 1 END, 7) AS yoy FROM i WINDOW w AS (PARTITION BY symbol, line ORDER BY year)"""))
def income_statement_page(spark, d):
    return rounded(ST.statement_page(D.annual(D.quarters(spark, d)), "is"),
                   {"value": 1, "common_size": 9, "yoy": 7})


@query("quarter_validation", "CHK-2", with_("quarters", """
SELECT symbol, year, quarter, CASE WHEN abs(total_assets * CASE WHEN (symbol + quarter) % 11 = 0 THEN 1.2e0 ELSE 1e0 END - total_liabilities - equity)
    / (total_assets * CASE WHEN (symbol + quarter) % 11 = 0 THEN 1.2e0 ELSE 1e0 END) > 0.01e0 THEN 'balance'
  WHEN total_assets * CASE WHEN (symbol + quarter) % 11 = 0 THEN 1.2e0 ELSE 1e0 END < 1e9 THEN 'unit' END AS rejected FROM quarters"""))
def quarter_validation(spark, d):
    q = D.quarters(spark, d).withColumn("total_assets", F.col("total_assets") * F.when(
        (F.col("symbol") + F.col("quarter")) % 11 == 0, 1.2).otherwise(1.0))
    return ST.validate_quarters(q).select("symbol", "year", "quarter", "rejected")


@query("annual_validation", "CHK-2", with_("annual_typed", """
SELECT symbol, count(*) AS periods, round(max(abs(total_assets - total_liabilities - equity) / total_assets), 6) AS max_gap,
  round(median(total_assets), 0) AS median_assets, CASE WHEN count(*) < 5 THEN 'periods' WHEN max(abs(total_assets - total_liabilities - equity) / total_assets) > 0.01 THEN 'balance'
  WHEN median(total_assets) < 1e9 THEN 'unit' END AS error FROM annual_typed GROUP BY symbol"""))
def annual_validation(spark, d):
    df = ST.validate_annual(annual_typed(spark, d)).drop("n_top")
    return rounded(df, {"max_gap": 6, "median_assets": 0})
