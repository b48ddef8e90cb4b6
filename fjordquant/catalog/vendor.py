"""Vendor mapping, statement sources, store maintenance and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.catalog import analysis as _analysis  # noqa: F401
from fjordquant.catalog.market import now_universe
from fjordquant.catalog.registry import query
from fjordquant.catalog.statements import annual_typed, deduped
from fjordquant.functions import text as X
from fjordquant.functions.numeric import finite, rounded
from fjordquant.operators import checks as CH
from fjordquant.operators import screening as SCR
from fjordquant.operators import statements as ST
from fjordquant.operators import ttm as TTM
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_
from fjordquant.sources import store as STORE
from fjordquant.sources import vendor as V


@query("security_master", "SRC-5", """
WITH r AS (SELECT upper('t' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0')) AS symbol, CASE p_partkey % 4 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' WHEN 2 THEN 'UPCOM' END AS exchange, p_name AS name, p_partkey AS o,
  CASE WHEN p_size % 5 = 0 THEN 'BOND' ELSE 'STOCK' END AS type FROM part)
SELECT symbol, min_by(exchange, o) AS exchange, min_by(name, o) AS name FROM r WHERE type = 'STOCK' AND exchange IS NOT NULL GROUP BY 1""")
def security_master(spark, d):
    p = D.table(spark, d, "part")
    k = F.col("p_partkey")
    listing = p.select(
        F.concat(F.lit(" t"), F.lpad((k % 60).cast("string"), 2, "0")).alias("symbol"),
        F.when(k % 4 == 0, "hsx").when(k % 4 == 1, "HNX").when(k % 4 == 2, "UPCOM").otherwise("XYZ").alias("exchange"),
        F.col("p_name").alias("name"), k.alias("ordinal"), F.when(F.col("p_size") % 5 == 0, "BOND").otherwise("STOCK").alias("type"))
    return V.security_master(listing)


@query("quote_board", "SRC-6", """SELECT event_id AS "listingInfo.id", user_id AS "listingInfo.symbol", value AS "matchPrice.price" FROM events""")
def quote_board(spark, d):
    e = D.table(spark, d, "events")
    raw = e.select(F.to_json(F.struct(
        F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("symbol")).alias("listingInfo"),
        F.struct(F.col("value").alias("price")).alias("matchPrice"))).alias("payload"))
    return V.flatten_board(raw, "listingInfo struct<id:long,symbol:long>, matchPrice struct<price:double>")


@query("price_payloads", "SRC-20", with_("bars", """
SELECT symbol, time, close, volume FROM bars WHERE symbol % 3 <> 0"""))
def price_payloads(spark, d):
    bars = D.bars(spark, d)
    row = F.struct(F.unix_timestamp(F.col("time").cast("timestamp")).alias("t"), "open", "high", "low", "close", "volume")
    packed = bars.groupBy("symbol", F.year("time").alias("y")).agg(F.collect_list(row).alias("a")).select(
        "symbol", F.when(F.col("symbol") % 3 == 0, "other").otherwise(F.col("symbol").cast("string")).alias("returned_symbol"),
        F.col("a.t").alias("t"), F.col("a.open").alias("o"), F.col("a.high").alias("h"), F.col("a.low").alias("l"),
        F.col("a.close").alias("c"), F.col("a.volume").alias("v"))
    return V.price_arrays(packed).select("symbol", "time", "close", "volume")


@query("company_types", "CLS-1 CLS-2", """
SELECT p_partkey AS symbol, CASE WHEN p_partkey % 9 = 0 THEN 'BANK' WHEN p_partkey % 9 = 1 THEN 'SECURITIES' WHEN p_partkey % 9 = 2 THEN 'INSURANCE' WHEN p_partkey % 7 = 0 THEN 'BANK' WHEN p_partkey % 7 = 1 THEN 'INSURANCE'
  WHEN p_partkey % 7 = 2 THEN 'SECURITIES' WHEN p_partkey % 7 = 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'NON_FINANCIAL' ELSE 'REAL_ESTATE' END ELSE 'NON_FINANCIAL' END AS kind FROM part""")
def company_types(spark, d):
    k = F.col("p_partkey")
    code = F.when(k % 9 == 0, "nh").when(k % 9 == 1, "CK").when(k % 9 == 2, "BH")
    l2 = F.when(k % 7 == 0, "Ngân hàng").when(k % 7 == 1, "Bảo hiểm").when(k % 7 == 3, "Bất động sản").otherwise("Công nghiệp")
    l4 = F.when(k % 7 == 2, "Môi giới chứng khoán").when((k % 7 == 3) & (k % 2 == 0), "Dịch vụ bất động sản").otherwise("Khác")
    return D.table(spark, d, "part").select(k.alias("symbol"), V.company_type(code, l2, F.lit("x"), l4).alias("kind"))


@query("keyword_types", "CLS-2", """
SELECT p_partkey AS symbol, CASE WHEN p_partkey % 5 = 0 THEN 'BANK' WHEN p_partkey % 5 = 1 THEN 'INSURANCE' WHEN p_partkey % 10 = 2 THEN 'REAL_ESTATE' ELSE 'NON_FINANCIAL' END AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN 'industry: ngân hàng' WHEN p_partkey % 5 = 1 THEN 'industry: bảo hiểm' WHEN p_partkey % 10 = 2 THEN 'static list' ELSE 'default' END AS reason,
  CASE WHEN p_partkey % 5 = 0 THEN 'BANK' WHEN p_partkey % 5 = 1 THEN 'INSURANCE' ELSE 'CORPORATE' END AS template FROM part""")
def keyword_types(spark, d):
    k = F.col("p_partkey")
    p = D.table(spark, d, "part")
    df = p.select(k.alias("symbol"), F.when(k % 5 == 0, "Ngân hàng thương mại").when(k % 5 == 1, "Bảo hiểm nhân thọ").alias("industry"))
    static = p.where(k % 10 == 2).select(k.alias("symbol"), F.lit("REAL_ESTATE").alias("kind"))
    return V.classify_by_keywords(df, static).select("symbol", "kind", "reason", V.statement_template(F.col("kind")).alias("template"))


@query("industry_levels", "PRJ-7", with_("securities", "SELECT symbol, icb1, icb2, icb3, icb4, 'c1-' || symbol AS icb1_code, 'c4-' || symbol AS icb4_code FROM securities"))
def industry_levels(spark, d):
    s = D.securities(spark, d)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.concat(F.lit(f"c{i}-"), "symbol").alias("code"),
                                        F.col(f"icb{i}").alias("name")) for i in (1, 2, 3, 4)]))
    return V.pivot_levels(s.select("symbol", rows.alias("x")).select("symbol", "x.*")).select(
        "symbol", "icb1", "icb2", "icb3", "icb4", "icb1_code", "icb4_code")


LONG_CODES = {"revenue": "is01", "net_income": "is20", "total_assets": "bs99", "equity": "bs70"}
define("long_primary", """
SELECT symbol AS ticker, year, CASE symbol % 3 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END AS exchange, left(code, 2) AS statement, code AS item_code, value, code AS ordinal
FROM (SELECT symbol, year, unnest(['is01', 'is20', 'bs99', 'bs70']) AS code, unnest([revenue, net_income, total_assets, equity]) AS value FROM annual)""", ("annual",))


def long_primary(spark, d):
    long = V.wide_to_long(D.annual(D.quarters(spark, d)), LONG_CODES)
    m = F.col("ticker") % 3
    return long.select(
        "ticker", "year", F.when(m == 0, "HOSE").when(m == 1, "HNX").otherwise("UPCOM").alias("exchange"),
        F.substring("item_code", 1, 2).alias("statement"), "item_code", "value", F.col("item_code").alias("ordinal"))


@query("statement_lines", "SRC-7 SRC-11", with_("long_primary", """
SELECT ticker, year, statement, item_code, round(value, 2) AS value, row_number() OVER (PARTITION BY ticker, statement, year ORDER BY ordinal) - 1 AS line_no FROM long_primary"""))
def statement_lines(spark, d):
    p = long_primary(spark, d)
    files = [p.where(F.col("statement") == "is"), p.where(F.col("statement") == "bs")]
    return rounded(V.combine_statements(files).select("ticker", "year", "statement", "item_code", "value", "line_no"), {"value": 2})


@query("statement_sources", "SRC-8 SRC-16", with_("long_primary", """
WITH s AS (SELECT *, 'supplement' AS source FROM long_primary WHERE year % 2 = 0),
b AS (SELECT *, CAST(NULL AS VARCHAR) AS source FROM long_primary WHERE exchange <> 'UPCOM' AND item_code <> 'is20' UNION ALL SELECT * REPLACE (value * 2 AS value) FROM s)
SELECT ticker, year, item_code, exchange, source, round(value, 2) AS value FROM b QUALIFY row_number() OVER (PARTITION BY ticker, year, statement, item_code ORDER BY source IS NULL DESC) = 1"""))
def statement_sources(spark, d):
    p = long_primary(spark, d)
    supplement = p.where(F.col("year") % 2 == 0).withColumn("value", F.col("value") * 2)
    out = V.prefer_primary(p.where(F.col("item_code") != "is20"), supplement)
    return rounded(out.select("ticker", "year", "item_code", "exchange", "source", "value"), {"value": 2})


@query("statement_wide", "SRC-9", with_("long_primary", """
WITH y AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r FROM (SELECT DISTINCT year FROM long_primary WHERE statement = 'is')),
w AS (SELECT ticker, item_code, max(CASE WHEN r = 3 THEN value END) AS v3, max(CASE WHEN r = 2 THEN value END) AS v2, max(CASE WHEN r = 1 THEN value END) AS v1, CASE item_code WHEN 'is01' THEN 0 ELSE 1 END AS line_no
  FROM long_primary JOIN y USING (year) WHERE statement = 'is' AND r <= 3 GROUP BY 1, 2)
SELECT ticker, item_code, (SELECT year FROM y WHERE r = 1) AS newest_year, round(v3, 2) AS two_before, round(v2, 2) AS year_before, round(v1, 2) AS newest, line_no FROM w
WHERE coalesce(v1, 0) <> 0 OR coalesce(v2, 0) <> 0 OR coalesce(v3, 0) <> 0"""))
def statement_wide(spark, d):
    long = V.combine_statements([long_primary(spark, d)])
    years = V.last_years(long.where("statement = 'is'"), 3)
    w = V.wide_statement(long, "is", years)
    names = dict(zip([str(y) for y in years], ["newest", "year_before", "two_before"]))
    return rounded(w.withColumnsRenamed(names).select(
        "ticker", "item_code", F.lit(years[0]).alias("newest_year"), "two_before", "year_before", "newest",
        "line_no"), {"two_before": 2, "year_before": 2, "newest": 2})


@query("statement_coverage", "SRC-10 JN-15 SET-2", with_("long_primary securities", """
WITH c AS (SELECT ticker, min(year) AS a, max(year) AS b FROM long_primary WHERE ticker % 6 <> 0 GROUP BY 1)
SELECT exchange, count(*) AS n, count(c.ticker) AS matched, count(*) - count(c.ticker) AS missing, min(a) AS first_year, max(b) AS last_year FROM securities LEFT JOIN c ON c.ticker = symbol GROUP BY 1"""))
def statement_coverage(spark, d):
    cov = V.coverage(long_primary(spark, d).where(F.col("ticker") % 6 != 0)).drop("exchange")
    j = D.securities(spark, d).select("symbol", "exchange").join(cov, F.col("symbol") == F.col("ticker"), "left")
    return j.groupBy("exchange").agg(
        F.count(F.lit(1)).alias("n"), F.count("ticker").alias("matched"),
        (F.count(F.lit(1)) - F.count("ticker")).alias("missing"), F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"))


@query("uncovered_symbols", "SET-2 JN-15", with_("securities", "SELECT symbol, 'missing' AS kind FROM securities WHERE symbol % 6 = 0 UNION ALL SELECT DISTINCT l_suppkey + 100000, 'delisted' FROM lineitem WHERE l_suppkey % 6 = 1"))
def uncovered_symbols(spark, d):
    uni = D.securities(spark, d).select("symbol")
    li = D.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol")).distinct()
    covered = li.where(F.col("symbol") % 6 != 0).unionByName(
        li.where(F.col("symbol") % 6 == 1).select((F.col("symbol") + 100000).alias("symbol")))
    missing = uni.join(covered, "symbol", "left_anti").withColumn("kind", F.lit("missing"))
    gone = covered.join(uni, "symbol", "left_anti").withColumn("kind", F.lit("delisted"))
    return missing.unionByName(gone)


@query("standard_fields", "PRJ-3", with_("long_primary", """
SELECT ticker, year, round(max(CASE WHEN item_code = 'is01' AND year % 3 <> 0 THEN value WHEN item_code = 'is20' AND year % 3 = 0 THEN value END), 2) AS revenue, round(max(CASE WHEN item_code = 'bs99' THEN value END), 2) AS total_assets
FROM long_primary GROUP BY 1, 2"""))
def standard_fields(spark, d):
    p = long_primary(spark, d).withColumn("value", F.when(
        (F.col("item_code") == "is01") & (F.col("year") % 3 == 0), 0.0).otherwise(F.col("value")))
    out = V.standardize(p, {"revenue": ["is0[0-9]", "is20"], "total_assets": ["bs9.*"]}, ["revenue"])
    return rounded(out.select("ticker", "year", "revenue", "total_assets"), {"revenue": 2, "total_assets": 2})


@query("named_fields", "PRJ-2", with_("long_primary", """
SELECT ticker, year, round(max(CASE WHEN item_code = 'is01' THEN value END), 2) AS revenue, round(max(CASE WHEN item_code = 'is20' THEN value END), 2) AS net_income FROM long_primary GROUP BY 1, 2"""))
def named_fields(spark, d):
    name = F.when(F.col("item_code") == "is01", "Doanh thu thuần").when(F.col("item_code") == "is20", "Lợi nhuận sau thuế").otherwise("Khác")
    rows = long_primary(spark, d).select("ticker", "year", name.alias("item_name"), "value", F.col("year").alias("row_no"))
    out = V.map_item_names(rows, {"revenue": ["^doanh thu thuan", "doanh thu"], "net_income": ["loi nhuan sau"]})
    return rounded(out.select("ticker", "year", "revenue", "net_income"), {"revenue": 2, "net_income": 2})


@query("wide_fields", "PRJ-1", with_("annual", "SELECT symbol, year, round(revenue, 2) AS revenue, round(-abs(capex), 2) AS capex FROM annual"))
def wide_fields(spark, d):
    a = D.annual(D.quarters(spark, d)).select(
        "symbol", F.concat(F.lit("FY "), "year").alias("period"), F.col("revenue").alias("Net revenue (VND)"),
        F.abs("capex").alias("Purchase of fixed assets"), F.col("year").alias("ordinal"))
    out = V.standardize_wide(a, {"revenue": (["netRevenue"], ["net", "revenue"]), "capex": ([], ["fixed assets"])})
    return rounded(out.select("symbol", "year", "revenue", "capex"), {"revenue": 2, "capex": 2})


@query("published_quarters", "PRJ-4", with_("quarters", """
SELECT symbol, year, quarter, round(revenue, 2) AS revenue, round(total_assets, 2) AS total_assets, round(cfo, 2) AS cfo, published_at + 3 AS published_at FROM quarters"""))
def published_quarters(spark, d):
    q = D.quarters(spark, d)

    def part(cols, days):
        return q.select("symbol", "year", "quarter", *cols, F.date_add("published_at", days).alias("published"), F.lit(1).alias("updated_at"))

    out = V.latest_publication(part(["revenue"], 0), part(["total_assets"], 3), part(["cfo"], 1))
    return rounded(out.select("symbol", "year", "quarter", "revenue", "total_assets", "cfo", "published_at"),
                   {"revenue": 2, "total_assets": 2, "cfo": 2})


@query("aligned_years", "PRJ-6", with_("annual", """
SELECT symbol, year, round(net_income, 2) AS profit, symbol % 2 = 1 AS flipped FROM annual"""))
def aligned_years(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("year")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    a = D.annual(D.quarters(spark, d)).select("symbol", "year", F.col("net_income").alias("profit"))
    a = a.withColumns({"i": F.row_number().over(w) - 1, "n": n,
                       "growth": F.col("profit") / F.lag("profit").over(w) - 1})
    # odd symbols deliver their columns in reverse under labels in order
    odd = F.col("symbol") % 2 == 1
    labels = a.select("symbol", F.col("i").alias("pos"), "year")
    seen = a.select("symbol", F.when(odd, F.col("n") - 1 - F.col("i")).otherwise(F.col("i")).alias("pos"), "profit", "growth")
    out = V.align_years(seen.join(labels, ["symbol", "pos"]))
    return rounded(out.select("symbol", "year", "profit", "flipped"), {"profit": 2})


@query("usable_ratios", "PRJ-8", """SELECT p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_size END AS pe FROM part""")
def usable_ratios(spark, d):
    p = D.table(spark, d, "part").select(
        F.col("p_partkey").alias("symbol"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("P/E"),
        F.col("p_size").alias("pe"))
    return p.select("symbol", V.first_usable(["P/E", "pe"]).alias("pe"))


@query("merged_bars", "SRC-2 SRC-3", with_("bars", """
SELECT symbol, time, CASE WHEN time >= DATE '2001-01-01' AND symbol <> 7 THEN close * 2 ELSE close END AS close FROM bars WHERE symbol <> 7"""))
def merged_bars(spark, d):
    bars = D.bars(spark, d)
    new = bars.where(F.col("time") >= "2001-01-01").withColumn("close", F.col("close") * 2)
    return STORE.refresh_bars(bars.where(F.col("symbol") != 7), new).select("symbol", "time", "close")


@query("new_items", "SNK-5", with_("news", "SELECT guid, published_at FROM news WHERE guid % 3 <> 0"))
def new_items(spark, d):
    n = D.news(spark, d).select("guid", "published_at")
    return STORE.insert_new(n.where(F.col("guid") % 3 == 0), n.unionByName(n)).select("guid", "published_at")


@query("recent_items", "SNK-5", with_("news", "SELECT guid, published_at FROM news WHERE lang = 'en' ORDER BY published_at DESC, guid LIMIT 6"))
def recent_items(spark, d):
    n = D.news(spark, d).withColumnRenamed("lang", "category")
    return STORE.recent(n, 6, "en").select("guid", "published_at")


@query("missing_signal_dates", "SNK-2", with_("month_ends", "SELECT as_of FROM month_ends WHERE year(as_of) <> 1998"))
def missing_signal_dates(spark, d):
    m = D.month_ends(D.bars(spark, d)).select("as_of")
    return STORE.missing_dates(m, m.where(F.year("as_of") == 1998))


@query("input_signature", "SNK-6", with_("ttm_all", """
WITH h AS (SELECT sha256(concat_ws('|', CAST(symbol AS VARCHAR), CAST(q AS VARCHAR), coalesce(ttm_label, '\\N'))) AS d FROM ttm_all),
p AS (SELECT count(*) AS n, """ + ", ".join(
    f"sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS p{i}" for i in range(8)) + """ FROM h)
SELECT n, sha256(concat_ws('-', n, p0, p1, p2, p3, p4, p5, p6, p7)) AS signature FROM p"""))
def input_signature(spark, d):
    return STORE.input_signature(TTM.ttm_history(deduped(spark, d)), ["symbol", "q", "ttm_label"])


@query("weekly_index_rebased", "SNK-3", with_("benchmark_index", """
WITH w AS (SELECT CAST(time + CAST((5 - isodow(time) + 7) % 7 AS INTEGER) AS DATE) AS week, max_by(close, time) AS e FROM benchmark_index GROUP BY 1)
SELECT 'index' AS strategy, week, round(e / first_value(e) OVER (ORDER BY week) * 100, 6) AS value FROM w"""))
def weekly_index_rebased(spark, d):
    b = D.benchmark(D.bars(spark, d)).select(F.lit("index").alias("strategy"), "time", F.col("close").alias("equity"))
    return rounded(STORE.weekly_rebased(b, ["strategy"]), {"value": 6})


@query("source_summary", "PRV-1", with_("news", "SELECT lang, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM news GROUP BY 1"))
def source_summary(spark, d):
    return STORE.source_summary(D.news(spark, d), ["lang"])


@query("signal_payloads", "ARR-3 CLN-5", with_("quotes", "SELECT symbol, price, volume FROM quotes"))
def signal_payloads(spark, d):
    q = D.quotes(spark, d).withColumn("price", finite(F.col("price")))
    packed = STORE.signals_payload(q, ["price", "volume"])
    return STORE.read_payload(packed, "price double, volume double")


@query("column_filters", "FLT-6", """
SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice BETWEEN 50000 AND 200000 AND contains(lower(o_orderpriority), 'urgent')""")
def column_filters(spark, d):
    o = D.table(spark, d, "orders")
    return o.where(SCR.column_filter(F.col("o_totalprice"), ">= 100000") & SCR.column_filter(F.col("o_totalprice"), "50000..200000")
                   & SCR.column_filter(F.col("o_orderpriority"), "Urgent")).select("o_orderkey")


@query("store_health", "CHK-5 SRC-12", with_("bars", "SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, max(time) AS last_update, DATE '2001-12-01' - max(time) > 3 AS stale FROM bars"))
def store_health(spark, d):
    return CH.store_health(D.bars(spark, d), F.lit("2001-12-01").cast("date"))


@query("financial_checks", "CHK-1", with_("annual_typed", """
WITH p AS (SELECT symbol, any_value(company_type) AS t, count(*) AS n, max(year) AS last, count_if(abs(total_liabilities + equity - total_assets) / abs(total_assets) > 0.01) AS gap, count_if(total_assets < 1e10) AS tiny,
  count_if(gross_profit > revenue * 1.001) AS gross, count_if(net_income > 0 AND net_income_parent > net_income * 1.05) AS par FROM annual_typed GROUP BY 1)
SELECT symbol, unnest(['statements_present', 'enough_years', 'recent_year', 'balance_closes', 'currency_unit', 'gross_within_revenue', 'parent_within_total', 'core_fields', 'balance_closes_latest']) AS name,
 unnest(['PASS', CASE WHEN n < 3 THEN 'WARN' ELSE 'PASS' END, CASE WHEN last < 2003 - 2 THEN 'WARN' ELSE 'PASS' END, CASE WHEN gap > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN tiny > 0 THEN 'WARN' ELSE 'PASS' END,
  CASE WHEN t = 'BANK' THEN 'SKIP' WHEN gross > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN par > 0 THEN 'WARN' ELSE 'PASS' END, 'PASS', 'PASS']) AS status FROM p"""))
def financial_checks(spark, d):
    return CH.financial_checks(ST.fill_derived(annual_typed(spark, d)), 2003)


define("price_chk", """
WITH c AS (SELECT n.symbol, time, open, high, low, close, CASE exchange WHEN 'HOSE' THEN 0.07e0 WHEN 'HNX' THEN 0.1e0 ELSE 0.15e0 END AS band, close / prev - 1 AS ch FROM numbered n JOIN securities USING (symbol)),
p AS (SELECT symbol, max(time) AS last, count_if(least(open, high, low, close) <= 0) AS bad, count_if(abs(ch) > band + 0.005e0) AS br, (SELECT max(time) FROM bars) AS mx FROM c GROUP BY 1)
SELECT symbol, unnest(['prices_present', 'prices_recent', 'prices_positive', 'moves_within_band']) AS name, unnest(['PASS', CASE WHEN mx - last > 7 THEN 'WARN' ELSE 'PASS' END, CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN br > 0 THEN 'WARN' ELSE 'PASS' END]) AS status FROM p""", ("numbered", "securities", "bars"))


@query("price_checks", "CHK-1", with_("price_chk", "SELECT symbol, name, status FROM price_chk"))
def price_checks(spark, d):
    bars = D.bars(spark, d)
    return CH.price_checks(bars, D.securities(spark, d), bars.agg(F.max("time")).scalar())


@query("check_summary", "AGG-19", with_("price_chk", """
SELECT symbol, count_if(status = 'PASS') AS passed, count_if(status <> 'SKIP') AS total, count_if(status = 'WARN') AS warn, count_if(status = 'FAIL') AS fail FROM price_chk GROUP BY 1"""))
def check_summary(spark, d):
    bars = D.bars(spark, d)
    return CH.summarise(CH.price_checks(bars, D.securities(spark, d), bars.agg(F.max("time")).scalar()))


@query("figure_audit", "CHK-3", with_("now_u", """
SELECT symbol, unnest(['market_cap', 'pe', 'pb', 'upside']) AS figure, unnest([CASE WHEN market_cap IS NULL THEN 'SKIP' WHEN symbol % 10 = 0 THEN 'WARN' ELSE 'PASS' END, CASE WHEN pe IS NULL THEN 'SKIP' ELSE 'PASS' END, CASE WHEN pb IS NULL THEN 'SKIP' ELSE 'PASS' END, 'PASS']) AS status FROM now_u"""))
def figure_audit(spark, d):
    u = now_universe(spark, d)
    bumped = F.when(F.col("symbol") % 10 == 0, 1.1).otherwise(1.0)
    pub = u.select("symbol", "price", "shares", "net_income_parent", "equity_parent", (F.col("price") * 1.2).alias("target_price"),
                   (F.col("market_cap") * bumped).alias("pub_market_cap"), F.col("pe").alias("pub_pe"), F.col("pb").alias("pub_pb"), F.lit(0.2).alias("pub_upside"))
    return CH.recompute_audit(pub).select("symbol", "figure", "status")


REPORT_LINES = ["revenue", "net_income", "total_assets", "equity"]


def _vi(column: str) -> str:
    return f"replace(replace(replace(format('{{:,.0f}}', {column} / 1e9), ',', '_'), '.', ','), '_', '.')"


@query("report_table", "PRJ-10 STR-4", with_("annual", f"""
WITH y AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r FROM (SELECT DISTINCT year FROM annual)),
v AS (SELECT symbol, year, unnest({REPORT_LINES!r}) AS line, unnest([{", ".join(REPORT_LINES)}]) AS v FROM annual)
SELECT symbol, line, (SELECT year FROM y WHERE r = 1) AS newest_year, {_vi("max(CASE WHEN r = 3 THEN v END)")} AS two_before, {_vi("max(CASE WHEN r = 2 THEN v END)")} AS year_before, {_vi("max(CASE WHEN r = 1 THEN v END)")} AS newest
FROM v JOIN y USING (year) WHERE r <= 3 GROUP BY 1, 2"""))
def report_table(spark, d):
    a = D.annual(D.quarters(spark, d))
    years = V.last_years(a, 3)
    long = a.where(F.col("year").isin(years)).unpivot(["symbol", "year"], REPORT_LINES, "line", "v")
    wide = long.groupBy("symbol", "line").pivot("year", years).agg(F.first("v"))
    names = ["newest", "year_before", "two_before"]
    return wide.select("symbol", "line", F.lit(years[0]).alias("newest_year"), *[
        X.number_vi(F.col(str(y)) / 1e9).alias(c) for y, c in zip(years, names)])


@query("company_card", "JN-17", with_("now_u", """
SELECT symbol, name, exchange, icb4, round(price, 6) AS price, round(market_cap, 2) AS market_cap, concat_ws(', ', CASE WHEN pe IS NULL THEN 'pe' END, CASE WHEN ttm_label IS NULL THEN 'ttm' END, CASE WHEN ret_1y IS NULL THEN 'ret_1y' END) AS missing FROM now_u"""))
def company_card(spark, d):
    u = now_universe(spark, d)
    missing = F.array_join(F.array_compact(F.array(
        F.when(F.col("pe").isNull(), "pe"), F.when(F.col("ttm_label").isNull(), "ttm"), F.when(F.col("ret_1y").isNull(), "ret_1y"))), ", ")
    return rounded(u.select("symbol", "name", "exchange", "icb4", "price", "market_cap", missing.alias("missing")), {"price": 6, "market_cap": 2})
