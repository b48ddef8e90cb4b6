"""Market snapshot: universe, industry nodes, peer groups, search and maps."""

from __future__ import annotations


from pyspark.sql import functions as F


from fjordquant.catalog import prices as _prices  # noqa: F401  (defines shared check tables)
from fjordquant.catalog.registry import query
from fjordquant.catalog.statements import deduped
from fjordquant.functions.numeric import rounded
from fjordquant.operators import cleaning as C
from fjordquant.operators import peers as PE
from fjordquant.operators import ttm as TTM
from fjordquant.operators import universe as U
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_


def now_universe(spark, d, bars=None, sums=None):
    """The latest snapshot with its date as ``as_of``."""
    bars = bars if bars is not None else D.bars(spark, d)
    annual = D.annual(D.quarters(spark, d, sums))
    u = U.latest_universe(D.securities(spark, d), bars, annual,
                          TTM.ttm_snapshot(deduped(spark, d, sums)))
    return u.withColumn("as_of", bars.agg(F.max("time")).scalar())


MULTIPLES = """price * shares AS market_cap, CASE WHEN net_income_parent > 0 THEN price * shares / net_income_parent END AS pe,
  CASE WHEN equity_parent > 0 THEN price * shares / equity_parent END AS pb,
  CASE WHEN ebitda > 0 AND company_type = 'NON_FINANCIAL' THEN (price * shares + coalesce(net_debt, 0)) / ebitda END AS ev_ebitda,
  net_income_parent / shares AS eps, CASE WHEN ni_ttm > 0 THEN price * shares / ni_ttm END AS pe_ttm, ni_ttm / shares AS eps_ttm,
  coalesce(avg_value_20d >= 1e9, false) AS liquidity_flag, fin_year IS NOT NULL AS has_bctc"""
define("now_u", f"""
SELECT *, {MULTIPLES}, coalesce(as_of_price = as_of, false) AS traded_today
FROM (SELECT s.*, p.* EXCLUDE (symbol), m.* EXCLUDE (symbol, available_from), t.ni_ttm, t.ttm_label, (SELECT max(time) FROM bars) AS as_of
      FROM securities s LEFT JOIN price_metrics p USING (symbol)
      LEFT JOIN (SELECT * FROM annual_metrics QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fin_year DESC) = 1) m USING (symbol)
      LEFT JOIN ttm_now t USING (symbol))""", ("securities", "price_metrics", "annual_metrics", "ttm_now", "bars"))
U_DIG = {"market_cap": 2, "pe": 6, "pb": 8, "ev_ebitda": 6, "eps": 6, "pe_ttm": 6, "eps_ttm": 6, "roe": 9}
U_TXT = ["symbol", "as_of", "exchange", "icb1", "icb4", "company_type", "fin_year", "ttm_label", "liquidity_flag", "has_bctc", "traded_today", "n_sessions"]


@query("market_universe", "JN-6 AGG-6 SRC-17", with_("now_u", "SELECT " + ", ".join(U_TXT) + ", "
       + ", ".join(f"round({c}, {n}) AS {c}" for c, n in U_DIG.items()) + " FROM now_u"))
def market_universe(spark, d):
    return rounded(now_universe(spark, d).select(*U_TXT, *U_DIG), U_DIG)


@query("clean_multiples", "FLT-7", with_("now_u", """
SELECT symbol, round(CASE WHEN pe > 0 AND pe <= 100 THEN pe END, 6) AS pe, round(CASE WHEN pb > 0 AND pb <= 20 THEN pb END, 8) AS pb,
  round(CASE WHEN ev_ebitda > 0 AND ev_ebitda <= 50 THEN ev_ebitda END, 6) AS ev_ebitda,
  round(CASE WHEN pe > 0 AND pe <= 200 THEN pe END, 6) AS pe_table FROM now_u WHERE liquidity_flag"""))
def clean_multiples(spark, d):
    u = now_universe(spark, d).withColumn("pe_table", F.col("pe"))
    df = C.drop_unusable_multiples(C.clean_multiples(u), ["pe_table"])
    return rounded(df.select("symbol", "pe", "pb", "ev_ebitda", "pe_table"),
                   {"pe": 6, "pb": 8, "ev_ebitda": 6, "pe_table": 6})


define("index_rets", """
SELECT time AS as_of, close / lag(close, 21) OVER w - 1 AS b1m, close / lag(close, 63) OVER w - 1 AS b3m, close / lag(close, 250) OVER w - 1 AS b1y,
  close / (SELECT max_by(p.close, p.time) FROM benchmark_index p WHERE year(p.time) = year(b.time) - 1) - 1 AS bytd
FROM benchmark_index b WINDOW w AS (ORDER BY time)""", ("benchmark_index",))


def stage(prefix: str) -> None:
    """The node and peer stages over the universe table ``<prefix>_u``."""
    p = prefix
    define(f"{p}_nodes", f"""
SELECT *, unnest([1, 2, 3, 4]) AS level, unnest([icb1, icb2, icb3, icb4]) AS node FROM {p}_u""", (f"{p}_u",))
    define(f"{p}_stats", f"""
SELECT n.as_of, level, node, count(*) AS n_symbols, count_if(liquidity_flag) AS n_liquid, count_if(has_bctc) AS n_with_bctc,
  coalesce(sum(market_cap), 0) AS market_cap, coalesce(sum(avg_value_20d), 0) AS avg_value_20d,
  CASE WHEN sum(CASE WHEN market_cap IS NOT NULL THEN net_income_parent END) > 0 THEN sum(CASE WHEN net_income_parent IS NOT NULL THEN market_cap END) / sum(CASE WHEN market_cap IS NOT NULL THEN net_income_parent END) END AS pe_aggregate,
  sum(CASE WHEN market_cap > 0 THEN ret_1m * market_cap END) / sum(CASE WHEN ret_1m IS NOT NULL AND market_cap > 0 THEN market_cap END) AS ret_1m,
  sum(CASE WHEN market_cap > 0 THEN ret_3m * market_cap END) / sum(CASE WHEN ret_3m IS NOT NULL AND market_cap > 0 THEN market_cap END) AS ret_3m,
  sum(CASE WHEN market_cap > 0 THEN ret_ytd * market_cap END) / sum(CASE WHEN ret_ytd IS NOT NULL AND market_cap > 0 THEN market_cap END) AS ret_ytd,
  sum(CASE WHEN market_cap > 0 THEN ret_1y * market_cap END) / sum(CASE WHEN ret_1y IS NOT NULL AND market_cap > 0 THEN market_cap END) AS ret_1y,
  coalesce(sum(market_cap), 0) / any_value(tc) AS market_weight
FROM {p}_nodes n JOIN (SELECT as_of, sum(market_cap) AS tc FROM {p}_u GROUP BY as_of) t USING (as_of) GROUP BY 1, 2, 3""",
           (f"{p}_nodes", f"{p}_u"))
    define(f"{p}_clean", f"""
SELECT * REPLACE (CASE WHEN pe > 0 AND pe <= 100 THEN pe END AS pe, CASE WHEN pb > 0 AND pb <= 20 THEN pb END AS pb,
   CASE WHEN ev_ebitda > 0 AND ev_ebitda <= 50 THEN ev_ebitda END AS ev_ebitda) FROM {p}_nodes WHERE liquidity_flag""", (f"{p}_nodes",))
    define(f"{p}_levels", f"""
SELECT as_of, symbol, level, node, n_peers, n_liquid FROM {p}_nodes
JOIN (SELECT as_of, level, node, count(*) AS n_peers, count_if(liquidity_flag) AS n_liquid FROM {p}_nodes GROUP BY 1, 2, 3) c USING (as_of, level, node)
WHERE n_liquid >= 5 OR level = 1 QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY level DESC) = 1""", (f"{p}_nodes",))
    define(f"{p}_cmp", f"""
WITH o AS (SELECT l.as_of, l.symbol, l.level, l.node, m.market_cap AS tcap, x.symbol AS ps, x.market_cap AS cap,
             CASE WHEN x.ni_ttm > 0 THEN x.ni_ttm ELSE x.net_income_parent END AS pe_den, x.equity_parent AS pb_den,
             row_number() OVER (PARTITION BY l.as_of, l.symbol ORDER BY x.market_cap DESC, x.symbol) AS r
           FROM {p}_levels l JOIN {p}_u m USING (as_of, symbol) JOIN {p}_nodes x ON x.as_of = l.as_of AND x.level = l.level AND x.node = l.node
           WHERE x.liquidity_flag AND x.market_cap > 0 AND x.symbol <> l.symbol),
th AS (SELECT as_of, symbol, CASE WHEN NOT coalesce(any_value(tcap) > 0, false) THEN NULL WHEN count_if(cap >= 0.1e0 * tcap) >= 2 THEN 0.1e0
         WHEN count_if(cap >= 0.05e0 * tcap) >= 2 THEN 0.05e0 WHEN count_if(cap >= 0.01e0 * tcap) >= 2 THEN 0.01e0 WHEN count(*) >= 2 THEN 0e0 END AS f FROM o GROUP BY 1, 2),
s AS (SELECT o.*, th.f FROM o JOIN th USING (as_of, symbol) WHERE r <= 10 AND (f IS NULL OR cap >= f * tcap)),
a AS (SELECT as_of, symbol, any_value(f) AS cap_threshold, count(*) AS peer_count, string_agg(CAST(ps AS VARCHAR), ',' ORDER BY r) AS peer_symbols,
  count_if(pe_den > 0 AND cap / pe_den < 60) AS npe, count_if(pb_den > 0 AND cap / pb_den <= 20) AS npb,
  quantile_cont(CASE WHEN pe_den > 0 AND cap / pe_den < 60 THEN cap / pe_den END, [0.25, 0.5, 0.75]) AS qpe,
  quantile_cont(CASE WHEN pb_den > 0 AND cap / pb_den <= 20 THEN cap / pb_den END, [0.25, 0.5, 0.75, 0.9]) AS qpb,
  sum(CASE WHEN pe_den > 0 THEN cap END) / sum(CASE WHEN pe_den > 0 THEN pe_den END) AS pe_gross,
  sum(CASE WHEN pb_den > 0 THEN cap END) / sum(CASE WHEN pb_den > 0 THEN pb_den END) AS pb_gross FROM s GROUP BY 1, 2),
cut AS (SELECT as_of, level, node, quantile_cont(market_cap, 0.9) AS c90, count(*) AS n_all FROM {p}_nodes WHERE liquidity_flag AND market_cap > 0 GROUP BY 1, 2, 3)
SELECT l.as_of, l.symbol, l.level, l.node, cap_threshold, coalesce(peer_count, 0) AS peer_count, coalesce(n_all, 0) - CAST(m.liquidity_flag AND m.market_cap > 0 AS INTEGER) AS liquid_peer_count,
  coalesce(peer_symbols, '') AS peer_symbols, coalesce(m.market_cap >= c90, false) AS top_decile,
  CASE WHEN npe >= 2 THEN qpe[1] END AS pe_p25, CASE WHEN npe >= 2 THEN qpe[2] END AS pe_p50, CASE WHEN npe >= 2 THEN qpe[3] END AS pe_p75,
  CASE WHEN npb >= 2 THEN qpb[1] END AS pb_p25, CASE WHEN npb >= 2 THEN qpb[2] END AS pb_p50, CASE WHEN npb >= 2 THEN qpb[3] END AS pb_p75,
  CASE WHEN npb >= 2 THEN qpb[4] END AS pb_p90, pe_gross, pb_gross
FROM {p}_levels l JOIN {p}_u m USING (as_of, symbol) LEFT JOIN a USING (as_of, symbol) LEFT JOIN cut ON cut.as_of = l.as_of AND cut.level = l.level AND cut.node = l.node""",
           (f"{p}_levels", f"{p}_u", f"{p}_nodes"))
    define(f"{p}_reg", f"""
WITH j AS (SELECT l.as_of, l.symbol, m.roe AS roe_own, x.pb, x.roe FROM {p}_levels l JOIN {p}_u m USING (as_of, symbol)
  JOIN {p}_clean x ON x.as_of = l.as_of AND x.level = l.level AND x.node = l.node
  WHERE x.symbol <> l.symbol AND x.pb IS NOT NULL AND x.roe > -0.2e0 AND x.roe < 0.6e0 AND m.roe IS NOT NULL),
f AS (SELECT as_of, symbol, any_value(roe_own) AS roe_own, count(*) AS n_fit, regr_slope(pb, roe) AS slope, regr_intercept(pb, roe) AS intercept,
  regr_r2(pb, roe) AS r2, quantile_cont(pb, 0.25) AS lo, quantile_cont(pb, 0.9) AS hi FROM j GROUP BY 1, 2)
SELECT as_of, symbol, n_fit, slope, intercept, r2, least(greatest(intercept + slope * roe_own, lo), hi) AS pb_target FROM f
WHERE n_fit >= 8 AND slope > 0 AND r2 >= 0.10""", (f"{p}_levels", f"{p}_u", f"{p}_clean"))


stage("now")
STAT_NUM = {"market_cap": 1, "avg_value_20d": 0, "pe_aggregate": 6, "ret_1m": 8, "ret_3m": 8, "ret_ytd": 8, "ret_1y": 8, "market_weight": 9}
VS = {f"{c}_vs_index": 8 for c in PE.RETURNS}


@query("industry_stats", "AGG-1", with_("now_stats index_rets", "SELECT as_of, level, node, n_symbols, n_liquid, n_with_bctc, "
       + ", ".join(f"round({c}, {n}) AS {c}" for c, n in STAT_NUM.items())
       + """, round(ret_1m - b1m, 8) AS ret_1m_vs_index, round(ret_3m - b3m, 8) AS ret_3m_vs_index, round(ret_ytd - bytd, 8) AS ret_ytd_vs_index,
       round(ret_1y - b1y, 8) AS ret_1y_vs_index FROM now_stats LEFT JOIN index_rets USING (as_of)"""))
def industry_stats(spark, d):
    bars = D.bars(spark, d)
    return rounded(PE.node_stats(now_universe(spark, d, bars), PE.index_returns(D.benchmark(bars))),
                   STAT_NUM | VS)


@query("industry_snapshot", "AGG-1", with_("now_stats", """
SELECT node, n_symbols, n_liquid, round(market_cap, 1) AS market_cap, round(market_weight, 9) AS market_weight, round(ret_1m, 8) AS ret_1m,
       round(avg_value_20d, 0) AS avg_value_20d FROM now_stats WHERE level = 1"""))
def industry_snapshot(spark, d):
    bars = D.bars(spark, d)
    df = PE.node_stats(now_universe(spark, d, bars), PE.index_returns(D.benchmark(bars)))
    df = df.where(F.col("level") == 1).select(
        "node", "n_symbols", "n_liquid", "market_cap", "market_weight", "ret_1m", "avg_value_20d")
    return rounded(df, {"market_cap": 1, "market_weight": 9, "ret_1m": 8, "avg_value_20d": 0})


@query("industry_quantiles", "AGG-1", with_("now_clean", """
SELECT level, node, metric, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75
FROM (SELECT level, node, unnest(['pe', 'pb', 'roe', 'net_margin', 'ni_growth']) AS metric, unnest([pe, pb, roe, net_margin, ni_growth]) AS value FROM now_clean)
WHERE value IS NOT NULL GROUP BY 1, 2, 3"""))
def industry_quantiles(spark, d):
    df = PE.node_quantiles(now_universe(spark, d), PE.STAT_METRICS, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return rounded(df.drop("as_of"), {"p25": 6, "median": 6, "p75": 6})


@query("industry_leaders", "AGG-1 TOP-3", with_("now_nodes", """
SELECT level, node, symbol, rank, round(market_cap, 2) AS market_cap FROM (SELECT *, row_number() OVER (PARTITION BY level, node ORDER BY market_cap DESC NULLS LAST, symbol) AS rank FROM now_nodes)
WHERE rank <= 5"""))
def industry_leaders(spark, d):
    return rounded(PE.largest_members(now_universe(spark, d)).select(
        "level", "node", "symbol", "rank", "market_cap"), {"market_cap": 2})


define("sector_scores", """
WITH dom AS (SELECT level, node, company_type, c FROM (SELECT level, node, company_type, sum(market_cap) AS c FROM now_nodes GROUP BY 1, 2, 3)
             QUALIFY row_number() OVER (PARTITION BY level, node ORDER BY c DESC NULLS LAST) = 1),
roe AS (SELECT level, node, median(roe) AS roe_median FROM now_clean WHERE roe IS NOT NULL GROUP BY 1, 2),
imp AS (SELECT unnest(['BANK', 'SECURITIES', 'INSURANCE', 'REAL_ESTATE', 'NON_FINANCIAL']) AS company_type, unnest([55e0, 40e0, 60e0, 45e0, 52e0]) AS impact),
b AS (SELECT s.*, company_type, roe_median, impact, ret_3m - b3m AS m3, ret_1y - b1y AS m12 FROM now_stats s JOIN dom USING (level, node) LEFT JOIN roe USING (level, node)
      LEFT JOIN imp USING (company_type) LEFT JOIN index_rets USING (as_of)),
c AS (SELECT *, CASE WHEN m3 IS NULL AND m12 IS NULL THEN NULL ELSE least(greatest(50 + (coalesce(m3, 0) + coalesce(m12, 0)) / ((m3 IS NOT NULL)::INT + (m12 IS NOT NULL)::INT) * 200, 0), 100) END AS mom,
       CASE WHEN roe_median IS NOT NULL THEN least(greatest(50 + (roe_median - 0.12e0) * 400, 0), 100) END AS rq FROM b)
SELECT *, (coalesce(mom, 0) * 0.4e0 + coalesce(rq, 0) * 0.3e0 + coalesce(impact, 0) * 0.3e0) /
   ((mom IS NOT NULL)::INT * 0.4e0 + (rq IS NOT NULL)::INT * 0.3e0 + (impact IS NOT NULL)::INT * 0.3e0) AS score FROM c""", ("now_nodes", "now_clean", "now_stats", "index_rets"))
IMPACT = {"BANK": 55.0, "SECURITIES": 40.0, "INSURANCE": 60.0, "REAL_ESTATE": 45.0, "NON_FINANCIAL": 52.0}


@query("sector_table", "AGG-2 SEC-1", with_("sector_scores", """
SELECT level, node, company_type, n_symbols, round(roe_median, 8) AS roe_median, round(score, 6) AS score,
  CASE WHEN ret_1m IS NOT NULL THEN rank() OVER (PARTITION BY level ORDER BY ret_1m DESC NULLS LAST) END AS rank_ret_1m,
  CASE WHEN ret_1y IS NOT NULL THEN rank() OVER (PARTITION BY level ORDER BY ret_1y DESC NULLS LAST) END AS rank_ret_1y,
  CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY level ORDER BY score DESC NULLS LAST) END AS rank_score FROM sector_scores"""))
def sector_table(spark, d):
    bars = D.bars(spark, d)
    impacts = spark.createDataFrame(list(IMPACT.items()), "company_type string, impact double")
    df = PE.sector_table(now_universe(spark, d, bars), PE.index_returns(D.benchmark(bars)), impacts)
    return rounded(df.select("level", "node", "company_type", "n_symbols", "roe_median", "score",
                             "rank_ret_1m", "rank_ret_1y", "rank_score"), {"roe_median": 8, "score": 6})


@query("market_map", "AGG-3", with_("now_u", """
SELECT level, path, node, parent, round(coalesce(sum(market_cap), 0), 1) AS size, count(*) AS count, round(median(ret_1m), 8) AS value
FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS level, unnest([icb1, icb2, icb3, icb4, CAST(symbol AS VARCHAR)]) AS node, unnest([NULL, icb1, icb2, icb3, icb4]) AS parent,
  unnest([icb1, concat_ws('/', icb1, icb2), concat_ws('/', icb1, icb2, icb3), concat_ws('/', icb1, icb2, icb3, icb4), concat_ws('/', icb1, icb2, icb3, icb4, CAST(symbol AS VARCHAR))]) AS path FROM now_u)
GROUP BY 1, 2, 3, 4"""))
def market_map(spark, d):
    return rounded(PE.market_tree(now_universe(spark, d)), {"size": 1, "value": 8})


@query("market_breadth", "AGG-4", with_("now_u", """
SELECT as_of, count(*) AS n_symbols, round(sum(market_cap), 1) AS market_cap, count_if(change_1d > 0) AS advancers, count_if(change_1d < 0) AS decliners,
  count(*) - count_if(change_1d > 0) - count_if(change_1d < 0) AS unchanged, count_if(has_bctc) AS n_with_bctc, count_if(liquidity_flag) AS n_liquid,
  count_if(icb1 = 'Chưa phân loại') AS n_unclassified, avg(CAST(icb1 <> 'Chưa phân loại' AS INTEGER)) AS industry_coverage,
  round(sum(market_cap) / sum(CASE WHEN market_cap IS NOT NULL THEN net_income_parent END), 6) AS pe_aggregate FROM now_u GROUP BY as_of"""))
def market_breadth(spark, d):
    return rounded(PE.market_breadth(now_universe(spark, d)), {"market_cap": 1, "pe_aggregate": 6})


@query("market_movers", "AGG-4", with_("now_u", """
SELECT side, rank, symbol, round(price, 6) AS price, round(change_1d, 8) AS change_1d FROM (
 SELECT 'gainer' AS side, *, row_number() OVER (ORDER BY change_1d DESC, symbol) AS rank FROM now_u WHERE liquidity_flag AND change_1d IS NOT NULL
 UNION ALL SELECT 'loser' AS side, *, row_number() OVER (ORDER BY change_1d, symbol) AS rank FROM now_u WHERE liquidity_flag AND change_1d IS NOT NULL) WHERE rank <= 5"""))
def market_movers(spark, d):
    return rounded(PE.movers(now_universe(spark, d)), {"price": 6, "change_1d": 8})


@query("peer_levels", "JN-7", with_("now_levels", "SELECT symbol, level, node, n_peers, n_liquid FROM now_levels"))
def peer_levels(spark, d):
    return PE.peer_levels(now_universe(spark, d)).drop("as_of")


CMP_NUM = {c: 6 for c in ("pe_p25", "pe_p50", "pe_p75", "pe_gross")} | {c: 8 for c in ("pb_p25", "pb_p50", "pb_p75", "pb_p90", "pb_gross")}


@query("peer_comparison", "JN-8", with_("now_cmp", "SELECT symbol, level, node, cap_threshold, peer_count, liquid_peer_count, peer_symbols, top_decile, "
       + ", ".join(f"round({c}, {n}) AS {c}" for c, n in CMP_NUM.items()) + " FROM now_cmp"))
def peer_comparison(spark, d):
    u = now_universe(spark, d)
    return rounded(PE.peer_comparison(u, PE.peer_levels(u)).drop("as_of"), CMP_NUM)


@query("peer_quantiles", "AGG-12", with_("now_clean", """
SELECT level, node, metric, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75
FROM (SELECT level, node, unnest(['pe', 'pb', 'ev_ebitda', 'roe', 'net_margin', 'ni_growth']) AS metric, unnest([pe, pb, ev_ebitda, roe, net_margin, ni_growth]) AS value FROM now_clean)
WHERE value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3"""))
def peer_quantiles(spark, d):
    df = PE.node_quantiles(now_universe(spark, d), PE.PEER_METRICS, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, 3)
    return rounded(df.drop("as_of"), {"p25": 6, "p50": 6, "p75": 6})


@query("peer_positions", "AGG-12", with_("now_nodes now_levels", """
WITH v AS (SELECT level, node, symbol, unnest(['pe', 'pb', 'roe', 'net_margin', 'ni_growth', 'ret_1y', 'market_cap']) AS metric, unnest([pe, pb, roe, net_margin, ni_growth, ret_1y, market_cap]) AS value FROM now_nodes),
c AS (SELECT *, count(*) OVER (PARTITION BY level, node, metric) AS n, count(*) OVER (PARTITION BY level, node, metric ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le FROM v WHERE value IS NOT NULL)
SELECT symbol, level, node, metric, round(CASE WHEN n >= 3 THEN CAST(le AS DOUBLE) / n END, 9) AS position FROM c JOIN now_levels USING (level, node, symbol)"""))
def peer_positions(spark, d):
    u = now_universe(spark, d)
    df = PE.peer_positions(u, PE.peer_levels(u))
    return rounded(df.select("symbol", "level", "node", "metric", "position"), {"position": 9})


@query("pb_roe_regression", "AGG-15", with_("now_reg", """
SELECT symbol, n_fit, round(slope, 4) AS slope, round(intercept, 5) AS intercept, round(r2, 6) AS r2, round(pb_target, 6) AS pb_target FROM now_reg"""))
def pb_roe_regression(spark, d):
    u = now_universe(spark, d)
    return rounded(PE.pb_roe_regression(u, PE.peer_levels(u)).drop("as_of"),
                   {"slope": 4, "intercept": 5, "r2": 6, "pb_target": 6})


@query("node_index", "AGG-7", with_("bars calendar securities", """
WITH k AS (SELECT max(idx) AS last FROM calendar), days AS (SELECT time, idx FROM calendar, k WHERE idx > last - 260),
g AS (SELECT s.symbol, shares, days.time, idx, unnest([1, 2, 3, 4]) AS level, unnest([icb1, icb2, icb3, icb4]) AS node FROM securities s CROSS JOIN days),
f AS (SELECT g.*, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol, level ORDER BY g.idx) AS px FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.time = g.time),
ok AS (SELECT symbol FROM bars WHERE time = (SELECT min(time) FROM days)),
c AS (SELECT level, node, time, sum(px * shares) AS cap FROM f WHERE symbol IN (SELECT symbol FROM ok) GROUP BY 1, 2, 3),
t AS (SELECT DISTINCT level, node, b.time FROM f JOIN bars b ON b.symbol = f.symbol AND b.time = f.time WHERE f.symbol IN (SELECT symbol FROM ok))
SELECT level, node, time, round(cap / first_value(cap) OVER (PARTITION BY level, node ORDER BY time) * 100, 5) AS value FROM c JOIN t USING (level, node, time)"""))
def node_index(spark, d):
    bars = D.bars(spark, d)
    return rounded(U.node_index(D.securities(spark, d), bars, D.calendar(bars)), {"value": 5})


@query("aligned_panel", "SET-1 CLS-3", with_("bars calendar securities numbered", """
SELECT s.symbol, c.time, b.open, b.close, round(adv20, 1) AS adv20, coalesce(locked, false) AS locked FROM securities s CROSS JOIN calendar c
LEFT JOIN (SELECT n.symbol, n.time, n.open, n.close, avg(close * volume) OVER (PARTITION BY n.symbol ORDER BY n.time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS adv20,
   close <= prev * (1 - band) + (CASE WHEN exchange <> 'HOSE' THEN 100e0 WHEN prev < 10000 THEN 10e0 WHEN prev < 50000 THEN 50e0 ELSE 100e0 END) AND low >= close * (1 - 1e-6) AS locked
   FROM numbered n JOIN (SELECT symbol, exchange, CASE exchange WHEN 'HOSE' THEN 0.07e0 WHEN 'HNX' THEN 0.10e0 ELSE 0.15e0 END AS band FROM securities) USING (symbol)) b
ON b.symbol = s.symbol AND b.time = c.time"""))
def aligned_panel(spark, d):
    bars = D.bars(spark, d)
    flags = C.session_flags(bars, D.securities(spark, d))
    return rounded(U.aligned_panel(bars, D.calendar(bars), flags), {"adv20": 1})


@query("universe_invariants", "CHK-4 AGG-19", with_("now_u", """
SELECT count(*) AS n_universe, count(DISTINCT symbol) = count(*) AS unique_symbols, (SELECT max(k) FROM (SELECT count(DISTINCT icb4) AS k FROM now_u GROUP BY symbol)) = 1 AS one_leaf_per_symbol,
 (SELECT sum(k) FROM (SELECT count(*) AS k FROM now_u GROUP BY icb1)) = count(*) AS nodes_add_up, count(price) AS n_with_price, count_if(has_bctc) AS n_with_bctc, count_if(liquidity_flag) AS n_liquid FROM now_u"""))
def universe_invariants(spark, d):
    from fjordquant.operators.checks import universe_invariants as op

    return op(now_universe(spark, d))


@query("universe_page", "FLT-4", with_("now_u", """
SELECT symbol, exchange, round(market_cap, 2) AS market_cap FROM now_u WHERE exchange IN ('HOSE', 'HNX') AND icb1 = 'ASIA' AND coalesce(avg_value_20d, 0) >= 1e8
ORDER BY market_cap DESC NULLS LAST, symbol LIMIT 5 OFFSET 5"""))
def universe_page(spark, d):
    from fjordquant.operators.screening import universe_page as op

    df = op(now_universe(spark, d), exchange="HOSE,HNX", node="1-asia", min_value=1e8, page=2, page_size=5)
    return rounded(df.select("symbol", "exchange", "market_cap"), {"market_cap": 2})


@query("symbol_search", "TOP-4", with_("now_u", """
WITH n AS (SELECT symbol, CAST(symbol AS VARCHAR) AS code, lower(trim(regexp_replace(name, '[^a-zA-Z0-9]+', ' ', 'g'))) AS nm, lower(trim(regexp_replace(brand, '[^a-zA-Z0-9]+', ' ', 'g'))) AS br, market_cap FROM now_u),
t AS (SELECT *, CASE WHEN code = '9' THEN 0 WHEN starts_with(code, '9') THEN 1 WHEN contains(code, '9') THEN 2 WHEN starts_with(replace(br, ' ', ''), '9') THEN 3
  WHEN len(list_filter(string_split(nm, ' '), lambda w: starts_with(w, '9'))) > 0 THEN 4 WHEN contains(nm, '9') OR contains(br, '9') THEN 5 END AS tier FROM n)
SELECT symbol, tier, row_number() OVER (ORDER BY tier, coalesce(market_cap, 0) DESC, code) AS rank FROM t
WHERE tier IS NOT NULL AND (tier <= 2 OR (SELECT min(tier) FROM t) > 2) ORDER BY rank LIMIT 20"""))
def symbol_search(spark, d):
    from fjordquant.operators.screening import symbol_search as op

    return op(now_universe(spark, d), "9", limit=20)


@query("symbol_search_words", "TOP-4", with_("now_u", """
WITH n AS (SELECT symbol, CAST(symbol AS VARCHAR) AS code, lower(trim(regexp_replace(name, '[^a-zA-Z0-9]+', ' ', 'g'))) AS nm, lower(trim(regexp_replace(brand, '[^a-zA-Z0-9]+', ' ', 'g'))) AS br, market_cap FROM now_u WHERE exchange = 'HNX'),
t AS (SELECT *, CASE WHEN starts_with(replace(br, ' ', ''), 'nation1') THEN 3
  WHEN len(list_filter(string_split(nm, ' '), lambda w: starts_with(w, 'nation 1'))) > 0 THEN 4 WHEN contains(nm, 'nation 1') OR contains(br, 'nation 1') THEN 5 END AS tier FROM n)
SELECT symbol, tier, row_number() OVER (ORDER BY tier, coalesce(market_cap, 0) DESC, code) AS rank FROM t WHERE tier IS NOT NULL ORDER BY rank LIMIT 20"""))
def symbol_search_words(spark, d):
    from fjordquant.operators.screening import symbol_search as op

    return op(now_universe(spark, d), "Nation 1", exchange="HNX", limit=20)


@query("nearest_names", "TOP-5", with_("securities", """
SELECT symbol, name, levenshtein(name, 'Supplier#000000017') AS distance, row_number() OVER (ORDER BY levenshtein(name, 'Supplier#000000017'), name) AS rank
FROM securities WHERE levenshtein(name, 'Supplier#000000017') <= 2 ORDER BY rank LIMIT 3"""))
def nearest_names(spark, d):
    from fjordquant.operators.screening import nearest_names as op

    return op(D.securities(spark, d), "Supplier#000000017")


@query("industry_of_symbols", "JN-19", with_("securities", """
SELECT p_partkey AS symbol, coalesce(icb3, 'Khac') AS industry FROM part LEFT JOIN securities ON symbol = p_partkey"""))
def industry_of_symbols(spark, d):
    from fjordquant.operators.screening import industry_of

    parts = D.table(spark, d, "part").select(F.col("p_partkey").alias("symbol"))
    return industry_of(parts, D.securities(spark, d), "icb3")


@query("rebased_lines", "JN-18 PRJ-9", with_("bars", """
WITH w AS (SELECT *, max(time) OVER () AS mx FROM bars WHERE symbol IN (1, 2, 3, 4)),
y AS (SELECT * FROM w WHERE time > mx - 365),
r AS (SELECT symbol, time, close / first_value(close) OVER (PARTITION BY symbol ORDER BY time) * 100 AS v FROM y)
SELECT time, round(max(CASE WHEN symbol = 1 THEN v END), 8) AS s1, round(max(CASE WHEN symbol = 2 THEN v END), 8) AS s2, round(max(CASE WHEN symbol = 3 THEN v END), 8) AS s3,
  round(max(CASE WHEN symbol = 4 THEN v END), 8) AS s4 FROM r GROUP BY time"""))
def rebased_lines(spark, d):
    from fjordquant.operators.screening import rebased_lines as op

    df = op(D.bars(spark, d), [1, 2, 3, 4])
    return rounded(df.select("time", *[F.col(str(k)).alias(f"s{k}") for k in (1, 2, 3, 4)]),
                   {f"s{k}": 8 for k in (1, 2, 3, 4)})


@query("industry_peers_by_value", "JN-16", with_("now_u", """
SELECT a.symbol, b.symbol AS peer, row_number() OVER (PARTITION BY a.symbol ORDER BY b.avg_value_20d DESC NULLS LAST, b.symbol) AS rank
FROM now_u a JOIN now_u b ON a.icb3 = b.icb3 AND a.symbol <> b.symbol QUALIFY rank <= 6"""))
def industry_peers_by_value(spark, d):
    from fjordquant.operators.screening import industry_peers

    return industry_peers(now_universe(spark, d), "icb3", 6)



