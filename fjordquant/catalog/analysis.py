"""Valuation, scores, opportunity ranking and past scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.catalog import technical as TQ
from fjordquant.catalog.market import IMPACT, MULTIPLES, now_universe, stage
from fjordquant.catalog.registry import query
from fjordquant.catalog.statements import annual_typed, deduped
from fjordquant.functions.numeric import rounded
from fjordquant.operators import analysis as A
from fjordquant.operators import indicators as I
from fjordquant.operators import peers as PE
from fjordquant.operators import pit as P
from fjordquant.operators import scoring as SC
from fjordquant.operators import valuation as V
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_
from fjordquant.session import materialise, settle, spread

# ------------------------------------------------------------ check SQL stages
define("features", """
WITH b AS (SELECT a.symbol, a.company_type, a.year, a.net_income_parent, a.net_income, a.equity, a.minority_interest, a.pbt, a.interest_expense, a.depreciation,
   a.cash, a.short_investments, r.roe AS roe_last, r.debt_to_equity AS debt_to_equity_last, r.cir, r.credit_cost, r.equity_to_assets, r.current_ratio, r.interest_coverage, r.cfo_to_ni,
   dec_close, CASE WHEN a.company_type = 'BANK' THEN total_operating_income ELSE revenue END AS top, cfo + capex + abs(interest_expense) * 0.8e0 AS fcff, short_debt + long_debt AS debt,
   equity - coalesce(minority_interest, 0) AS eqp
  FROM annual_typed a JOIN ratios r USING (symbol, year)
  LEFT JOIN (SELECT symbol, year(time) AS year, max_by(close, time) AS dec_close FROM bars WHERE month(time) = 12 GROUP BY 1, 2) d USING (symbol, year))
SELECT *, make_date(year + 1, 4, 1) AS visible_from,
  CASE WHEN count(*) OVER w6 >= 3 AND first_value(net_income_parent) OVER w6 > 0 AND net_income_parent > 0 THEN power(net_income_parent / first_value(net_income_parent) OVER w6, 1e0 / greatest(year - first_value(year) OVER w6, 1)) - 1 END AS g_raw,
  CASE WHEN count(*) OVER w6 >= 2 AND first_value(net_income_parent) OVER w6 > 0 AND net_income_parent > 0 THEN power(net_income_parent / first_value(net_income_parent) OVER w6, 1e0 / greatest(year - first_value(year) OVER w6, 1)) - 1 END AS ni_cagr,
  CASE WHEN count(*) OVER w6 >= 2 AND first_value(top) OVER w6 > 0 AND top > 0 THEN power(top / first_value(top) OVER w6, 1e0 / greatest(year - first_value(year) OVER w6, 1)) - 1 END AS top_line_cagr,
  avg(fcff) OVER w3 AS fcff3, avg(debt) OVER w2 AS avg_debt, abs(interest_expense) AS interest, avg(roe_last) OVER w3 AS roe3, avg(cfo_to_ni) OVER w3 AS cfo_to_ni3, count(*) OVER w6 AS n_years, 0 AS failed_checks
FROM b WINDOW w6 AS (PARTITION BY symbol ORDER BY year ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY symbol ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  w2 AS (PARTITION BY symbol ORDER BY year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""", ("annual_typed", "ratios", "bars"))
define("hist_u", f"""
SELECT *, {MULTIPLES} FROM (
 SELECT s.*, p.* EXCLUDE (symbol), m.* EXCLUDE (symbol, as_of, available_from), t.ni_ttm, t.ttm_label, CAST(NULL AS DOUBLE) AS ret_ytd FROM securities s
 JOIN (SELECT as_of, p.* RENAME (time AS as_of_price), p.time = as_of AS traded_today FROM month_ends JOIN panel p ON p.time <= as_of AND p.time > as_of - 30
       QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY p.time DESC) = 1) p USING (symbol)
 LEFT JOIN (SELECT as_of, m.* FROM month_ends JOIN annual_metrics m ON available_from <= as_of QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY fin_year DESC) = 1) m
   ON m.symbol = s.symbol AND m.as_of = p.as_of
 LEFT JOIN (SELECT as_of, symbol, net_income_parent_ttm AS ni_ttm, ttm_label FROM month_ends JOIN ttm_all ON available_from <= as_of
       QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY available_from DESC, q DESC) = 1) t ON t.symbol = s.symbol AND t.as_of = p.as_of)""",
       ("securities", "panel", "month_ends", "annual_metrics", "ttm_all"))
stage("hist")
define("now_f", "SELECT u.as_of, f.* FROM now_u u JOIN features f USING (symbol) QUALIFY row_number() OVER (PARTITION BY u.symbol ORDER BY f.year DESC) = 1", ("now_u", "features"))
define("hist_f", "SELECT u.as_of, f.* FROM hist_u u JOIN features f ON f.symbol = u.symbol AND f.visible_from <= u.as_of QUALIFY row_number() OVER (PARTITION BY u.as_of, u.symbol ORDER BY f.year DESC) = 1", ("hist_u", "features"))
define("now_beta", "SELECT u.as_of, u.symbol, beta FROM now_u u JOIN beta USING (symbol)", ("now_u", "beta"))
define("hist_beta", "SELECT u.as_of, u.symbol, beta FROM hist_u u JOIN betas b ON b.symbol = u.symbol AND b.week <= u.as_of QUALIFY row_number() OVER (PARTITION BY u.as_of, u.symbol ORDER BY week DESC) = 1", ("hist_u", "betas"))
define("now_tb", "SELECT symbol, max(i) AS li FROM numbered GROUP BY symbol", ("numbered",))
define("hist_tb", "SELECT DISTINCT n.symbol, n.i AS li FROM hist_u u JOIN numbered n ON n.symbol = u.symbol AND n.time = u.as_of_price", ("hist_u", "numbered"))


def value_stage(p: str) -> None:
    TQ.tech_stage(p)
    define(f"{p}_v0", f"""
WITH hm AS (SELECT u.as_of, u.symbol, count_if(h.net_income_parent > 0 AND h.dec_close * u.shares / h.net_income_parent < 60) AS npe, count_if(h.eqp > 0 AND h.dec_close * u.shares / h.eqp <= 20) AS npb,
   quantile_cont(CASE WHEN h.net_income_parent > 0 AND h.dec_close * u.shares / h.net_income_parent < 60 THEN h.dec_close * u.shares / h.net_income_parent END, [0.25, 0.5, 0.75]) AS qpe,
   quantile_cont(CASE WHEN h.eqp > 0 AND h.dec_close * u.shares / h.eqp <= 20 THEN h.dec_close * u.shares / h.eqp END, [0.25, 0.5, 0.75]) AS qpb
  FROM {p}_u u JOIN {p}_f f USING (as_of, symbol) JOIN features h ON h.symbol = u.symbol AND h.year BETWEEN f.year - 4 AND f.year WHERE h.dec_close IS NOT NULL GROUP BY 1, 2)
SELECT u.as_of, u.symbol, u.name, u.exchange, u.icb1, u.icb4, u.company_type, u.price, u.shares, u.ni_ttm, u.market_cap, u.avg_value_20d, u.has_bctc, u.n_sessions, u.traded_today, u.as_of_price,
  f.* EXCLUDE (as_of, symbol, company_type), c.pe_p25, c.pe_p50, c.pe_p75, c.pb_p25, c.pb_p90, coalesce(CASE WHEN c.pb_p50 IS NOT NULL THEN pb_target END, c.pb_p50) AS pb_p50,
  CASE WHEN c.pb_p50 IS NOT NULL AND pb_target IS NOT NULL THEN greatest(pb_target, c.pb_p75) ELSE c.pb_p75 END AS pb_p75, b.beta,
  CASE WHEN npe >= 3 THEN qpe END AS hpe, CASE WHEN npb >= 3 THEN qpb END AS hpb, u.price * u.shares AS cap, coalesce(u.ni_ttm, f.net_income_parent, f.net_income) AS nip,
  least(greatest(coalesce(g_raw, 0.05e0), -0.1e0), 0.2e0) AS g, greatest(0.03e0 + least(greatest(coalesce(b.beta, 1e0), 0.6e0), 1.8e0) * 0.08e0, 0.12e0) AS ke
FROM {p}_u u LEFT JOIN {p}_f f USING (as_of, symbol) LEFT JOIN {p}_cmp c USING (as_of, symbol) LEFT JOIN {p}_reg r USING (as_of, symbol) LEFT JOIN {p}_beta b USING (as_of, symbol) LEFT JOIN hm USING (as_of, symbol)""",
           (f"{p}_u", f"{p}_f", f"{p}_cmp", f"{p}_reg", f"{p}_beta", "features"))
    define(f"{p}_v1", f"""
WITH a AS (SELECT *, nip / shares AS eps, CASE WHEN eqp <> 0 THEN eqp / shares END AS bvps, CASE WHEN nip > 0 THEN cap / nip END AS cpe, CASE WHEN eqp > 0 THEN cap / eqp END AS cpb,
   debt / (debt + cap) AS wd, CASE WHEN debt <> 0 AND avg_debt <> 0 THEN least(greatest(interest / avg_debt, 0.05e0), 0.12e0) ELSE 0.08e0 END AS kd,
   least(least(greatest(roe3 * 0.75e0, 0), ke - 0.02e0), 0.06e0, ke - 0.04e0) AS bg FROM {p}_v0 WHERE year IS NOT NULL),
b AS (SELECT *, (1 - wd) * ke + wd * kd * 0.8e0 AS wacc,
   CASE WHEN NOT coalesce(pe_p50 <> 0 AND cpe IS NOT NULL AND NOT cpe / pe_p50 BETWEEN 0.25 AND 4, false) AND pe_p25 > 0 AND pe_p50 > 0 AND pe_p75 > 0 THEN [pe_p25, pe_p50, pe_p75] WHEN hpe[1] > 0 THEN hpe END AS pt,
   CASE WHEN NOT coalesce(pb_p50 <> 0 AND cpb IS NOT NULL AND NOT cpb / pb_p50 BETWEEN 0.25 AND 4, false) AND pb_p25 > 0 AND pb_p50 > 0 AND pb_p75 > 0 THEN [pb_p25, pb_p50, pb_p75] WHEN hpb[1] > 0 THEN hpb END AS bt FROM a),
d AS (SELECT as_of, symbol, k, w, q FROM (SELECT as_of, symbol, debt - cash - coalesce(short_investments, 0) + coalesce(minority_interest, 0) AS net, shares, fcff3, unnest([0, 1, 2]) AS k,
        unnest([wacc + 0.01e0, wacc, wacc - 0.01e0]) AS w, unnest([g - 0.02e0, g, g + 0.02e0]) AS gg FROM b WHERE company_type = 'NON_FINANCIAL' AND fcff3 > 0),
   LATERAL (SELECT fcff3 * (1 + gg) AS f1, fcff3 * (1 + gg) * (1 + gg + (0.03e0 - gg) / 4) AS f2, fcff3 * (1 + gg) * (1 + gg + (0.03e0 - gg) / 4) * (1 + gg + (0.03e0 - gg) * 2 / 4) AS f3) x,
   LATERAL (SELECT f3 * (1 + gg + (0.03e0 - gg) * 3 / 4) AS f4, f3 * (1 + gg + (0.03e0 - gg) * 3 / 4) * (1 + 0.03e0) AS f5) y,
   LATERAL (SELECT CASE WHEN w > 0.04e0 THEN (f1 / (1 + w) + f2 / power(1 + w, 2) + f3 / power(1 + w, 3) + f4 / power(1 + w, 4) + f5 / power(1 + w, 5) + f5 * 1.03e0 / (w - 0.03e0) / power(1 + w, 5) - net) / shares END AS q) z),
dd AS (SELECT as_of, symbol, [max(CASE WHEN k = 0 THEN q END), max(CASE WHEN k = 1 THEN q END), max(CASE WHEN k = 2 THEN q END)] AS dcf FROM d GROUP BY 1, 2)
SELECT b.*, CASE WHEN cpe < 60 AND eps > 0 AND pt IS NOT NULL THEN [eps * (1 + g) * pt[1], eps * (1 + g) * pt[2], eps * (1 + g) * pt[3]] END AS m_pe,
  CASE WHEN bvps > 0 AND bt IS NOT NULL THEN [bvps * bt[1], bvps * least(greatest(bt[1], coalesce(pb_p90, bt[3])), greatest(bt[1], bt[2])), bvps * greatest(bt[1], coalesce(pb_p90, bt[3]))] END AS m_pb,
  dcf AS m_dcf, CASE WHEN company_type = 'BANK' AND roe3 IS NOT NULL THEN [bvps * least(greatest((roe3 - 0.02e0 - bg) / (ke - bg), 0.3e0), 4), bvps * least(greatest((roe3 - bg) / (ke - bg), 0.3e0), 4),
     bvps * least(greatest((roe3 + 0.02e0 - bg) / (ke - bg), 0.3e0), 4)] END AS m_jpb FROM b LEFT JOIN dd USING (as_of, symbol)""", (f"{p}_v0",))
    define(f"{p}_v2", f"""
WITH l AS (SELECT as_of, symbol, price, company_type, unnest(['pe_relative', 'pb_relative', 'dcf_fcff', 'justified_pb']) AS key, unnest([m_pe, m_pb, m_dcf, m_jpb]) AS v FROM {p}_v1),
w AS (SELECT *, CASE company_type WHEN 'NON_FINANCIAL' THEN CASE key WHEN 'pe_relative' THEN 0.35e0 WHEN 'pb_relative' THEN 0.15e0 WHEN 'dcf_fcff' THEN 0.35e0 END
   WHEN 'BANK' THEN CASE key WHEN 'justified_pb' THEN 0.5e0 WHEN 'pb_relative' THEN 0.3e0 WHEN 'pe_relative' THEN 0.2e0 END
   ELSE CASE key WHEN 'pb_relative' THEN 0.6e0 WHEN 'pe_relative' THEN 0.4e0 END END AS w FROM l),
u AS (SELECT *, median(v[2]) OVER (PARTITION BY as_of, symbol) AS med, count(*) OVER (PARTITION BY as_of, symbol) AS n0 FROM w WHERE w > 0 AND v[1] > 0 AND v[2] > 0 AND v[3] > 0),
k AS (SELECT * FROM u WHERE n0 < 3 OR v[2] BETWEEN med / 2.5e0 AND med * 2.5e0),
t AS (SELECT as_of, symbol, count(*) AS n_methods, sum(v[1] * w) / sum(w) AS tb, sum(v[2] * w) / sum(w) AS tm, sum(v[3] * w) / sum(w) AS tu, CASE WHEN count(*) >= 2 THEN max(v[2]) / min(v[2]) END AS dispersion FROM k GROUP BY 1, 2),
r AS (SELECT as_of, symbol, n_methods, dispersion, round_even(tb / 100, 0) * 100 AS target_bear, round_even(tm / 100, 0) * 100 AS target_base, round_even(tu / 100, 0) * 100 AS target_bull FROM t)
SELECT v.*, coalesce(n_methods, 0) AS n_methods, dispersion, target_bear, target_base, target_bull, target_base / v.price - 1 AS upside,
  CASE WHEN coalesce(n_methods, 0) <= 1 OR coalesce(dispersion > 2.5, false) OR coalesce(NOT target_base / v.price - 1 BETWEEN -0.5 AND 1, false) THEN 'THẤP' WHEN n_methods = 2 THEN 'TRUNG BÌNH' ELSE 'CAO' END AS confidence
FROM (SELECT o.*, x.eps, x.bvps, x.wacc, x.m_pe, x.m_pb, x.m_dcf, x.m_jpb FROM {p}_v0 o LEFT JOIN {p}_v1 x USING (as_of, symbol)) v LEFT JOIN r USING (as_of, symbol)""", (f"{p}_v1", f"{p}_v0"))
    impact = ", ".join(f"{v}e0" for v in IMPACT.values())
    types = ", ".join(f"'{k}'" for k in IMPACT)
    macro = f"(SELECT unnest([{types}]) AS company_type, unnest([{impact}]) AS impact)" if p == "now" else f"(SELECT unnest([{types}]) AS company_type, CAST(NULL AS DOUBLE) AS impact)"
    define(f"{p}_s", f"""
WITH roe AS (SELECT as_of, level, node, median(roe) AS roe_median FROM {p}_clean WHERE roe IS NOT NULL GROUP BY 1, 2, 3),
sv AS (SELECT l.as_of, l.symbol, ret_3m - b3m AS m3, ret_1y - b1y AS m12, roe_median FROM {p}_levels l JOIN {p}_stats USING (as_of, level, node) LEFT JOIN roe USING (as_of, level, node) LEFT JOIN index_rets USING (as_of)),
g AS (SELECT v.*, impact AS score_macro, CAST(NULL AS DOUBLE) AS score_sentiment, CASE WHEN m3 IS NOT NULL OR m12 IS NOT NULL THEN least(greatest(50 + (coalesce(m3, 0) + coalesce(m12, 0)) / ((m3 IS NOT NULL)::INT + (m12 IS NOT NULL)::INT) * 200, 0), 100) END AS mom,
   CASE WHEN roe_median IS NOT NULL THEN least(greatest(50 + (roe_median - 0.12e0) * 400, 0), 100) END AS rq, CASE WHEN t.i >= 119 THEN t.total_score END AS tech_total,
   CASE WHEN roe_last IS NOT NULL THEN least(greatest(20 + roe_last * 300, 0), 100) END AS q1,
   CASE WHEN company_type = 'BANK' THEN least(greatest(100 - (cir - 0.25e0) * 200, 0), 100) WHEN debt_to_equity_last IS NOT NULL THEN least(greatest(100 - debt_to_equity_last * 40, 0), 100) END AS q2,
   CASE WHEN company_type = 'BANK' THEN least(greatest(100 - credit_cost * 3000, 0), 100) WHEN current_ratio IS NOT NULL THEN least(greatest(30 + (current_ratio - 0.8e0) * 50, 0), 100) END AS q3,
   CASE WHEN company_type = 'BANK' THEN least(greatest(equity_to_assets * 800, 0), 100) WHEN cfo_to_ni3 IS NOT NULL THEN least(greatest(30 + cfo_to_ni3 * 40, 0), 100) END AS q4,
   CASE WHEN company_type <> 'BANK' AND interest_coverage IS NOT NULL THEN least(greatest(interest_coverage * 12, 0), 100) END AS q5
  FROM {p}_v2 v LEFT JOIN sv USING (as_of, symbol) LEFT JOIN {macro} im USING (company_type) LEFT JOIN {p}_tech t ON t.symbol = v.symbol AND t.time = v.as_of_price),
h AS (SELECT *, (coalesce(mom, 0) * 0.4e0 + coalesce(rq, 0) * 0.3e0 + coalesce(score_macro, 0) * 0.3e0) / nullif((mom IS NOT NULL)::INT * 0.4e0 + (rq IS NOT NULL)::INT * 0.3e0 + (score_macro IS NOT NULL)::INT * 0.3e0, 0) AS score_sector,
   list_avg(list_filter([CASE WHEN year IS NOT NULL THEN q1 END, CASE WHEN year IS NOT NULL THEN q2 END, CASE WHEN year IS NOT NULL THEN q3 END, CASE WHEN year IS NOT NULL THEN q4 END, CASE WHEN year IS NOT NULL THEN q5 END], lambda z: z IS NOT NULL)) AS score_quality,
   CASE WHEN top_line_cagr IS NOT NULL OR ni_cagr IS NOT NULL THEN least(greatest(45 + (coalesce(top_line_cagr, 0) + coalesce(ni_cagr, 0)) / ((top_line_cagr IS NOT NULL)::INT + (ni_cagr IS NOT NULL)::INT) * 250, 0), 100) END AS score_growth,
   CASE WHEN confidence <> 'THẤP' AND upside IS NOT NULL THEN least(greatest(50 + upside * 150, 0), 100) END AS score_valuation,
   CASE WHEN tech_total IS NOT NULL THEN least(greatest(50 + tech_total / 2, 0), 100) END AS score_technical FROM g),
i AS (SELECT *, (score_macro IS NOT NULL)::INT + (score_sector IS NOT NULL)::INT + (score_quality IS NOT NULL)::INT + (score_growth IS NOT NULL)::INT + (score_valuation IS NOT NULL)::INT + (score_technical IS NOT NULL)::INT AS n_groups,
   (coalesce(score_macro, 0) * 0.1e0 + coalesce(score_sector, 0) * 0.15e0 + coalesce(score_quality, 0) * 0.2e0 + coalesce(score_growth, 0) * 0.1e0 + coalesce(score_valuation, 0) * 0.25e0 + coalesce(score_technical, 0) * 0.1e0)
   / nullif((score_macro IS NOT NULL)::INT * 0.1e0 + (score_sector IS NOT NULL)::INT * 0.15e0 + (score_quality IS NOT NULL)::INT * 0.2e0 + (score_growth IS NOT NULL)::INT * 0.1e0 + (score_valuation IS NOT NULL)::INT * 0.25e0 + (score_technical IS NOT NULL)::INT * 0.1e0, 0) AS tot,
   CASE WHEN upside >= 0.2 THEN 4 WHEN upside >= 0.1 THEN 3 WHEN upside >= -0.05 THEN 2 WHEN upside >= -0.15 THEN 1 WHEN upside IS NOT NULL THEN 0 END AS b FROM h),
j AS (SELECT *, CASE WHEN n_groups >= 3 THEN tot END AS score, CASE WHEN n_groups >= 3 AND tot >= 70 AND b < 4 THEN b + 1 WHEN n_groups >= 3 AND tot < 40 AND b > 0 THEN b - 1 ELSE b END AS m FROM i),
r AS (SELECT *, CASE WHEN confidence = 'THẤP' THEN 'THEO DÕI' ELSE ['BÁN', 'KÉM KHẢ QUAN', 'NẮM GIỮ', 'KHẢ QUAN', 'MUA'][m + 1] END AS rating,
   CASE WHEN confidence <> 'THẤP' THEN ['BÁN', 'KÉM KHẢ QUAN', 'NẮM GIỮ', 'KHẢ QUAN', 'MUA'][b + 1] END AS base_rating FROM j)
SELECT *, has_bctc AND confidence IN ('CAO', 'TRUNG BÌNH') AND coalesce(avg_value_20d >= 5e9, false) AND coalesce(rating = 'MUA', false) AND coalesce(upside > 0 AND upside <= 1.5, false) AND score IS NOT NULL AS eligible FROM r""",
           (f"{p}_v2", f"{p}_clean", f"{p}_levels", f"{p}_stats", "index_rets", f"{p}_tech"))


value_stage("now")
value_stage("hist")


# ------------------------------------------------------------------ Spark side
def features(spark, d, bars, sums=None):
    return V.annual_features(annual_typed(spark, d, sums), V.december_closes(bars))


def quarter_sums(spark, d):
    """The sums behind all statements, from one scan."""
    return settle(D.quarter_sums(spark, d))


def now_valuation(spark, d):
    bars, sums = materialise(D.bars(spark, d)), quarter_sums(spark, d)
    u = materialise(now_universe(spark, d, bars, sums))
    betas = u.select("as_of", "symbol").join(I.weekly_beta(bars, D.benchmark(bars)), "symbol")
    f = A.features_now(u, features(spark, d, bars, sums))
    return bars, u, A.valuation(u, f, betas.select("as_of", "symbol", "beta"))


def signal_bars(spark, d):
    return settle(D.bars(spark, d))


def hist_universe(spark, d, bars, sums=None):
    sums = quarter_sums(spark, d) if sums is None else sums
    return A.universe_as_of(D.securities(spark, d), bars, D.annual(D.quarters(spark, d, sums)),
                            deduped(spark, d, sums), D.month_ends(bars))


def past_universe(spark, d):
    """Bars, statement sums and the universe of all signal dates, for several readers."""
    bars, sums = signal_bars(spark, d), quarter_sums(spark, d)
    return bars, sums, settle(hist_universe(spark, d, bars, sums))


def hist_valuation(spark, d, bars, u=None, sums=None, levels=None):
    sums = quarter_sums(spark, d) if sums is None else sums
    u = settle(hist_universe(spark, d, bars, sums)) if u is None else u
    rolled = I.rolling_beta(I.weekly_pairs(bars, D.benchmark(bars)))
    # the weeks are dealt by symbol already
    keys = spread(u.select("as_of", "symbol"), "symbol")
    betas = settle(P.attach_as_of(keys, rolled, ["symbol"], "as_of", "week", ["beta"]))
    return u, A.valuation(u, A.features_as_of(u, features(spark, d, bars, sums)), betas, levels)


def impacts(spark):
    return spark.createDataFrame(list(IMPACT.items()), "company_type string, impact double")


def now_scores(spark, d):
    bars, u, valued = now_valuation(spark, d)
    sector = A.sector_view(u, PE.index_returns(D.benchmark(bars)), impacts(spark))
    return A.score_universe(u, valued, sector, A.technical_totals(bars, u))


def hist_scores(spark, d, bars, u=None, sums=None):
    """Past scores.  Each large step is written before the next, so that the disk holds the
    shuffle files of one step at a time."""
    sums = quarter_sums(spark, d) if sums is None else sums
    u = settle(hist_universe(spark, d, bars, sums)) if u is None else u
    levels = settle(PE.peer_levels(u))
    tech = settle(A.technical_totals(bars, u))
    u, valued = hist_valuation(spark, d, bars, u, sums, levels)
    valued = settle(valued.select("as_of", "symbol", *A.VALUED))
    sector = A.sector_view(u, PE.index_returns(D.benchmark(bars)), None, levels)
    return A.score_universe(u, valued, sector, tech)


@query("universe_as_of", "JN-3 JN-5 WIN-13", with_("hist_u", """
SELECT as_of, symbol, as_of_price, traded_today, n_sessions, fin_year, ttm_label, round(price, 6) AS price, round(market_cap, 2) AS market_cap, round(pe, 5) AS pe, round(pb, 8) AS pb,
  round(pe_ttm, 5) AS pe_ttm, liquidity_flag, has_bctc FROM hist_u"""))
def universe_as_of(spark, d):
    u = hist_universe(spark, d, D.bars(spark, d)).select(
        "as_of", "symbol", "as_of_price", "traded_today", "n_sessions", "fin_year", "ttm_label", "price",
        "market_cap", "pe", "pb", "pe_ttm", "liquidity_flag", "has_bctc")
    return rounded(u, {"price": 6, "market_cap": 2, "pe": 5, "pb": 8, "pe_ttm": 5})


FEATURE_NUM = {"g_raw": 8, "ni_cagr": 8, "top_line_cagr": 8, "fcff3": 1, "avg_debt": 1, "roe3": 8, "cfo_to_ni3": 6}


@query("valuation_inputs", "AGG-17 VAL-4 VAL-5", with_("features", "SELECT symbol, year, n_years, visible_from, "
       + ", ".join(f"round({c}, {n}) AS {c}" for c, n in FEATURE_NUM.items()) + " FROM features"))
def valuation_inputs(spark, d):
    df = features(spark, d, D.bars(spark, d))
    return rounded(df.select("symbol", "year", "n_years", "visible_from", *FEATURE_NUM), FEATURE_NUM)


@query("december_multiples", "AGG-16", with_("now_v0", """
SELECT symbol, round(hpe[1], 5) AS hist_pe_p25, round(hpe[2], 5) AS hist_pe_p50, round(hpe[3], 5) AS hist_pe_p75,
  round(hpb[1], 7) AS hist_pb_p25, round(hpb[2], 7) AS hist_pb_p50, round(hpb[3], 7) AS hist_pb_p75 FROM now_v0"""))
def december_multiples(spark, d):
    bars = D.bars(spark, d)
    u = now_universe(spark, d, bars)
    df = V.historical_multiples(A.features_now(u, features(spark, d, bars)).join(
        u.select("symbol", "shares"), "symbol"))
    digits = {f"hist_pe_{t}": 5 for t in ("p25", "p50", "p75")} | {f"hist_pb_{t}": 7 for t in ("p25", "p50", "p75")}
    return rounded(df.select("symbol", *digits), digits)


VAL_NUM = {"upside": 7, "dispersion": 6, "ke": 9}
VAL_SQL = """n_methods, confidence, target_bear, target_base, target_bull, round(upside, 7) AS upside, round(dispersion, 6) AS dispersion, round(ke, 9) AS ke,
  round(m_pe[2], 3) AS pe_relative, round(m_pb[2], 3) AS pb_relative, round(m_dcf[2], 3) AS dcf_fcff, round(m_jpb[2], 3) AS justified_pb"""


def _valuation_view(df, *keys):
    out = df.select(
        *keys, "n_methods", "confidence", "target_bear", "target_base", "target_bull", "upside", "dispersion",
        "ke", *[F.col(f"{m}_base").alias(m) for m in ("pe_relative", "pb_relative", "dcf_fcff", "justified_pb")])
    return rounded(out, VAL_NUM | {m: 3 for m in ("pe_relative", "pb_relative", "dcf_fcff", "justified_pb")})


@query("valuation", "VAL-1 VAL-2 VAL-4 VAL-5 MTH-4 ARR-2", with_("now_v2", f"SELECT symbol, {VAL_SQL} FROM now_v2"))
def valuation(spark, d):
    return _valuation_view(now_valuation(spark, d)[2], "symbol")


@query("valuation_by_month", "VAL-2 BT-1 UDF-3", with_("hist_v2", f"SELECT as_of, symbol, {VAL_SQL} FROM hist_v2"))
def valuation_by_month(spark, d):
    return _valuation_view(hist_valuation(spark, d, signal_bars(spark, d))[1], "as_of", "symbol")


@query("ev_ebitda_targets", "VAL-3", with_("now_u now_f now_levels now_clean", """
WITH q AS (SELECT level, node, quantile_cont(ev_ebitda, [0.25, 0.5, 0.75]) AS q, count(ev_ebitda) AS n FROM now_clean GROUP BY 1, 2)
SELECT symbol, round((e * q[1] - net) / shares, 3) AS bear, round((e * q[2] - net) / shares, 3) AS base, round((e * q[3] - net) / shares, 3) AS bull
FROM (SELECT u.symbol, u.shares, pbt + abs(interest_expense) + abs(depreciation) AS e, debt - cash - coalesce(short_investments, 0) + coalesce(minority_interest, 0) AS net, q, n
      FROM now_u u JOIN now_f f USING (symbol) JOIN now_levels l USING (symbol) JOIN q USING (level, node) WHERE u.company_type = 'NON_FINANCIAL') WHERE n >= 3 AND e > 0"""))
def ev_ebitda_targets(spark, d):
    bars, u, v = now_valuation(spark, d)
    q = PE.peer_quantiles(u).select(*PE.NODE, *[F.col(f"ev_ebitda_{t}").alias(f"ev_{t}") for t in ("p25", "p50", "p75")])
    ev = PE.peer_levels(u).join(q, PE.NODE).select("symbol", "ev_p25", "ev_p50", "ev_p75")
    keep = [c for c in v.columns if not c.startswith("ev_")]
    df = V.methods(v.select(*keep).drop("valued", "eps", "bvps", "current_pe", "current_pb").join(ev, "symbol"))
    out = df.where(F.col("ev_ebitda_base").isNotNull()).select(
        "symbol", F.col("ev_ebitda_bear").alias("bear"), F.col("ev_ebitda_base").alias("base"),
        F.col("ev_ebitda_bull").alias("bull"))
    return rounded(out, {"bear": 3, "base": 3, "bull": 3})


@query("price_sensitivity", "VAL-6", with_("now_v1", """
SELECT symbol, pe_in, pb_in, ke_in, g_in, round(CASE WHEN eps > 0 THEN eps * pe_in END, 3) AS price_pe, round(CASE WHEN bvps > 0 THEN bvps * pb_in END, 3) AS price_pb,
  round(CASE WHEN ke_in > g_in THEN bvps * (roe3 - g_in) / (ke_in - g_in) END, 3) AS price_gordon
FROM now_v1, (SELECT unnest([8e0, 12e0, 16e0]) AS pe_in), (SELECT unnest([1e0, 1.5e0]) AS pb_in), (SELECT unnest([0.12e0, 0.15e0]) AS ke_in), (SELECT unnest([0.02e0, 0.05e0]) AS g_in)"""))
def price_sensitivity(spark, d):
    v = now_valuation(spark, d)[2].where("valued").select("symbol", "eps", "bvps", F.col("roe3").alias("roe"))
    df = V.sensitivity(v, [8.0, 12.0, 16.0], [1.0, 1.5], [0.12, 0.15], [0.02, 0.05])
    return rounded(df.select("symbol", "pe_in", "pb_in", "ke_in", "g_in", "price_pe", "price_pb", "price_gordon"),
                   {"price_pe": 3, "price_pb": 3, "price_gordon": 3})


GROUPS = ["score_macro", "score_sector", "score_quality", "score_growth", "score_valuation", "score_technical"]
SCORE_SQL = "rating, base_rating, eligible, round(score, 5) AS score, " + ", ".join(f"round({g}, 5) AS {g}" for g in GROUPS)


def _score_view(df, *keys):
    return rounded(df.select(*keys, "rating", "base_rating", "eligible", "score", *GROUPS),
                   {c: 5 for c in ["score", *GROUPS]})


@query("stock_analysis", "ANL-1 FIN-2 FIN-3 FLT-3 ARR-1", with_("now_s", f"SELECT symbol, {SCORE_SQL} FROM now_s"))
def stock_analysis(spark, d):
    return _score_view(now_scores(spark, d), "symbol")


@query("scores_by_month", "BT-1 FIN-2 FIN-3 FLT-3", with_("hist_s", f"SELECT as_of, symbol, {SCORE_SQL} FROM hist_s"))
def scores_by_month(spark, d):
    return _score_view(hist_scores(spark, d, signal_bars(spark, d)), "as_of", "symbol")


@query("opportunity_ranking", "FLT-5 TOP-3", with_("now_s", """
SELECT symbol, rating, eligible, round(score, 5) AS score, round(upside, 7) AS upside, rank FROM (SELECT *, row_number() OVER (ORDER BY coalesce(nullif(score, 0), -1) DESC, coalesce(nullif(upside, 0), -10) DESC,
  coalesce(avg_value_20d, 0) DESC, symbol) AS rank FROM now_s WHERE exchange IN ('HOSE', 'UPCOM') AND coalesce(avg_value_20d, 0) >= 1e9) WHERE rank <= 20"""))
def opportunity_ranking(spark, d):
    df = SC.opportunities(now_scores(spark, d), exchange="HOSE,UPCOM", min_value=1e9, eligible_only=False, limit=20)
    return rounded(df.select("symbol", "rating", "eligible", "score", "upside", "rank"), {"score": 5, "upside": 7})


@query("upside_distribution", "AGG-13", with_("hist_s", """
SELECT CASE WHEN upside IS NULL THEN 'missing' WHEN upside < -0.5 THEN '<-50%' WHEN upside <= 0 THEN '-50..0%' WHEN upside <= 0.25 THEN '0..25%' WHEN upside <= 0.5 THEN '25..50%'
  WHEN upside <= 1 THEN '50..100%' ELSE '>100%' END AS bucket, count(*) AS n, count_if(eligible) AS n_eligible FROM hist_s GROUP BY 1"""))
def upside_distribution(spark, d):
    return SC.upside_distribution(hist_scores(spark, d, signal_bars(spark, d)))


@query("roe_histogram", "AGG-14", with_("hist_u", """
WITH v AS (SELECT roe FROM hist_u WHERE roe IS NOT NULL), b AS (SELECT min(roe) AS lo, max(roe) AS hi FROM v)
SELECT bin, count(*) AS n, round(any_value(lo + bin * (hi - lo) / 12), 7) AS "from" FROM (SELECT *, least(CAST(floor((roe - lo) / ((hi - lo) / 12)) AS BIGINT), 11) AS bin FROM v, b) GROUP BY bin"""))
def roe_histogram(spark, d):
    return rounded(SC.histogram(hist_universe(spark, d, D.bars(spark, d)), "roe"), {"from": 7})


@query("eligible_by_month", "FLT-2", with_("hist_u", """
SELECT as_of, symbol, n_sessions, round(avg_value_20d, 1) AS avg_value_20d FROM hist_u WHERE n_sessions >= 120 AND avg_value_20d >= 5e9 AND has_bctc AND traded_today"""))
def eligible_by_month(spark, d):
    from fjordquant.operators.cleaning import eligible_universe

    df = eligible_universe(hist_universe(spark, d, D.bars(spark, d)))
    return rounded(df.select("as_of", "symbol", "n_sessions", "avg_value_20d"), {"avg_value_20d": 1})
