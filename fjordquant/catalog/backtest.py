"""Evaluation of scores over past dates: targets, returns, IC, walk-forward."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.catalog.analysis import hist_scores, hist_universe, past_universe, signal_bars
from fjordquant.catalog.registry import query
from fjordquant.functions.numeric import clip, rounded
from fjordquant.operators import evaluation as EV
from fjordquant.operators import pit as P
from fjordquant.operators import portfolio as PF
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_
from fjordquant.session import materialise, settle, spread


def signals(universe):
    """A light score table: profitability as score, momentum as upside."""
    return universe.select(
        "as_of", "symbol", "icb1", "as_of_price", "market_cap", "avg_value_20d", "ret_1m",
        clip(50 + F.col("roe") * 500, 0.0, 100.0).alias("score"), F.col("ret_3m").alias("upside"),
        (F.col("liquidity_flag") & F.col("roe").isNotNull() & F.col("ret_3m").isNotNull()).alias("eligible"))


define("sig", """
SELECT as_of, symbol, icb1, as_of_price, market_cap, avg_value_20d, ret_1m, least(greatest(50 + roe * 500, 0), 100) AS score, ret_3m AS upside,
  liquidity_flag AND roe IS NOT NULL AND ret_3m IS NOT NULL AS eligible FROM hist_u""", ("hist_u",))


def base(spark, d, past=None):
    """Bars and signals; ``past`` is the ``past_universe`` where others read it too."""
    if past is not None:
        return past[0], settle(signals(past[2]))
    bars = signal_bars(spark, d)
    return bars, settle(signals(hist_universe(spark, d, bars)))


def _top_sql(n, freq, where=""):
    cap = PF.sector_cap(n)
    q = "" if freq == "M" else " AND month(as_of) IN (3, 6, 9, 12)"
    return f"""
SELECT as_of, symbol, icb1, row_number() OVER (PARTITION BY as_of ORDER BY score DESC NULLS LAST, upside DESC NULLS LAST, avg_value_20d DESC NULLS LAST, symbol) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY as_of, icb1 ORDER BY score DESC NULLS LAST, upside DESC NULLS LAST, avg_value_20d DESC NULLS LAST, symbol) AS r FROM sig WHERE eligible{q}{where})
WHERE r <= {cap} QUALIFY rank <= {n}"""


@query("sector_capped_selection", "TOP-1", with_("sig", _top_sql(10, "M")))
def sector_capped_selection(spark, d):
    return PF.select_top(base(spark, d)[1], 10)


for _n, _f in S.GRID:
    define(f"sel_{_n}_{_f}", _top_sql(_n, _f), ("sig",))
define("grid_t", " UNION ALL ".join(
    f"SELECT 'top{n}_{f}' AS strategy, '{f}' AS freq, as_of, symbol, 1e0 / {n} AS weight FROM sel_{n}_{f}" for n, f in S.GRID),
    tuple(f"sel_{n}_{f}" for n, f in S.GRID))
define("bench_t", """
SELECT 'equal' AS strategy, 'M' AS freq, as_of, symbol, 1e0 / count(*) OVER (PARTITION BY as_of) AS weight FROM sig
UNION ALL SELECT 'cap20' AS strategy, 'M' AS freq, as_of, symbol, 1e0 / 20 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY market_cap DESC NULLS LAST, symbol) AS r FROM sig) WHERE r <= 20""", ("sig",))
define("all_t", "SELECT * FROM grid_t UNION ALL SELECT * FROM bench_t", ("grid_t", "bench_t"))


def all_targets(scores):
    return PF.grid_targets(scores).unionByName(
        PF.named(PF.equal_weight_targets(scores), "equal")).unionByName(
        PF.named(PF.cap_targets(scores, 20), "cap20"))


@query("target_weights", "TOP-2 SET-3", with_("all_t", "SELECT strategy, as_of, symbol, round(weight, 9) AS weight FROM all_t"))
def target_weights(spark, d):
    return rounded(all_targets(base(spark, d)[1]).select("strategy", "as_of", "symbol", "weight"), {"weight": 9})


@query("signal_dates_and_windows", "TOP-6", with_("calendar", """
WITH s AS (SELECT min(time) AS lo, max(time) AS hi FROM calendar),
w AS (SELECT hi, CAST(unnest(generate_series(lo, hi, INTERVAL 6 MONTH)) AS DATE) AS train_start FROM s),
x AS (SELECT hi, train_start, CAST(train_start + INTERVAL 24 MONTH AS DATE) AS test_start FROM w),
y AS (SELECT hi, train_start, test_start, least(CAST(test_start + INTERVAL 6 MONTH AS DATE), hi) AS test_end FROM x)
SELECT train_start, test_start, test_end FROM y WHERE test_start < hi AND test_end - test_start >= 20"""))
def signal_dates_and_windows(spark, d):
    return PF.train_test_windows(D.calendar(D.bars(spark, d)))


def returns_stage(p: str, targets: str, delay: int = 1, fee: float = 0.0025) -> None:
    """Straight from the rule: on each own bar the running rebalance, and that of the bar before."""
    define(f"{p}_ex", f"""
SELECT freq, as_of, c.idx + {delay} AS due, row_number() OVER (PARTITION BY freq ORDER BY as_of) AS k
FROM (SELECT DISTINCT as_of FROM sig) JOIN calendar c ON c.time = as_of CROSS JOIN (SELECT unnest(['M', 'Q']) AS freq)
WHERE c.idx + {delay} <= (SELECT max(idx) FROM calendar) AND (freq = 'M' OR month(as_of) IN (3, 6, 9, 12))""", ("sig", "calendar"))
    define(f"{p}_leg", f"""
WITH dy AS (SELECT freq, idx, max(k) AS k FROM {p}_ex JOIN calendar ON idx >= due GROUP BY 1, 2),
st AS (SELECT DISTINCT strategy, freq, symbol FROM {targets}),
b AS (SELECT symbol, time, idx, open, close, lag(close) OVER w AS pc, lag(idx) OVER w AS pidx FROM bars JOIN calendar USING (time) WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
x AS (SELECT st.strategy, b.*, d.k, e.k AS pk, st.freq FROM st JOIN b USING (symbol) JOIN dy d ON d.freq = st.freq AND d.idx = b.idx LEFT JOIN dy e ON e.freq = st.freq AND e.idx = b.pidx),
t AS (SELECT strategy, t.freq, k, symbol, weight FROM {targets} t JOIN {p}_ex e ON e.freq = t.freq AND e.as_of = t.as_of),
y AS (SELECT x.*, coalesce(n.weight, 0) AS w, coalesce(o.weight, 0) AS pw FROM x LEFT JOIN t n ON n.strategy = x.strategy AND n.k = x.k AND n.symbol = x.symbol LEFT JOIN t o ON o.strategy = x.strategy AND o.k = x.pk AND o.symbol = x.symbol)
SELECT strategy, time, CASE WHEN k = pk THEN w * (close / pc - 1) ELSE CASE WHEN pw > 0 THEN pw * (open / pc - 1) ELSE 0 END + w * (close / open - 1) END AS gross,
  abs(w - pw) AS traded, abs(w - pw) * {fee}e0 / 2 + greatest(pw - w, 0) * 0.001e0 AS cost FROM y WHERE w > 0 OR pw > 0""", (targets, f"{p}_ex", "bars", "calendar"))
    define(f"{p}_ret", f"""
WITH s AS (SELECT DISTINCT strategy, freq FROM {targets}), f AS (SELECT freq, min(due) AS due FROM {p}_ex GROUP BY 1),
l AS (SELECT strategy, time, sum(gross) - sum(cost) AS r, sum(traded) AS traded FROM {p}_leg GROUP BY 1, 2)
SELECT strategy, c.time, coalesce(r, 0) AS r, coalesce(traded, 0) AS traded FROM s JOIN f USING (freq) JOIN calendar c ON c.idx >= due LEFT JOIN l USING (strategy, time)""",
           (f"{p}_leg", f"{p}_ex", targets, "calendar"))
    define(f"{p}_eq", f"SELECT *, exp(sum(ln(1 + greatest(r, -0.999999e0))) OVER (PARTITION BY strategy ORDER BY time ROWS UNBOUNDED PRECEDING)) AS equity FROM {p}_ret", (f"{p}_ret",))


returns_stage("b", "all_t")
BASE = ("base", 1, S.FEE_ROUND_TRIP)
SCENARIOS = [BASE, ("late", 2, S.FEE_ROUND_TRIP), ("double_fee", 1, 2 * S.FEE_ROUND_TRIP)]
DROPPED = [("no_winners", 1, S.FEE_ROUND_TRIP)]


def all_returns(spark, d, past=None):
    """Bars, calendar, scores, targets and the base scenario's returns of every strategy."""
    bars, sig = base(spark, d, past)
    cal = materialise(D.calendar(bars))
    t = settle(all_targets(sig))
    r = PF.daily_returns(PF.in_scenarios(t, [BASE]), bars, cal, sig.select("as_of").distinct())
    return bars, cal, sig, t, settle(r.drop("scenario"))


@query("portfolio_returns", "BT-7", with_("b_eq", "SELECT strategy, time, round(r, 8) AS r, round(ln(equity), 6) AS log_equity FROM b_eq"))
def portfolio_returns(spark, d):
    df = PF.equity(all_returns(spark, d)[4]).withColumn("log_equity", F.log("equity"))
    return rounded(df.select("strategy", "time", "r", "log_equity"), {"r": 8, "log_equity": 6})


PHI = """(0.5e0 + sign(z) * least(0.5e0, exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda q: exp((2 * q + 1) * ln(abs(z)) - (lgamma(2 * q + 2) - q * ln(2e0) - lgamma(q + 1)))))))"""


def _moments_sql(src: str, by: str) -> str:
    return f"""
SELECT {by}, count(*) AS n_obs, avg(r) / stddev_samp(r) AS sr, avg(r) / stddev_pop(r) * sqrt(252e0) AS sharpe, avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(252e0) AS sortino,
  (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3 AS skew, kurtosis_pop(r) + 3 AS kurtosis FROM {src} GROUP BY {by}"""


define("b_perf", _moments_sql("b_ret", "strategy"), ("b_ret",))
define("b_bench", "SELECT time, close AS equity FROM benchmark_index", ("benchmark_index",))


@query("strategy_summary", "BT-6 WIN-18 WIN-19 MTH-1 MTH-2 UDF-4", with_("b_eq b_perf b_bench", f"""
WITH dd AS (SELECT strategy, equity / max(equity) OVER (PARTITION BY strategy ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM b_eq),
g AS (SELECT strategy, count(*) AS n_sessions, max_by(equity, time) / min_by(equity, time) AS gr FROM b_eq GROUP BY 1),
m AS (SELECT strategy, date_trunc('month', time) AS month, max_by(equity, time) AS l, min_by(equity, time) AS f, count(*) AS n FROM b_eq GROUP BY 1, 2),
mr AS (SELECT strategy, month, CASE WHEN lag(l) OVER w IS NOT NULL THEN l / lag(l) OVER w - 1 WHEN n > 1 THEN l / f - 1 END AS r FROM m WINDOW w AS (PARTITION BY strategy ORDER BY month)),
bm AS (SELECT date_trunc('month', time) AS month, max_by(equity, time) AS l, min_by(equity, time) AS f, count(*) AS n FROM b_bench GROUP BY 1),
br AS (SELECT month, CASE WHEN lag(l) OVER (ORDER BY month) IS NOT NULL THEN l / lag(l) OVER (ORDER BY month) - 1 WHEN n > 1 THEN l / f - 1 END AS rb FROM bm),
wr AS (SELECT strategy, avg(CAST(r > 0 AS INTEGER)) AS positive_months, avg(CAST(r > rb AS INTEGER)) AS months_ahead, count(*) AS n_months FROM mr LEFT JOIN br USING (month) WHERE r IS NOT NULL GROUP BY 1),
z AS (SELECT strategy, sr * sqrt(n_obs - 1) / sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) AS z FROM b_perf)
SELECT strategy, n_sessions, round(ln(gr), 6) AS log_growth, round(ln(power(gr, 252e0 / n_sessions)), 6) AS log_cagr, round((SELECT min(dd.dd) FROM dd WHERE dd.strategy = g.strategy), 7) AS max_drawdown,
  round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(positive_months, 8) AS positive_months, round(months_ahead, 8) AS months_ahead, n_months, round({PHI}, 6) AS psr
FROM g JOIN b_perf USING (strategy) JOIN wr USING (strategy) JOIN z USING (strategy)"""))
def strategy_summary(spark, d):
    bars, cal, _, _, r = all_returns(spark, d)
    eq = PF.equity(r)
    bench = D.benchmark(bars).select("time", F.col("close").alias("equity"))
    df = PF.with_psr(PF.moments(r, ["strategy"])).join(
        PF.drawdown_and_growth(eq, ["strategy"]), "strategy").join(
        PF.win_rates(eq, bench, ["strategy"]), "strategy")
    return rounded(df.select(
        "strategy", "n_sessions", F.log1p("total_return").alias("log_growth"), F.log1p("cagr").alias("log_cagr"),
        "max_drawdown", "sharpe", "sortino", "positive_months", "months_ahead", "n_months", "psr"),
        {"log_growth": 6, "log_cagr": 6, "max_drawdown": 7, "sharpe": 6, "sortino": 6, "positive_months": 8,
         "months_ahead": 8, "psr": 6})


@query("turnover", "MTH-3 BT-7", with_("b_ret", """
SELECT strategy, round(sum(traded) / 2 / (count(*) / 252e0), 7) AS turnover FROM b_ret GROUP BY 1"""))
def turnover(spark, d):
    return rounded(PF.turnover_per_year(all_returns(spark, d)[4], ["strategy"]), {"turnover": 7})


@query("trade_statistics", "MTH-3", with_("all_t bars", """
WITH e AS (SELECT symbol, time, lead(open, 1) OVER w AS o1, lead(open, 22) OVER w AS o2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
t AS (SELECT strategy, o2 / o1 - 1 AS r FROM all_t JOIN e ON e.symbol = all_t.symbol AND e.time = as_of WHERE o2 IS NOT NULL)
SELECT strategy, count(*) AS n_trades, round(sum(CASE WHEN r > 0 THEN r END) / abs(sum(CASE WHEN r < 0 THEN r END)), 6) AS profit_factor, round(avg(CAST(r > 0 AS INTEGER)), 8) AS hit_rate, round(avg(r), 6) AS mean_return FROM t GROUP BY 1"""))
def trade_statistics(spark, d):
    bars, sig = base(spark, d)
    fwd = EV.own_session_forward_returns(bars, [21]).select(
        "symbol", F.col("time").alias("as_of"), F.col("fwd_21").alias("r"))
    trades = all_targets(sig).join(fwd, ["symbol", "as_of"]).where(F.col("r").isNotNull())
    return rounded(PF.trade_statistics(trades, ["strategy"]), {"profit_factor": 6, "hit_rate": 8, "mean_return": 6})


define("grid_ret", "SELECT * FROM b_ret WHERE strategy LIKE 'top%'", ("b_ret",))
define("wf_w", """
WITH s AS (SELECT min(time) AS lo, max(time) AS hi FROM calendar), w AS (SELECT hi, CAST(unnest(generate_series(lo, hi, INTERVAL 6 MONTH)) AS DATE) AS train_start FROM s),
x AS (SELECT hi, train_start, CAST(train_start + INTERVAL 24 MONTH AS DATE) AS test_start FROM w)
SELECT train_start, test_start, least(CAST(test_start + INTERVAL 6 MONTH AS DATE), hi) AS test_end FROM x WHERE test_start < hi AND least(CAST(test_start + INTERVAL 6 MONTH AS DATE), hi) - test_start >= 20""", ("calendar",))
define("wf_tr", "SELECT w.*, strategy, r FROM wf_w w JOIN grid_ret g ON g.time >= train_start AND g.time < test_start", ("wf_w", "grid_ret"))
define("wf_trials", _moments_sql("wf_tr", "train_start, test_start, test_end, strategy"), ("wf_tr",))
define("wf_chosen", """SELECT train_start, test_start, test_end, strategy, sharpe AS train_sharpe FROM wf_trials
QUALIFY row_number() OVER (PARTITION BY train_start ORDER BY sharpe DESC, list_position(['top10_M', 'top10_Q', 'top20_M', 'top20_Q'], strategy)) = 1""", ("wf_trials",))
define("wf_test", "SELECT c.train_start, strategy, time, r FROM wf_chosen c JOIN grid_ret g USING (strategy) WHERE g.time >= test_start AND g.time < test_end", ("wf_chosen", "grid_ret"))


def walk(spark, d, past=None):
    """Bars, calendar, scores, targets, returns, then trials, choices and test returns."""
    bars, cal, sig, t, r = all_returns(spark, d, past)
    grid = r.where(F.col("strategy").startswith("top"))
    return (bars, cal, sig, t, r, *PF.walk_forward(grid, PF.train_test_windows(cal)))


@query("walk_forward_choice", "BT-5", with_("wf_chosen", "SELECT train_start, test_start, test_end, strategy, round(train_sharpe, 6) AS train_sharpe FROM wf_chosen"))
def walk_forward_choice(spark, d):
    return rounded(walk(spark, d)[6].select("train_start", "test_start", "test_end", "strategy", "train_sharpe"),
                   {"train_sharpe": 6})


@query("walk_forward_returns", "BT-5", with_("wf_test", "SELECT train_start, strategy, time, round(r, 8) AS r FROM wf_test"))
def walk_forward_returns(spark, d):
    return rounded(walk(spark, d)[7], {"r": 8})


def _star(n: int) -> float:
    import math
    from statistics import NormalDist

    inv, g = NormalDist().inv_cdf, S.EULER_GAMMA
    return (1 - g) * inv(1 - 1 / n) + g * inv(1 - 1 / (n * math.e))


define("wf_report", f"""
WITH v AS (SELECT avg(v) AS sr_variance FROM (SELECT train_start, var_samp(sharpe / sqrt(252e0)) AS v FROM wf_trials GROUP BY 1)),
m AS ({_moments_sql("(SELECT 1 AS one, r FROM wf_test)", "one")})
SELECT *, sqrt(sr_variance) * {_star(4)!r} AS sr_star, sqrt(n_obs - 1) / sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) AS f FROM m, v""", ("wf_trials", "wf_test"))


@query("deflated_sharpe", "MTH-2 BT-5", with_("wf_report", f"""
SELECT n_obs, round(sr, 8) AS sr, round(sr_variance, 9) AS sr_variance, round((SELECT {PHI} FROM (SELECT sr * f AS z)), 6) AS psr, round((SELECT {PHI} FROM (SELECT (sr - sr_star) * f AS z)), 6) AS dsr FROM wf_report"""))
def deflated_sharpe(spark, d):
    out = walk(spark, d)
    df = PF.sharpe_report(out[5], out[7]).select("n_obs", "sr", "sr_variance", "psr", "dsr")
    return rounded(df, {"sr": 8, "sr_variance": 9, "psr": 6, "dsr": 6})


# scenarios run the configurations that were chosen, over the out-of-sample span
define("oos", "SELECT min(time) AS lo, max(time) AS hi FROM wf_test", ("wf_test",))
returns_stage("d2", "grid_t", delay=2)
returns_stage("f2", "grid_t", fee=0.005)
define("winners", """
WITH t AS (SELECT symbol, max_by(close, time) / min_by(close, time) - 1 AS total FROM bars, oos WHERE time BETWEEN lo AND hi AND symbol IN (SELECT symbol FROM sig) GROUP BY 1 HAVING count(*) > 1)
SELECT symbol, total FROM t QUALIFY row_number() OVER (ORDER BY total DESC, symbol) <= ceil(0.1 * count(*) OVER ())""", ("bars", "oos", "sig"))
for _n, _f in S.GRID:
    define(f"drop_{_n}_{_f}", _top_sql(_n, _f, " AND symbol NOT IN (SELECT symbol FROM winners)"), ("sig", "winners"))
define("drop_t", " UNION ALL ".join(
    f"SELECT 'top{n}_{f}' AS strategy, '{f}' AS freq, as_of, symbol, 1e0 / {n} AS weight FROM drop_{n}_{f}" for n, f in S.GRID),
    tuple(f"drop_{n}_{f}" for n, f in S.GRID))
returns_stage("dw", "drop_t")
define("scen", """
SELECT scenario, time, r FROM wf_chosen c JOIN (SELECT 'base' AS scenario, * FROM b_ret UNION ALL SELECT 'late', * FROM d2_ret UNION ALL SELECT 'double_fee', * FROM f2_ret UNION ALL SELECT 'no_winners', * FROM dw_ret) x
ON x.strategy = c.strategy AND x.time >= test_start AND x.time < test_end""", ("wf_chosen", "b_ret", "d2_ret", "f2_ret", "dw_ret"))
define("scen_eq", "SELECT *, exp(sum(ln(1 + greatest(r, -0.999999e0))) OVER (PARTITION BY scenario ORDER BY time ROWS UNBOUNDED PRECEDING)) AS equity FROM scen", ("scen",))


def _oos(test):
    """First and last session of the test returns, as scalars."""
    return test.agg(F.min("time")).scalar(), test.agg(F.max("time")).scalar()


def winners_of(bars, sig, test):
    lo, hi = _oos(test)
    scored = bars.join(sig.select("symbol").distinct(), "symbol", "left_semi")
    return PF.top_winners(scored, lo, F.date_add(hi, 1))


@query("top_winners", "AGG-18", with_("winners", "SELECT symbol, round(total, 6) AS total FROM winners"))
def top_winners(spark, d):
    bars, _, sig, *_, test = walk(spark, d)
    return rounded(winners_of(bars, sig, materialise(test)), {"total": 6})


def scenario_returns(spark, d, past=None):
    """The walk, and (scenario, train_start, strategy, time, r) of its choices in one plan."""
    out = walk(spark, d, past)
    bars, cal, sig, t, _, trials, chosen, test = out
    trials, chosen, test = materialise(trials), materialise(chosen), materialise(test)
    without = PF.grid_targets(sig, exclude=settle(winners_of(bars, sig, test)))
    runs = PF.in_scenarios(t.where(F.col("strategy").startswith("top")), SCENARIOS).unionByName(
        PF.in_scenarios(without, DROPPED))
    r = PF.daily_returns(runs, bars, cal, sig.select("as_of").distinct())
    return (*out[:5], trials, chosen, test, PF.fixed_choice(r, chosen, ["scenario"]))


@query("sensitivity", "BT-8", with_("scen scen_eq", f"""
WITH m AS ({_moments_sql("scen", "scenario")}), z AS (SELECT *, sr * sqrt(n_obs - 1) / sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) AS z FROM m),
dd AS (SELECT scenario, min(dd) AS max_drawdown FROM (SELECT scenario, equity / max(equity) OVER (PARTITION BY scenario ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM scen_eq) GROUP BY 1),
g AS (SELECT scenario, count(*) AS n, max_by(equity, time) / min_by(equity, time) AS gr FROM scen_eq GROUP BY 1)
SELECT scenario, n AS n_sessions, round(ln(gr), 6) AS log_growth, round(max_drawdown, 7) AS max_drawdown, round(sharpe, 6) AS sharpe, round({PHI}, 6) AS psr FROM z JOIN dd USING (scenario) JOIN g USING (scenario)"""))
def sensitivity(spark, d):
    r = materialise(scenario_returns(spark, d)[8])
    df = PF.with_psr(PF.moments(r, ["scenario"])).join(
        PF.drawdown_and_growth(PF.equity(r, ("scenario",)), ["scenario"]), "scenario")
    return rounded(df.select("scenario", "n_sessions", F.log1p("total_return").alias("log_growth"),
                             "max_drawdown", "sharpe", "psr"),
                   {"log_growth": 6, "max_drawdown": 7, "sharpe": 6, "psr": 6})


def out_of_sample(r, bars, test):
    """(name, time, r) of the chosen line, the index and the two benchmark portfolios."""
    lo, hi = _oos(test)
    inside = (F.col("time") >= lo) & (F.col("time") <= hi)
    index = D.benchmark(bars).where(inside).select("time", "close")
    # each session against the one before, both inside the span
    day = index.withColumn("r", F.col("close") / F.lag("close").over(Window.orderBy("time")) - 1)
    lines = day.where("r IS NOT NULL").select(F.lit("index").alias("name"), "time", "r")
    kept = r.where(F.col("strategy").isin("equal", "cap20") & inside).select(
        F.col("strategy").alias("name"), "time", "r")
    return test.select(F.lit("chosen").alias("name"), "time", "r").unionByName(lines).unionByName(kept)


define("oos_lines", """
SELECT 'chosen' AS name, time, r FROM wf_test
UNION ALL SELECT strategy, time, r FROM b_ret, oos WHERE strategy IN ('equal', 'cap20') AND time BETWEEN lo AND hi
UNION ALL SELECT 'index', time, r FROM (SELECT time, close / lag(close) OVER (ORDER BY time) - 1 AS r FROM benchmark_index, oos WHERE time BETWEEN lo AND hi) WHERE r IS NOT NULL""",
       ("wf_test", "b_ret", "oos", "benchmark_index"))
define("oos_eq", "SELECT *, exp(sum(ln(1 + greatest(r, -0.999999e0))) OVER (PARTITION BY name ORDER BY time ROWS UNBOUNDED PRECEDING)) AS equity FROM oos_lines", ("oos_lines",))


@query("benchmark_summary", "BT-6", with_("oos_lines oos_eq", f"""
WITH m AS ({_moments_sql("oos_lines", "name")}),
dd AS (SELECT name, min(dd) AS max_drawdown FROM (SELECT name, equity / max(equity) OVER (PARTITION BY name ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM oos_eq) GROUP BY 1),
g AS (SELECT name, count(*) AS n, max_by(equity, time) / min_by(equity, time) AS gr FROM oos_eq GROUP BY 1)
SELECT name, n AS n_sessions, round(ln(gr), 6) AS log_growth, round(max_drawdown, 7) AS max_drawdown, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino FROM m JOIN dd USING (name) JOIN g USING (name)"""))
def benchmark_summary(spark, d):
    bars, _, _, _, r, _, _, test = walk(spark, d)
    lines = materialise(out_of_sample(r, bars, materialise(test)))
    df = PF.moments(lines, ["name"]).join(
        PF.drawdown_and_growth(PF.equity(lines, ("name",)), ["name"]), "name")
    return rounded(df.select("name", "n_sessions", F.log1p("total_return").alias("log_growth"),
                             "max_drawdown", "sharpe", "sortino"),
                   {"log_growth": 6, "max_drawdown": 7, "sharpe": 6, "sortino": 6})


@query("order_sizes", "BT-4", with_("grid_t sig panel bars", """
WITH t AS (SELECT as_of, symbol, weight FROM grid_t WHERE strategy = 'top10_M'), d AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS nxt FROM (SELECT DISTINCT as_of FROM sig)),
h AS (SELECT d.nxt AS as_of, t.symbol, 100 * (t.symbol % 90 + 1) AS held FROM t JOIN d USING (as_of) WHERE nxt IS NOT NULL),
p AS (SELECT s.as_of, s.symbol, b.close AS ref, s.avg_value_20d AS adv FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.time = s.as_of_price),
j AS (SELECT as_of, symbol, coalesce(weight, 0) AS w, coalesce(held, 0) AS held, ref, 0.1e0 * adv AS cap, coalesce(weight, 0) * 1e10 - coalesce(held, 0) * ref AS diff FROM t FULL JOIN h USING (as_of, symbol) JOIN p USING (as_of, symbol))
SELECT as_of, symbol, quantity FROM (SELECT as_of, symbol, CAST(CASE WHEN w = 0 AND held > 0 THEN -held WHEN diff > 0 THEN floor(least(diff, cap) / ref / 100) * 100 WHEN diff < 0 THEN -least(held, ceil(least(-diff, cap) / ref / 100) * 100) ELSE 0 END AS BIGINT) AS quantity FROM j) WHERE quantity <> 0"""))
def order_sizes(spark, d):
    bars, sig = base(spark, d)
    t = PF.strategy_targets(sig, 10, "M")
    dates = sig.select("as_of").distinct()
    nxt = dates.withColumn("nxt", F.lead("as_of").over(Window.orderBy("as_of")))
    held = t.join(nxt, "as_of").where(F.col("nxt").isNotNull()).select(
        F.col("nxt").alias("as_of"), "symbol", (100 * (F.col("symbol") % 90 + 1)).alias("shares_held"))
    prices = sig.join(bars.select("symbol", F.col("time").alias("as_of_price"), "close"), ["symbol", "as_of_price"])
    prices = prices.select("as_of", "symbol", F.col("close").alias("ref"), F.col("avg_value_20d").alias("adv20"))
    return PF.order_sizes(t, held, prices, 1e10)


@query("market_forward_returns", "JN-9", with_("sig calendar bars", """
SELECT s.as_of, s.symbol, round(b1.open / b0.open - 1, 7) AS fwd_1m, round(b3.open / b0.open - 1, 7) AS fwd_3m, round(b6.open / b0.open - 1, 7) AS fwd_6m
FROM sig s JOIN calendar c ON c.time = s.as_of LEFT JOIN (SELECT symbol, idx, open FROM bars JOIN calendar USING (time)) b0 ON b0.symbol = s.symbol AND b0.idx = c.idx + 1
LEFT JOIN (SELECT symbol, idx, open FROM bars JOIN calendar USING (time)) b1 ON b1.symbol = s.symbol AND b1.idx = c.idx + 22
LEFT JOIN (SELECT symbol, idx, open FROM bars JOIN calendar USING (time)) b3 ON b3.symbol = s.symbol AND b3.idx = c.idx + 64
LEFT JOIN (SELECT symbol, idx, open FROM bars JOIN calendar USING (time)) b6 ON b6.symbol = s.symbol AND b6.idx = c.idx + 127"""))
def market_forward_returns(spark, d):
    bars, sig = base(spark, d)
    df = EV.market_forward_returns(sig.select("as_of", "symbol"), bars, D.calendar(bars))
    return rounded(df.select("as_of", "symbol", "fwd_1m", "fwd_3m", "fwd_6m"), {"fwd_1m": 7, "fwd_3m": 7, "fwd_6m": 7})


FACTORS = ["score", "score_valuation", "score_quality", "score_sector", "score_growth", "score_technical"]
define("ic_panel", """
WITH o AS (SELECT symbol, idx, open FROM bars JOIN calendar USING (time)),
f AS (SELECT s.as_of, s.symbol, b1.open / b0.open - 1 AS f1, b3.open / b0.open - 1 AS f3, b6.open / b0.open - 1 AS f6 FROM hist_s s JOIN calendar c ON c.time = s.as_of
  JOIN o b0 ON b0.symbol = s.symbol AND b0.idx = c.idx + 1 LEFT JOIN o b1 ON b1.symbol = s.symbol AND b1.idx = c.idx + 22
  LEFT JOIN o b3 ON b3.symbol = s.symbol AND b3.idx = c.idx + 64 LEFT JOIN o b6 ON b6.symbol = s.symbol AND b6.idx = c.idx + 127),
a AS (SELECT s.as_of, s.symbol, f1, f3, f6, unnest(['score', 'score_valuation', 'score_quality', 'score_sector', 'score_growth', 'score_technical']) AS factor,
   unnest([score, score_valuation, score_quality, score_sector, score_growth, score_technical]) AS x FROM hist_s s JOIN f USING (as_of, symbol))
SELECT as_of, symbol, factor, round(x, 6) AS x, unnest([1, 3, 6]) AS horizon, unnest([f1, f3, f6]) AS y FROM a""", ("hist_s", "bars", "calendar"))
define("own_panel", """
WITH f AS (SELECT symbol, time, lead(open, 22) OVER w / lead(open, 1) OVER w - 1 AS f1, lead(open, 64) OVER w / lead(open, 1) OVER w - 1 AS f3, lead(open, 127) OVER w / lead(open, 1) OVER w - 1 AS f6
   FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
a AS (SELECT as_of, s.symbol, f1, f3, f6, unnest(['score', 'score_valuation', 'score_quality', 'score_sector', 'score_growth', 'score_technical']) AS factor,
   unnest([score, score_valuation, score_quality, score_sector, score_growth, score_technical]) AS x FROM hist_s s JOIN f ON f.symbol = s.symbol AND f.time = s.as_of_price)
SELECT as_of, symbol, factor, round(x, 6) AS x, unnest([1, 3, 6]) AS horizon, unnest([f1, f3, f6]) AS y FROM a""", ("hist_s", "bars"))
for _ic_name, _panel in (("ic", "ic_panel"), ("own_ic", "own_panel")):
    define(_ic_name, f"""
WITH v AS (SELECT * FROM {_panel} WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY factor, horizon, as_of ORDER BY x) + (count(*) OVER (PARTITION BY factor, horizon, as_of, x) - 1) / 2e0 AS rx,
   rank() OVER (PARTITION BY factor, horizon, as_of ORDER BY y) + (count(*) OVER (PARTITION BY factor, horizon, as_of, y) - 1) / 2e0 AS ry FROM v)
SELECT factor, horizon, as_of, count(*) AS n, corr(rx, ry) AS ic FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0""", (_panel,))


def _ic(spark, d, own=False, past=None, factors=FACTORS, horizons=None):
    """Rank ICs of forward returns on the market calendar, or on each symbol's own sessions."""
    bars, sums, u = past_universe(spark, d) if past is None else past
    s = settle(hist_scores(spark, d, bars, u, sums).select(
        "as_of", "symbol", "as_of_price", *[F.round(c, 6).alias(c) for c in factors]))
    if own:
        own_bars = spread(bars.select("symbol", "time", "open"), "symbol")
        fwd = EV.own_session_forward_returns(own_bars, [21, 63, 126]).select(
            "symbol", "time", F.col("fwd_21").alias("fwd_1m"),
            F.col("fwd_63").alias("fwd_3m"), F.col("fwd_126").alias("fwd_6m"))
        # as_of_price is a day of the symbol's bars; both sides share one partitioning
        panel = P.attach_as_of(spread(s, "symbol"), fwd, ["symbol"], "as_of_price", "time", ["fwd_1m", "fwd_3m", "fwd_6m"])
    else:
        calendar = materialise(D.calendar(bars))
        panel = s.join(EV.market_forward_returns(s.select("as_of", "symbol"), bars, calendar),
                       ["as_of", "symbol"])
    return EV.rank_ic(EV.long_panel(settle(panel), factors, horizons))


@query("rank_ic", "BT-2", with_("ic", "SELECT factor, horizon, as_of, n, round(ic, 7) AS ic FROM ic"))
def rank_ic(spark, d):
    return rounded(_ic(spark, d), {"ic": 7})


@query("rank_ic_own_sessions", "BT-2", with_("own_ic", "SELECT factor, horizon, as_of, n, round(ic, 7) AS ic FROM own_ic"))
def rank_ic_own_sessions(spark, d):
    return rounded(_ic(spark, d, own=True), {"ic": 7})


@query("ic_summary", "BT-3", with_("own_ic", """
WITH c AS (SELECT *, ic - avg(ic) OVER (PARTITION BY factor, horizon) AS c, CASE horizon WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE 5 END AS lags FROM own_ic),
t AS (SELECT *, c * c + 2 * (SELECT coalesce(sum(0), 0)) + coalesce(CASE WHEN lags >= 1 THEN 2 * (1 - 1 / (lags + 1e0)) * c * lag(c, 1) OVER w END, 0) + coalesce(CASE WHEN lags >= 2 THEN 2 * (1 - 2 / (lags + 1e0)) * c * lag(c, 2) OVER w END, 0)
  + coalesce(CASE WHEN lags >= 3 THEN 2 * (1 - 3 / (lags + 1e0)) * c * lag(c, 3) OVER w END, 0) + coalesce(CASE WHEN lags >= 4 THEN 2 * (1 - 4 / (lags + 1e0)) * c * lag(c, 4) OVER w END, 0)
  + coalesce(CASE WHEN lags >= 5 THEN 2 * (1 - 5 / (lags + 1e0)) * c * lag(c, 5) OVER w END, 0) AS term FROM c WINDOW w AS (PARTITION BY factor, horizon ORDER BY as_of))
SELECT factor, horizon, round(avg(ic), 7) AS ic_mean, round(stddev_samp(ic), 7) AS ic_sd, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 6) AS t_stat,
  round(CASE WHEN count(*) >= 2 AND sum(term) > 0 THEN avg(ic) / sqrt(sum(term) / count(*) / count(*)) END, 6) AS t_newey_west, round(avg(CAST(ic > 0 AS INTEGER)), 8) AS share_positive, count(*) AS n_months
FROM t GROUP BY 1, 2"""))
def ic_summary(spark, d):
    return rounded(EV.summarise_ic(_ic(spark, d, own=True)), {
        "ic_mean": 7, "ic_sd": 7, "icir": 6, "t_stat": 6, "t_newey_west": 6, "share_positive": 8})


define("verdict_parts", f"""
SELECT (SELECT {PHI} FROM (SELECT (sr - sr_star) * f AS z FROM wf_report)) AS dsr,
 (SELECT avg(ic) FROM ic WHERE factor = 'score' AND horizon = 3) AS ic_mean,
 (WITH c AS (SELECT as_of, ic - avg(ic) OVER () AS c FROM ic WHERE factor = 'score' AND horizon = 3),
   t AS (SELECT c * c + coalesce(2 * (2 / 3e0) * c * lag(c, 1) OVER (ORDER BY as_of), 0) + coalesce(2 * (1 / 3e0) * c * lag(c, 2) OVER (ORDER BY as_of), 0) AS term FROM c)
  SELECT CASE WHEN count(*) >= 2 AND sum(term) > 0 THEN (SELECT avg(ic) FROM ic WHERE factor = 'score' AND horizon = 3) / sqrt(sum(term) / count(*) / count(*)) END FROM t) AS t_nw""",
       ("wf_report", "ic"))


@query("verdict", "BT-8", with_("verdict_parts oos_lines oos_eq scen_eq", f"""
WITH m AS ({_moments_sql("oos_lines", "name")}), g AS (SELECT name, power(max_by(equity, time) / min_by(equity, time), 252e0 / count(*)) - 1 AS cagr FROM oos_eq GROUP BY 1),
f AS (SELECT power(max_by(equity, time) / min_by(equity, time), 252e0 / count(*)) - 1 AS cagr FROM scen_eq WHERE scenario = 'double_fee'),
t AS (SELECT coalesce(dsr >= 0.95, false) AS significant, coalesce(ic_mean > 0 AND t_nw >= 2, false) AS predictive,
  (SELECT sharpe FROM m WHERE name = 'chosen') > (SELECT max(sharpe) FROM m WHERE name <> 'chosen') AS sharpe_ahead,
  (SELECT cagr FROM f) > (SELECT cagr FROM g WHERE name = 'index') AS fees_survived FROM verdict_parts)
SELECT *, CAST(significant AS INTEGER) + CAST(predictive AS INTEGER) + CAST(sharpe_ahead AS INTEGER) + CAST(fees_survived AS INTEGER) AS criteria_met,
  significant AND predictive AND sharpe_ahead AND fees_survived AS edge FROM t"""))
def verdict(spark, d):
    past = past_universe(spark, d)  # the portfolios and the coefficients read one universe
    bars, _, _, _, r, trials, _, test, scenarios = scenario_returns(spark, d, past)
    fee2 = scenarios.where("scenario = 'double_fee'").select("scenario", "time", "r")
    lines = settle(out_of_sample(r, bars, test).unionByName(
        fee2.select(F.col("scenario").alias("name"), "time", "r")))
    table = materialise(PF.moments(lines, ["name"]).join(
        PF.drawdown_and_growth(PF.equity(lines, ("name",)), ["name"]), "name"))
    ic = EV.summarise_ic(_ic(spark, d, past=past, factors=["score"], horizons=[3])).where(
        "factor = 'score' AND horizon = 3")
    strategy = PF.sharpe_report(trials, test).select("dsr").join(
        table.where("name = 'chosen'").select("sharpe"))
    return PF.verdict(strategy, table.where("name NOT IN ('chosen', 'double_fee')"), ic,
                      table.where("name = 'double_fee'"))
