"""Technical indicators, states, scores and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.catalog.registry import query
from fjordquant.functions.numeric import rounded
from fjordquant.operators import indicators as I
from fjordquant.operators import technical as T
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_

TECH_SCORES = """
WITH a AS (SELECT *,
  CASE WHEN above_zero IS NULL THEN 0e0 ELSE least(greatest(CASE WHEN above_zero THEN 35e0 ELSE -35e0 END
    + coalesce(CASE WHEN macd_cross = 'golden' THEN CASE WHEN above_zero THEN 45e0 ELSE 30e0 END WHEN macd_cross = 'death' THEN CASE WHEN above_zero THEN -30e0 ELSE -45e0 END END
        * greatest(0e0, 1 - macd_bars / 20e0), 0) + coalesce(least(greatest(hist_slope * 200, -15), 15), 0), -100), 100) END AS score_macd,
  CASE WHEN rsi IS NULL THEN 0e0 ELSE least(greatest((rsi - 50) / 50 * 100 * CASE WHEN rsi_zone = 'trung_tinh' THEN 1e0 ELSE 0.85e0 END
    + coalesce(least(greatest(rsi_slope * 10, -15), 15), 0), -100), 100) END AS score_rsi,
  (CASE zone WHEN 'tren_may' THEN 40e0 WHEN 'duoi_may' THEN -40e0 ELSE 0e0 END
    + coalesce(CASE WHEN tk_cross = 'golden' THEN 1e0 WHEN tk_cross = 'death' THEN -1e0 END * CASE tk_strength WHEN 'manh' THEN 45e0 WHEN 'trung_tinh' THEN 25e0 ELSE 10e0 END
        * greatest(0e0, 1 - tk_bars / 20e0), 0)
    + CASE WHEN chikou_free THEN 10e0 WHEN NOT chikou_free THEN -10e0 ELSE 0e0 END) * CASE WHEN twist THEN 0.85e0 ELSE 1e0 END AS ic
  FROM state2),
b AS (SELECT *, CASE WHEN zone IS NULL THEN 0e0 ELSE least(greatest(ic + CASE WHEN ic >= 0 THEN 1 ELSE -1 END * coalesce(least(greatest(thickness, 0), 1) * 10, 0), -100), 100) END AS score_ichimoku FROM a)
SELECT *, least(greatest(0.30e0 * score_macd + 0.25e0 * score_rsi + 0.45e0 * score_ichimoku
          - CASE WHEN divergence = 'bearish' THEN 25e0 ELSE 0e0 END, -100), 100) AS total_score FROM b"""

# the check engine computes the smoothed columns by stepping bar by bar
define("smoothed", """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT symbol, time, i, open, high, low, close, volume, prev,
         greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr,
         CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS gain,
         CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS loss
  FROM numbered),
e AS (
  SELECT symbol, i, close AS e12, close AS e26, tr AS a, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l,
         CAST(NULL AS DOUBLE) AS s FROM t WHERE i = 0
  UNION ALL
  SELECT t.symbol, t.i, e.e12 + (t.close - e.e12) * 2 / 13e0, e.e26 + (t.close - e.e26) * 2 / 27e0,
         e.a + (t.tr - e.a) / 14e0,
         CASE WHEN t.i = 1 THEN t.gain ELSE e.g + (t.gain - e.g) / 14e0 END,
         CASE WHEN t.i = 1 THEN t.loss ELSE e.l + (t.loss - e.l) / 14e0 END,
         CASE WHEN t.i = 25 THEN (e.e12 + (t.close - e.e12) * 2 / 13e0) - (e.e26 + (t.close - e.e26) * 2 / 27e0)
              WHEN t.i > 25 THEN 0.8e0 * e.s + 0.2e0 * ((e.e12 + (t.close - e.e12) * 2 / 13e0) - (e.e26 + (t.close - e.e26) * 2 / 27e0)) END
  FROM e JOIN t ON t.symbol = e.symbol AND t.i = e.i + 1)
SELECT t.*, CASE WHEN i >= 11 THEN e12 END AS ema12, CASE WHEN i >= 25 THEN e26 END AS ema26,
       CASE WHEN i >= 13 THEN a END AS atr, CASE WHEN i >= 14 THEN g END AS avg_gain, CASE WHEN i >= 14 THEN l END AS avg_loss,
       CASE WHEN i >= 25 THEN e12 - e26 END AS macd, s AS signal, CASE WHEN i >= 25 THEN e12 - e26 - s END AS hist,
       CASE WHEN i >= 14 THEN coalesce(100 - 100 / (1 + g / nullif(l, 0)), 100e0) END AS rsi
FROM t JOIN e USING (symbol, i)""", ("numbered",))

define("oscillators", "SELECT * FROM smoothed", ("smoothed",))

OSC = {"ema12": 3, "ema26": 3, "atr": 3, "macd": 3, "signal": 3, "hist": 3, "rsi": 5}


@query("oscillators", "WIN-2 WIN-3 WIN-6 WIN-8 UDF-2", with_("oscillators", """
SELECT symbol, time, round(ema12, 3) AS ema12, round(ema26, 3) AS ema26, round(atr, 3) AS atr, round(macd, 3) AS macd,
       round(signal, 3) AS signal, round(hist, 3) AS hist, round(rsi, 5) AS rsi FROM oscillators"""))
def oscillators(spark, d):
    return rounded(I.oscillators(D.bars(spark, d)).select("symbol", "time", *OSC), OSC)


define("bands", """
SELECT *, CASE WHEN count(rsi) OVER w >= 60 THEN least(greatest(quantile_cont(rsi, 0.9) OVER w, 65e0), 85e0) END AS upper,
       CASE WHEN count(rsi) OVER w >= 60 THEN least(greatest(quantile_cont(rsi, 0.1) OVER w, 15e0), 35e0) END AS lower
FROM oscillators WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""", ("oscillators",))


@query("adaptive_bands", "WIN-7", with_("bands",
       "SELECT symbol, time, round(rsi, 5) AS rsi, round(upper, 5) AS upper, round(lower, 5) AS lower FROM bands"))
def adaptive_bands(spark, d):
    df = I.adaptive_bands(I.oscillators(D.bars(spark, d)))
    return rounded(df.select("symbol", "time", "rsi", "upper", "lower"),
                   {"rsi": 5, "upper": 5, "lower": 5})


define("cloud", """
WITH a AS (SELECT *,
  CASE WHEN i >= 8 THEN (max(high) OVER w9 + min(low) OVER w9) / 2 END AS tenkan,
  CASE WHEN i >= 25 THEN (max(high) OVER w26 + min(low) OVER w26) / 2 END AS kijun,
  CASE WHEN i >= 51 THEN (max(high) OVER w52 + min(low) OVER w52) / 2 END AS base_b,
  lead(close, 26) OVER w AS chikou
FROM bands WINDOW w AS (PARTITION BY symbol ORDER BY i),
  w9 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW),
  w26 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 25 PRECEDING AND CURRENT ROW),
  w52 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
SELECT *, (tenkan + kijun) / 2 AS base_a, (lag(tenkan, 26) OVER w + lag(kijun, 26) OVER w) / 2 AS senkou_a,
       lag(base_b, 26) OVER w AS senkou_b FROM a WINDOW w AS (PARTITION BY symbol ORDER BY i)""", ("bands",))

LINES = ["tenkan", "kijun", "senkou_a", "senkou_b", "base_a", "base_b", "chikou"]


@query("ichimoku_lines", "WIN-9", with_("cloud", "SELECT symbol, time, "
       + ", ".join(f"{c}" for c in LINES) + " FROM cloud"))
def ichimoku_lines(spark, d):
    df = I.ichimoku(I.with_position(D.bars(spark, d)))
    return df.select("symbol", "time", *LINES)


@query("ichimoku_five_day_week", "WIN-9", with_("numbered", """
SELECT symbol, time, CASE WHEN i >= 6 THEN (max(high) OVER w7 + min(low) OVER w7) / 2 END AS tenkan,
       CASE WHEN i >= 21 THEN (max(high) OVER w22 + min(low) OVER w22) / 2 END AS kijun
FROM numbered WINDOW w7 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w22 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)"""))
def ichimoku_five_day_week(spark, d):
    df = I.ichimoku(I.with_position(D.bars(spark, d)), "five_day_week")
    return df.select("symbol", "time", "tenkan", "kijun")


define("swings", """
SELECT *, CASE WHEN cc = 11 AND close >= mx AND close > px THEN 'H' WHEN cc = 11 AND close <= mn AND close < pn THEN 'L' END AS price_swing,
       CASE WHEN hc = 11 AND hist >= hmx AND hist > hpx THEN 'H' WHEN hc = 11 AND hist <= hmn AND hist < hpn THEN 'L' END AS hist_swing
FROM (SELECT *, count(close) OVER a AS cc, max(close) OVER a AS mx, min(close) OVER a AS mn, max(close) OVER b AS px, min(close) OVER b AS pn,
             count(hist) OVER a AS hc, max(hist) OVER a AS hmx, min(hist) OVER a AS hmn, max(hist) OVER b AS hpx, min(hist) OVER b AS hpn
      FROM cloud WINDOW a AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING),
        b AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""", ("cloud",))


@query("swing_points", "WIN-11", with_("swings",
       "SELECT symbol, time, close, price_swing FROM swings WHERE price_swing IS NOT NULL"))
def swing_points(spark, d):
    df = I.with_position(D.bars(spark, d)).withColumn("price_swing", I.swing("close"))
    return df.where(F.col("price_swing").isNotNull()).select(
        "symbol", "time", "close", "price_swing")


define("last_tb", "SELECT symbol, max(i) AS li FROM numbered GROUP BY symbol", ("numbered",))


def divergence_sql(p: str) -> None:
    """Divergence at the target bars ``<p>_tb(symbol, li)``."""
    define(f"{p}_sw", f"""
SELECT s.symbol, t.li, s.i, s.close, s.hist, s.price_swing, s.hist_swing FROM swings s JOIN {p}_tb t ON s.symbol = t.symbol AND s.i BETWEEN t.li - 54 AND t.li - 5
WHERE s.price_swing IS NOT NULL OR s.hist_swing IS NOT NULL""", ("swings", f"{p}_tb"))
    define(f"{p}_div", f"""
WITH p AS (SELECT symbol, li, price_swing AS side, i, close AS v, row_number() OVER (PARTITION BY symbol, li, price_swing ORDER BY i DESC) AS rn
           FROM {p}_sw WHERE price_swing IS NOT NULL),
o AS (SELECT p.symbol, p.li, p.side, p.rn, any_value(p.v) AS v, arg_min(h.hist, abs(h.i - p.i) * 1000 + h.i - p.li + 100) AS ov
      FROM p LEFT JOIN {p}_sw h ON h.symbol = p.symbol AND h.li = p.li AND h.hist_swing = p.side AND abs(h.i - p.i) <= 10 WHERE rn <= 2 GROUP BY 1, 2, 3, 4),
q AS (SELECT symbol, li, max(CASE WHEN side = 'L' AND rn = 2 THEN v END) AS l1, max(CASE WHEN side = 'L' AND rn = 1 THEN v END) AS l2,
        max(CASE WHEN side = 'H' AND rn = 2 THEN v END) AS h1, max(CASE WHEN side = 'H' AND rn = 1 THEN v END) AS h2,
        max(CASE WHEN side = 'L' AND rn = 2 THEN ov END) AS a, max(CASE WHEN side = 'L' AND rn = 1 THEN ov END) AS b,
        max(CASE WHEN side = 'H' AND rn = 2 THEN ov END) AS c, max(CASE WHEN side = 'H' AND rn = 1 THEN ov END) AS d FROM o GROUP BY 1, 2)
SELECT symbol, li, CASE WHEN l2 < l1 AND b > a THEN 'bullish' WHEN h2 > h1 AND d < c THEN 'bearish' END AS divergence,
       CASE WHEN l2 < l1 AND b > a THEN abs(b - a) / CASE WHEN a = 0 THEN 1 ELSE abs(a) END
            WHEN h2 > h1 AND d < c THEN abs(d - c) / CASE WHEN c = 0 THEN 1 ELSE abs(c) END ELSE 0e0 END AS strength
FROM {p}_tb LEFT JOIN q USING (symbol, li)""", (f"{p}_sw", f"{p}_tb"))


divergence_sql("last")
define("divergence", "SELECT symbol, divergence, strength FROM last_div", ("last_div",))


@query("divergence", "WIN-12", with_("divergence", "SELECT symbol, divergence, round(strength, 6) AS strength FROM divergence"))
def divergence(spark, d):
    df = T.last_bars(T.with_divergence(T.with_swing_lists(I.oscillators(D.bars(spark, d)))))
    return rounded(df.select("symbol", "divergence", F.col("divergence_strength").alias("strength")),
                   {"strength": 6})


define("state_all", """
WITH z AS (SELECT *, CASE WHEN senkou_a IS NULL OR senkou_b IS NULL THEN NULL WHEN close > greatest(senkou_a, senkou_b) THEN 'tren_may'
                 WHEN close < least(senkou_a, senkou_b) THEN 'duoi_may' ELSE 'trong_may' END AS zone,
             sign(macd - signal) AS sm, sign(tenkan - kijun) AS st, sign(base_a - base_b) AS sb FROM cloud),
c AS (SELECT *, CASE WHEN sm <> lag(sm) OVER w THEN i END AS cm, CASE WHEN st <> lag(st) OVER w THEN i END AS ct,
             CASE WHEN sb <> lag(sb) OVER w THEN i END AS cb, CASE WHEN zone IS DISTINCT FROM lag(zone) OVER w AND zone IS NOT NULL THEN i END AS cz,
             lag(close, 26) OVER w AS c26, volume / CASE WHEN i >= 19 THEN avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS volume_ratio,
             CASE WHEN count(hist) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN regr_slope(hist, i) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS hist_slope,
             CASE WHEN count(rsi) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN regr_slope(rsi, i) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS rsi_slope
      FROM z WINDOW w AS (PARTITION BY symbol ORDER BY i)),
g AS (SELECT *, max(cm) OVER u AS lcm, max(ct) OVER u AS lct, max(cb) OVER u AS lcb, max(cz) OVER u AS lcz, count(zone) OVER u AS nz,
             last_value(CASE WHEN cm IS NOT NULL THEN sm END IGNORE NULLS) OVER u AS lsm, last_value(CASE WHEN ct IS NOT NULL THEN st END IGNORE NULLS) OVER u AS lst
      FROM c WINDOW u AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, time, i, close, atr, kijun, senkou_a, senkou_b, macd, signal, hist, rsi, volume_ratio, hist_slope, rsi_slope,
  macd > 0 AS above_zero, CASE WHEN lcm IS NULL THEN NULL WHEN lsm > 0 THEN 'golden' ELSE 'death' END AS macd_cross, i - lcm AS macd_bars,
  CASE WHEN rsi IS NOT NULL THEN coalesce(upper, 85e0) END AS upper, CASE WHEN rsi IS NOT NULL THEN coalesce(lower, 15e0) END AS lower,
  zone, CASE WHEN lct IS NULL OR zone IS NULL THEN NULL WHEN lst > 0 THEN 'golden' ELSE 'death' END AS tk_cross,
  CASE WHEN zone IS NOT NULL THEN i - lct END AS tk_bars,
  CASE WHEN zone IS NOT NULL THEN coalesce(lcb - 1 >= i - 25, false) END AS twist, CASE WHEN zone IS NOT NULL THEN close > c26 END AS chikou_free,
  CASE WHEN atr <> 0 THEN abs(senkou_a - senkou_b) / atr END AS thickness,
  CASE WHEN zone <> 'trong_may' AND nz >= 2 THEN i - lcz END AS break_bars FROM g""", ("cloud",))


def tech_stage(p: str) -> None:
    """State and scores at the target bars ``<p>_tb``."""
    if p != "last":
        divergence_sql(p)
    define(f"{p}_state2", f"""
SELECT s.*, divergence, strength, CASE WHEN rsi IS NULL THEN NULL WHEN rsi > upper THEN 'qua_mua' WHEN rsi < lower THEN 'qua_ban' ELSE 'trung_tinh' END AS rsi_zone,
       CASE WHEN tk_cross IS NULL THEN NULL WHEN zone = 'tren_may' THEN 'manh' WHEN zone = 'trong_may' THEN 'trung_tinh' ELSE 'yeu' END AS tk_strength
FROM state_all s JOIN {p}_div d ON s.symbol = d.symbol AND s.i = d.li""", ("state_all", f"{p}_div"))
    define(f"{p}_tech", TECH_SCORES.replace("state2", f"{p}_state2"), (f"{p}_state2",))


STATE_COLS = ["macd_cross", "macd_bars", "above_zero", "rsi_zone", "zone", "tk_cross", "tk_bars",
              "tk_strength", "twist", "chikou_free", "break_bars"]
STATE_NUM = {"hist_slope": 3, "rsi_slope": 5, "upper": 5, "lower": 5, "thickness": 6, "volume_ratio": 6}


tech_stage("last")
define("state2", "SELECT * FROM last_state2", ("last_state2",))


@query("technical_state", "WIN-4 WIN-5 WIN-6 WIN-8 WIN-10", with_("state2", "SELECT symbol, time, "
       + ", ".join(STATE_COLS) + ", " + ", ".join(f"round({c}, {n}) AS {c}" for c, n in STATE_NUM.items()) + " FROM state2"))
def technical_state(spark, d):
    df = T.technical_state(D.bars(spark, d), wanted="last")
    return rounded(df.select("symbol", "time", *STATE_COLS, *STATE_NUM), STATE_NUM)


define("tech_scores", "SELECT * FROM last_tech", ("last_tech",))
define("tech_actions", """
SELECT *, coalesce(zone = 'duoi_may', false) AS vetoed,
  CASE WHEN total_score >= 60 THEN CASE WHEN coalesce(zone = 'duoi_may', false) THEN 'TÍCH LUỸ' ELSE 'MUA' END WHEN total_score >= 20 THEN 'TÍCH LUỸ'
       WHEN total_score >= -20 THEN 'THEO DÕI' WHEN total_score >= -60 THEN 'GIẢM TỶ TRỌNG' ELSE 'BÁN' END AS action,
  CASE WHEN volume_ratio < 0.5e0 THEN 'trung_binh' ELSE 'cao' END AS confidence,
  close + CASE WHEN coalesce(atr, 0) <> 0 THEN 0.25e0 * atr ELSE close * 0.005e0 END AS entry_high,
  least(greatest(close - 1.5e0 * coalesce(atr, 0), coalesce(kijun, close - 1.5e0 * coalesce(atr, 0))), close * 0.999e0) AS stop_loss,
  close + 3e0 * coalesce(atr, 0) AS target,
  CASE WHEN senkou_a > close AND senkou_b > close THEN least(senkou_a, senkou_b) WHEN senkou_a > close THEN senkou_a WHEN senkou_b > close THEN senkou_b END AS resistance
FROM tech_scores""", ("tech_scores",))

ACT_NUM = {"score_macd": 5, "score_rsi": 5, "score_ichimoku": 5, "total_score": 5, "entry_high": 4,
           "stop_loss": 6, "target": 4, "risk_reward": 5}


@query("technical_recommendation", "TEC-1 TEC-2", with_("tech_actions", """
SELECT symbol, action, confidence, vetoed, divergence, round(score_macd, 5) AS score_macd, round(score_rsi, 5) AS score_rsi,
  round(score_ichimoku, 5) AS score_ichimoku, round(total_score, 5) AS total_score, close, round(entry_high, 4) AS entry_high,
  round(stop_loss, 6) AS stop_loss, round(target, 4) AS target, resistance,
  round(CASE WHEN close > stop_loss THEN (target - close) / (close - stop_loss) END, 5) AS risk_reward FROM tech_actions"""))
def technical_recommendation(spark, d):
    df = T.recommendations(D.bars(spark, d))
    return rounded(df.select("symbol", "action", "confidence", "vetoed", "divergence", "close", "resistance", *ACT_NUM), ACT_NUM)


@query("technical_reasons", "TEC-3", with_("state2", """
SELECT symbol, CASE WHEN divergence IS NULL THEN m ELSE m || ' Ngoài ra giá và MACD đang xuất hiện ' || CASE divergence WHEN 'bullish' THEN 'phân kỳ dương (đà giảm suy yếu)' ELSE 'phân kỳ âm (đà tăng suy yếu)' END || '.' END AS reason_macd,
  CASE WHEN rsi IS NULL THEN 'Chưa đủ dữ liệu để tính RSI.'
       WHEN rsi_zone = 'qua_mua' THEN 'RSI đang ở ' || r || ', vượt ngưỡng thích ứng ' || u || ' — vùng quá mua.'
       WHEN rsi_zone = 'qua_ban' THEN 'RSI đang ở ' || r || ', dưới ngưỡng thích ứng ' || l || ' — vùng quá bán.'
       ELSE 'RSI đang ở ' || r || ', trong vùng trung tính (' || l || '-' || u || ').' END AS reason_rsi,
  CASE WHEN zone IS NULL THEN 'Chưa đủ dữ liệu để xác định vị trí so với mây Ichimoku.' ELSE 'Giá đang ' || CASE zone WHEN 'tren_may' THEN 'trên mây Kumo' WHEN 'trong_may' THEN 'trong mây Kumo' ELSE 'dưới mây Kumo' END
    || CASE WHEN tk_cross IS NULL THEN '.' ELSE ', Tenkan/Kijun vừa giao cắt ' || CASE tk_cross WHEN 'golden' THEN 'tăng' ELSE 'giảm' END || ' ('
    || CASE tk_strength WHEN 'manh' THEN 'tín hiệu mạnh' WHEN 'trung_tinh' THEN 'tín hiệu trung tính' ELSE 'tín hiệu yếu' END || ').' END END AS reason_ichimoku
FROM (SELECT *, CAST(CAST(round(rsi) AS BIGINT) AS VARCHAR) AS r, CAST(CAST(round(upper) AS BIGINT) AS VARCHAR) AS u, CAST(CAST(round(lower) AS BIGINT) AS VARCHAR) AS l,
  CASE WHEN macd_cross = 'golden' THEN 'MACD vừa giao cắt vàng ' || CASE WHEN above_zero THEN 'trên đường 0 (tín hiệu mạnh)' ELSE 'dưới đường 0' END || ', ' || macd_bars || ' phiên trước.'
       WHEN macd_cross = 'death' THEN 'MACD vừa giao cắt chết ' || CASE WHEN above_zero THEN 'trên đường 0' ELSE 'dưới đường 0 (tín hiệu mạnh)' END || ', ' || macd_bars || ' phiên trước.'
       WHEN hist_slope < 0 THEN 'Histogram MACD đang thu hẹp, động lượng suy yếu dù chưa giao cắt.' WHEN hist_slope > 0 THEN 'Histogram MACD đang mở rộng, động lượng đang mạnh lên.'
       ELSE 'MACD chưa cho tín hiệu rõ ràng do thiếu dữ liệu.' END AS m FROM state2)"""))
def technical_reasons(spark, d):
    return T.recommendations(D.bars(spark, d)).select(
        "symbol", "reason_macd", "reason_rsi", "reason_ichimoku")


@query("screen_presets", "TEC-4", with_("state2", """
SELECT symbol, coalesce(zone = 'tren_may' AND break_bars <= 3 AND macd_cross = 'golden' AND macd_bars <= 3 AND volume_ratio >= 1.5e0, false) AS breakout,
  coalesce(zone = 'trong_may' AND thickness <= 1 AND volume_ratio <= 0.8e0, false) AS accumulate,
  coalesce(zone = 'duoi_may' AND break_bars <= 3, false) AS warning FROM state2"""))
def screen_presets(spark, d):
    return T.screens(T.technical_state(D.bars(spark, d), wanted="last"))



