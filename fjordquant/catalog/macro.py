"""Macro series: latest values, changes, z scores, impacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.catalog.registry import query
from fjordquant.functions.numeric import lookup, rounded
from fjordquant.operators import macro as M
from fjordquant.plans import domain as D
from fjordquant.plans.domain_sql import define, with_

# the five order priorities stand for five domestic and five foreign series
DOMESTIC_NAME = {"1-URGENT": "gdp_growth", "2-HIGH": "cpi", "3-MEDIUM": "policy_rate",
                 "4-NOT SPECIFIED": "credit_growth", "5-LOW": "usd_vnd"}
FOREIGN_NAME = {"1-URGENT": "fed_funds", "2-HIGH": "ust_10y", "3-MEDIUM": "usd_broad",
                "4-NOT SPECIFIED": "brent", "5-LOW": "vix"}


def _case(names: dict[str, str]) -> str:
    return "CASE series " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


define("manual", f"""
SELECT {_case(DOMESTIC_NAME)} AS indicator, CASE WHEN quarter(date) = 4 THEN CAST(year(date) AS VARCHAR) ELSE year(date) || 'Q' || quarter(date) END AS period,
  max_by(value, date) / 30000e0 AS value, 'sổ tay' AS source FROM macro GROUP BY 1, 2""", ("macro",))
define("world", f"SELECT {_case(DOMESTIC_NAME)} AS indicator, year(date) AS year, avg(value) / 30000e0 AS value FROM macro GROUP BY 1, 2", ("macro",))
define("mac_latest", """SELECT indicator, period, value, source FROM manual QUALIFY row_number() OVER (PARTITION BY indicator
  ORDER BY left(period, 4) DESC, CASE WHEN len(period) = 4 THEN 'Z' ELSE substr(period, 5) END DESC) = 1""", ("manual",))
define("mac_hist", """SELECT indicator, year, coalesce(m.value, w.value) AS value FROM (SELECT indicator, CAST(period AS INTEGER) AS year, value FROM manual WHERE len(period) = 4) m FULL JOIN world w USING (indicator, year)""", ("manual", "world"))


def manual(spark, d):
    """The last value of every quarter; that of the fourth stands for the year."""
    m = D.macro(spark, d)
    period = F.when(F.quarter("date") == 4, F.year("date").cast("string")).otherwise(
        F.concat(F.year("date"), F.lit("Q"), F.quarter("date")))
    return m.groupBy(lookup(DOMESTIC_NAME, F.col("series")).alias("indicator"), period.alias("period")).agg(
        (F.max_by("value", "date") / 30000.0).alias("value")).withColumn("source", F.lit("sổ tay"))


def world(spark, d):
    return D.macro(spark, d).groupBy(
        lookup(DOMESTIC_NAME, F.col("series")).alias("indicator"), F.year("date").alias("year")).agg(
        (F.avg("value") / 30000.0).alias("value"))


@query("macro_latest", "AGG-20 SRC-14 SRC-15 FRM-1", with_("mac_latest", """
SELECT indicator, CASE indicator WHEN 'gdp_growth' THEN 'Tăng trưởng GDP thực' WHEN 'cpi' THEN 'Lạm phát CPI bình quân' WHEN 'policy_rate' THEN 'Lãi suất tái cấp vốn (NHNN)'
  WHEN 'credit_growth' THEN 'Tăng trưởng tín dụng' ELSE 'Tỷ giá USD/VND' END AS label, period, round(value, 7) AS value, source FROM mac_latest"""))
def macro_latest(spark, d):
    df = M.latest_values(manual(spark, d)).join(M.indicator_dimension(spark).drop("unit"), "indicator")
    return rounded(df.select("indicator", "label", "period", "value", "source"), {"value": 7})


@query("macro_history", "AGG-20", with_("mac_hist", "SELECT indicator, year, round(value, 7) AS value FROM mac_hist"))
def macro_history(spark, d):
    return rounded(M.annual_history(manual(spark, d), world(spark, d)), {"value": 7})


def _sens_sql(table: dict) -> str:
    rows = [(t, k, w) for t, ws in table.items() for k, w in ws.items()]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}', {w}e0)" for t, k, w in rows) + ") v(company_type, indicator, weight)"


def _z_sql(v: str, base: float, width: float) -> str:
    return f"least(greatest(({v} - {base}e0) / {width}e0, -2), 2)"


define("dom_z", "SELECT indicator, CASE indicator " + " ".join(
    f"WHEN '{k}' THEN {_z_sql('value', b, w)}" for k, (b, w, _) in S.DOMESTIC.items()) + """ END AS z FROM (
  SELECT indicator, value FROM mac_latest WHERE indicator <> 'usd_vnd'
  UNION ALL SELECT 'usd_vnd', (max_by(value, year) / max_by(value, year) FILTER (year < (SELECT max(year) FROM mac_hist WHERE indicator = 'usd_vnd')) - 1) * 100 FROM mac_hist WHERE indicator = 'usd_vnd')""", ("mac_latest", "mac_hist"))
define("dom_sens", _sens_sql(S.DOMESTIC_SENSITIVITY))
define("dom_score", "SELECT company_type, least(greatest(50 + 25 * sum(weight * z) / sum(abs(weight)), 0), 100) AS score FROM dom_z JOIN dom_sens USING (indicator) GROUP BY 1", ("dom_z", "dom_sens"))


def domestic(spark, d):
    m = manual(spark, d)
    latest, hist = M.latest_values(m), M.annual_history(m, world(spark, d))
    return M.domestic_z(latest, M.fx_change(latest, hist))


@query("domestic_macro_scores", "MAC-1", with_("dom_score", "SELECT company_type, round(score, 6) AS score FROM dom_score"))
def domestic_macro_scores(spark, d):
    df = M.weighted_scores(domestic(spark, d), M.sensitivities(spark, S.DOMESTIC_SENSITIVITY), ["company_type"])
    return rounded(df, {"score": 6})


SCALE = {"fed_funds": 5e4, "ust_10y": 4e4, "usd_broad": 1.0, "brent": 1.0, "vix": 8e3}
define("foreign_s", f"SELECT {_case(FOREIGN_NAME)} AS series, date, value / CASE {_case(FOREIGN_NAME)} " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in SCALE.items()) + " END AS value FROM macro", ("macro",))
define("f_chg", """
WITH l AS (SELECT series, max(date) AS date, max_by(value, date) AS value FROM foreign_s GROUP BY 1),
b AS (SELECT l.series, l.date, l.value, max_by(f.value, f.date) FILTER (f.date <= l.date - 30) AS b1, max_by(f.value, f.date) FILTER (f.date <= l.date - 91) AS b3, max_by(f.value, f.date) FILTER (f.date <= l.date - 365) AS b12
  FROM l JOIN foreign_s f USING (series) GROUP BY 1, 2, 3)
SELECT series, date, value, CASE WHEN r THEN 'điểm %' ELSE '%' END AS change_unit, CASE WHEN r THEN value - b1 ELSE value / b1 - 1 END AS chg_1m, CASE WHEN r THEN value - b3 ELSE value / b3 - 1 END AS chg_3m,
  CASE WHEN r THEN value - b12 ELSE value / b12 - 1 END AS chg_1y FROM (SELECT *, series IN ('fed_funds', 'ust_10y') AS r FROM b)""", ("foreign_s",))


def foreign(spark, d):
    name = lookup(FOREIGN_NAME, F.col("series"))
    return D.macro(spark, d).withColumn("series", name).withColumn(
        "value", F.col("value") / lookup(SCALE, F.col("series")))


@query("macro_changes", "WIN-14 MAC-2", with_("f_chg", """
SELECT series, date, change_unit, round(value, 7) AS value, round(chg_1m, 7) AS chg_1m, round(chg_3m, 7) AS chg_3m, round(chg_1y, 7) AS chg_1y FROM f_chg"""))
def macro_changes(spark, d):
    return rounded(M.series_changes(foreign(spark, d)), {"value": 7, "chg_1m": 7, "chg_3m": 7, "chg_1y": 7})


@query("macro_weekly", "WIN-14", with_("foreign_s", """
SELECT series, CAST(date + CAST((7 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week, round(max_by(value, date), 7) AS value FROM (SELECT *, max(date) OVER (PARTITION BY series) AS l FROM foreign_s) WHERE date > l - 365 GROUP BY 1, 2"""))
def macro_weekly(spark, d):
    return rounded(M.weekly_points(foreign(spark, d)), {"value": 7})


define("int_z", "SELECT series AS indicator, CASE series " + " ".join(
    f"WHEN '{k}' THEN {_z_sql('value' if basis == 'level' else basis, n, w)}" for k, (basis, n, w, _) in S.INTERNATIONAL.items()) + " END AS z FROM f_chg", ("f_chg",))
define("int_sens", _sens_sql(S.INTERNATIONAL_SENSITIVITY))
define("int_score", """
SELECT company_type, icb1, least(greatest(50 + 25 * sum(w * z) / sum(abs(w)), 0), 100) AS score FROM (
 SELECT company_type, icb1, z, CASE WHEN indicator = 'brent' AND icb1 = 'Dầu khí' THEN 0.8e0 WHEN indicator = 'brent' AND icb1 = 'Du lịch và Giải trí' THEN -0.8e0 ELSE weight END AS w
 FROM int_z JOIN int_sens USING (indicator), (SELECT unnest(['Dầu khí', 'Du lịch và Giải trí', 'Khác']) AS icb1)) GROUP BY 1, 2""", ("int_z", "int_sens"))
INDUSTRIES = ["Dầu khí", "Du lịch và Giải trí", "Khác"]


def international(spark, d):
    z = M.international_z(M.series_changes(foreign(spark, d)))
    return M.weighted_scores(z, M.industry_sensitivities(spark, INDUSTRIES), ["company_type", "icb1"])


@query("international_macro_scores", "MAC-2", with_("int_score", "SELECT company_type, icb1, round(score, 6) AS score FROM int_score"))
def international_macro_scores(spark, d):
    return rounded(international(spark, d), {"score": 6})


@query("macro_impacts", "MAC-3", with_("dom_score int_score", """
SELECT company_type, icb1, round(d.score, 6) AS domestic, round(i.score, 6) AS international, round(coalesce(0.7e0 * d.score + 0.3e0 * i.score, d.score, i.score), 6) AS blended
FROM dom_score d JOIN int_score i USING (company_type)"""))
def macro_impacts(spark, d):
    dom = M.weighted_scores(domestic(spark, d), M.sensitivities(spark, S.DOMESTIC_SENSITIVITY), ["company_type"])
    j = dom.withColumnRenamed("score", "domestic").join(
        international(spark, d).withColumnRenamed("score", "international"), "company_type")
    out = j.withColumn("blended", M.blend(F.col("domestic"), F.col("international")))
    return rounded(out.select("company_type", "icb1", "domestic", "international", "blended"),
                   {"domestic": 6, "international": 6, "blended": 6})


@query("macro_commentary", "MAC-1", with_("mac_latest", """
SELECT indicator, CASE indicator WHEN 'gdp_growth' THEN printf('Tăng trưởng GDP đạt %.2f%%', value) || CASE WHEN value > 6.5 THEN ', cao hơn mức tăng trưởng tiềm năng ~6% của Việt Nam — hỗ trợ nhu cầu tiêu dùng và đầu tư.'
   WHEN value >= 5.5 THEN ', tương đương mức tăng trưởng tiềm năng ~6% của Việt Nam — môi trường tăng trưởng ở mức trung tính.' ELSE ', thấp hơn mức tăng trưởng tiềm năng ~6% của Việt Nam — cầu nội địa chịu áp lực.' END
 WHEN 'cpi' THEN printf('Lạm phát CPI %.2f%%', value) || CASE WHEN value < 4 THEN ', dưới ngưỡng mục tiêu ~4,5% của Quốc hội, tạo dư địa cho chính sách tiền tệ nới lỏng.' WHEN value < 4.5 THEN ', tiệm cận ngưỡng mục tiêu, NHNN khó nới lỏng thêm.' ELSE ', vượt ngưỡng mục tiêu, rủi ro thắt chặt tiền tệ.' END
 WHEN 'policy_rate' THEN printf('Lãi suất tái cấp vốn %.2f%%', value) || CASE WHEN value <= 4.5 THEN ' — mặt bằng lãi suất thấp, hỗ trợ chi phí vốn và định giá cổ phiếu.' ELSE ' — mặt bằng lãi suất cao, gây áp lực lên chi phí vốn và định giá.' END
 WHEN 'credit_growth' THEN printf('Tăng trưởng tín dụng %.2f%%', value) || CASE WHEN value >= 13 THEN ' — dòng vốn vào nền kinh tế mạnh.' ELSE ' — dòng vốn tín dụng chậm lại.' END END AS sentence FROM mac_latest WHERE indicator <> 'usd_vnd'"""))
def macro_commentary(spark, d):
    return M.commentary(M.latest_values(manual(spark, d)))
