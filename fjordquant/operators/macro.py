"""Domestic and international macro readings and their effect by company type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import clip

# indicator -> (label, unit) (fixed values)
INDICATORS = {
    "gdp_growth": ("Tăng trưởng GDP thực", "%"),
    "cpi": ("Lạm phát CPI bình quân", "%"),
    "policy_rate": ("Lãi suất tái cấp vốn (NHNN)", "%"),
    "lending_rate": ("Lãi suất cho vay bình quân", "%"),
    "credit_growth": ("Tăng trưởng tín dụng", "%"),
    "usd_vnd": ("Tỷ giá USD/VND", "VND"),
    "gov_bond_10y": ("Lợi suất TPCP 10 năm", "%"),
    "gdp_growth_ytd": ("GDP lũy kế từ đầu năm", "%"),
    "cpi_yoy": ("CPI tháng gần nhất (so cùng kỳ)", "%"),
    "credit_growth_ytd": ("Tín dụng từ đầu năm", "%"),
    "usd_vnd_ytd": ("Tỷ giá trung tâm thay đổi từ đầu năm", "%"),
    "private_credit_gdp": ("Tín dụng tư nhân/GDP", "%"),
}


def indicator_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, *v) for k, v in INDICATORS.items()], "indicator string, label string, unit string")


def period_key() -> Column:
    """Sort key of a period: year, then the quarter, the full year last."""
    period = F.col("period")
    year = F.coalesce(F.expr("try_cast(substr(period, 1, 4) AS int)"), F.lit(0))
    rest = F.substring(period, 5, 100)
    return F.struct(year.alias("year"), F.when(rest == "", "Z").otherwise(rest).alias("sub"))


def latest_values(manual: DataFrame) -> DataFrame:
    """Newest value per indicator by period."""
    rows = manual.where(F.col("value").isNotNull())
    newest = F.max_by(F.struct("value", "period", "source"), period_key())
    return rows.groupBy("indicator").agg(newest.alias("v")).select("indicator", "v.*")


def annual_history(manual: DataFrame, world: DataFrame) -> DataFrame:
    """Yearly values: entered by hand first, the world source where missing."""
    hand = manual.where(F.col("value").isNotNull() & F.col("period").rlike(r"^\d{4}$")).select(
        "indicator", F.col("period").cast("int").alias("year"), F.col("value").alias("hand"))
    other = world.select("indicator", "year", F.col("value").alias("world"))
    return hand.join(other, ["indicator", "year"], "full").select(
        "indicator", "year", F.coalesce("hand", "world").alias("value"))


def with_missing_latest(latest: DataFrame, history: DataFrame) -> DataFrame:
    newest = history.groupBy("indicator").agg(
        F.max_by("value", "year").alias("value"), F.max("year").cast("string").alias("period"))
    filled = newest.join(latest.select("indicator"), "indicator", "left_anti").withColumn(
        "source", F.lit("World Bank Open Data"))
    return latest.unionByName(filled)


def fx_change(latest: DataFrame, history: DataFrame) -> DataFrame:
    """One row: the year-to-date entry if present, else the last yearly change in %."""
    w = Window.partitionBy("indicator").orderBy("year")
    yearly = history.where(F.col("indicator") == "usd_vnd").withColumn(
        "chg", (F.col("value") / F.lag("value").over(w) - 1) * 100)
    change = yearly.agg(F.max_by("chg", "year").alias("by_year"))
    ytd = latest.where(F.col("indicator") == "usd_vnd_ytd").agg(F.max("value")).scalar()
    return change.select(F.coalesce(ytd, F.col("by_year")).alias("fx"))


def domestic_z(latest: DataFrame, fx: DataFrame) -> DataFrame:
    """(indicator, z): distance from neutral in widths, held inside +-2."""
    values = latest.where(F.col("indicator") != "usd_vnd").select("indicator", "value").unionByName(
        fx.select(F.lit("usd_vnd").alias("indicator"), F.col("fx").alias("value")))
    return _z(values, {k: (base, width) for k, (base, width, _) in S.DOMESTIC.items()})


def _z(values: DataFrame, model: dict) -> DataFrame:
    z = F.lit(None).cast("double")
    for key, (base, width) in model.items():
        z = F.when(F.col("indicator") == key,
                   clip((F.col("value") - base) / width, -2.0, 2.0)).otherwise(z)
    return values.select("indicator", z.alias("z")).where(F.col("z").isNotNull())


def sensitivities(spark: SparkSession, table: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(t, k, w) for t, weights in table.items() for k, w in weights.items()]
    return spark.createDataFrame(rows, "company_type string, indicator string, weight double")


def weighted_scores(z: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """50 + 25 * weighted z over the indicators present, held inside 0..100."""
    j = z.join(weights, "indicator")
    raw = 50 + 25 * F.sum(F.col("weight") * F.col("z")) / F.sum(F.abs("weight"))
    return j.groupBy(*by).agg(clip(raw, 0.0, 100.0).alias("score"))


def series_changes(series: DataFrame) -> DataFrame:
    """Per series: newest value and its change over 30/91/365 calendar days.

    Rates change in points, everything else in percent; the base is the last
    value on or before the date.
    """
    rows = series.where(F.col("value").isNotNull()).withColumn("d", F.unix_date("date"))
    order = Window.partitionBy("series").orderBy("d")
    spans = {"chg_1m": 30, "chg_3m": 91, "chg_1y": 365}
    df = rows.withColumns({
        f"_{k}": F.last("value").over(order.rangeBetween(Window.unboundedPreceding, -n))
        for k, n in spans.items()})
    last = df.groupBy("series").agg(
        F.max("date").alias("date"), F.max_by("value", "d").alias("value"),
        *[F.max_by(f"_{k}", "d").alias(f"_{k}") for k in spans])
    rate = F.col("series").isin(S.RATE_SERIES)
    return last.select(
        "series", "date", "value",
        F.when(rate, "điểm %").otherwise("%").alias("change_unit"),
        *[F.when(rate, F.col("value") - F.col(f"_{k}"))
          .when(F.col(f"_{k}") != 0, F.col("value") / F.col(f"_{k}") - 1).alias(k) for k in spans])


def weekly_points(series: DataFrame, days: int = 365) -> DataFrame:
    """Last value of each week ending Sunday over the last year of each series."""
    last = F.max("date").over(Window.partitionBy("series"))
    recent = series.where(F.col("value").isNotNull()).withColumn("l", last).where(
        F.col("date") > F.date_sub("l", days))
    return recent.groupBy("series", F.next_day(F.date_sub("date", 1), "SUN").alias("week")).agg(
        F.max_by("value", "date").alias("value"))


def international_z(changes: DataFrame) -> DataFrame:
    z = F.lit(None).cast("double")
    for key, (basis, neutral, width, _) in S.INTERNATIONAL.items():
        v = F.col("value") if basis == "level" else F.col(basis)
        z = F.when(F.col("series") == key, clip((v - neutral) / width, -2.0, 2.0)).otherwise(z)
    return changes.select(F.col("series").alias("indicator"), z.alias("z")).where(
        F.col("z").isNotNull())


def industry_sensitivities(spark: SparkSession, industries: list[str]) -> DataFrame:
    """(company_type, icb1, indicator, weight) with the industry overrides applied."""
    rows = []
    for t, weights in S.INTERNATIONAL_SENSITIVITY.items():
        for icb1 in industries:
            merged = {**weights, **S.INTERNATIONAL_BY_INDUSTRY.get(icb1, {})}
            rows += [(t, icb1, k, w) for k, w in merged.items()]
    return spark.createDataFrame(
        rows, "company_type string, icb1 string, indicator string, weight double")


def blend(domestic: Column, international: Column, w: float = S.INTERNATIONAL_WEIGHT) -> Column:
    return F.coalesce((1 - w) * domestic + w * international, domestic, international)


def commentary(latest: DataFrame) -> DataFrame:
    """Threshold sentences per indicator (wording is a fixed value)."""
    v = F.col("value")
    two = F.format_string("%.2f%%", v)
    text = (
        F.when(F.col("indicator") == "gdp_growth", F.concat(
            F.lit("Tăng trưởng GDP đạt "), two,
            F.when(v > 6.5, ", cao hơn mức tăng trưởng tiềm năng ~6% của Việt Nam — "
                            "hỗ trợ nhu cầu tiêu dùng và đầu tư.")
            .when(v >= 5.5, ", tương đương mức tăng trưởng tiềm năng ~6% của Việt Nam — "
                            "môi trường tăng trưởng ở mức trung tính.")
            .otherwise(", thấp hơn mức tăng trưởng tiềm năng ~6% của Việt Nam — "
                       "cầu nội địa chịu áp lực.")))
        .when(F.col("indicator") == "cpi", F.concat(
            F.lit("Lạm phát CPI "), two,
            F.when(v < 4.0, ", dưới ngưỡng mục tiêu ~4,5% của Quốc hội, tạo dư địa cho chính sách "
                            "tiền tệ nới lỏng.")
            .when(v < 4.5, ", tiệm cận ngưỡng mục tiêu, NHNN khó nới lỏng thêm.")
            .otherwise(", vượt ngưỡng mục tiêu, rủi ro thắt chặt tiền tệ.")))
        .when(F.col("indicator") == "policy_rate", F.concat(
            F.lit("Lãi suất tái cấp vốn "), two,
            F.when(v <= 4.5, " — mặt bằng lãi suất thấp, hỗ trợ chi phí vốn và định giá cổ phiếu.")
            .otherwise(" — mặt bằng lãi suất cao, gây áp lực lên chi phí vốn và định giá.")))
        .when(F.col("indicator") == "credit_growth", F.concat(
            F.lit("Tăng trưởng tín dụng "), two,
            F.when(v >= 13, " — dòng vốn vào nền kinh tế mạnh.")
            .otherwise(" — dòng vốn tín dụng chậm lại."))))
    return latest.select("indicator", text.alias("sentence")).where(F.col("sentence").isNotNull())
