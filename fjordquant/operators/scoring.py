"""Group scores, the composite score, ratings, eligibility and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S
from fjordquant.functions.numeric import clip, mean_of, weighted_mean


def part(c: Column) -> Column:
    return clip(c, 0.0, 100.0)


def quality_score() -> Column:
    bank = F.col("company_type") == "BANK"
    roe = part(20 + F.col("roe_last") * 300)
    banks = [roe, part(100 - (F.col("cir") - 0.25) * 200), part(100 - F.col("credit_cost") * 3000),
             part(F.col("equity_to_assets") * 800)]
    others = [roe, part(100 - F.col("debt_to_equity_last") * 40),
              part(30 + (F.col("current_ratio") - 0.8) * 50), part(30 + F.col("cfo_to_ni3") * 40),
              part(F.col("interest_coverage") * 12)]
    return F.when(bank, mean_of(banks)).otherwise(mean_of(others))


def growth_score() -> Column:
    return part(45 + mean_of([F.col("top_line_cagr"), F.col("ni_cagr")]) * 250)


def valuation_score() -> Column:
    return F.when(F.col("confidence") != S.LOW, part(50 + F.col("upside") * 150))


def technical_score() -> Column:
    return part(50 + F.col("tech_total") / 2)


def with_composite(df: DataFrame) -> DataFrame:
    """Weighted total over the groups present; needs at least three."""
    groups = [(F.col(f"score_{k}"), w) for k, w in S.GROUP_WEIGHTS.items()]
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c, _ in groups])
    return df.withColumns({
        "n_groups": n, "score": F.when(n >= S.MIN_GROUPS, weighted_mean(groups))})


def with_rating(df: DataFrame) -> DataFrame:
    """Rating by upside band, moved one notch by the score; low confidence watches."""
    base = F.lit(0)
    for floor, level in reversed(S.RATING_BANDS):
        base = F.when(F.col("upside") >= floor, level).otherwise(base)
    base = F.when(F.col("upside").isNotNull(), base)
    top = len(S.RATINGS) - 1
    up = (F.col("score") >= S.UPGRADE_SCORE) & (base < top)
    down = (F.col("score") < S.DOWNGRADE_SCORE) & (base > 0)
    moved = F.when(up, base + 1).when(down, base - 1).otherwise(base)
    names = F.array(*[F.lit(x) for x in S.RATINGS])
    low = F.col("confidence") == S.LOW
    strong = reduce(lambda a, b: a + b, [
        F.coalesce((F.col(f"score_{k}") > 65).cast("int"), F.lit(0)) for k in S.GROUP_WEIGHTS])
    rating = F.when(low, S.WATCH).otherwise(F.get(names, moved))
    return df.withColumns({
        "base_rating": F.when(~low, F.get(names, base)), "rating": rating,
        "notch": F.when(low | base.isNull() | F.col("score").isNull(), None)
        .when(up, 1).when(down, -1).otherwise(0),
        "conflict": F.coalesce((rating == S.RATINGS[0]) & (strong >= 3), F.lit(False)),
    })


def with_eligibility(df: DataFrame) -> DataFrame:
    """The opportunity rule, and the list of reasons when it fails."""
    rules = {
        "no_statements": ~F.col("has_bctc"),
        "failed_checks": F.col("failed_checks") > 0,
        "low_confidence": ~F.col("confidence").isin(S.HIGH, S.MEDIUM),
        "illiquid": ~(F.col("avg_value_20d") >= S.MIN_OPPORTUNITY_VALUE),
        "rating": ~(F.col("rating") == S.RATINGS[-1]),
        "upside": ~((F.col("upside") > 0) & (F.col("upside") <= 1.5)),
        "no_score": F.col("score").isNull(),
    }
    missing = {"failed_checks": False}
    reasons = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(missing.get(k, True))), k) for k, bad in rules.items()]))
    return df.withColumns({
        "not_eligible_because": F.array_join(reasons, ","), "eligible": F.size(reasons) == 0})


def ranking_order() -> list[Column]:
    return [F.desc("_s"), F.desc("_u"), F.desc("_v"), F.asc("symbol")]


def with_ranking_keys(df: DataFrame) -> DataFrame:
    def value(c: str, missing: float) -> Column:
        return F.when(F.col(c).isNull() | (F.col(c) == 0), missing).otherwise(F.col(c))

    return df.withColumns({
        "_s": value("score", -1.0), "_u": value("upside", -10.0), "_v": value("avg_value_20d", 0.0)})


def opportunities(df: DataFrame, exchange: str | None = None, min_value: float | None = None,
                  eligible_only: bool = True, limit: int = 100, industry: str | None = None,
                  rating: str | None = None, confidence: str | None = None,
                  min_upside: float | None = None, min_cap: float | None = None,
                  q: str | None = None) -> DataFrame:
    """Filtered ranking, best first (a bounded top-k report with its rank)."""
    if eligible_only:
        df = df.where("eligible")
    if exchange:
        df = df.where(F.col("exchange").isin([e.strip().upper() for e in exchange.split(",")]))
    if min_value is not None:
        df = df.where(F.coalesce("avg_value_20d", F.lit(0.0)) >= min_value)
    if industry:
        df = df.where(F.contains(F.lower("icb4"), F.lit(industry.lower())))
    if rating:
        df = df.where(F.upper("rating") == rating.upper())
    if confidence:
        df = df.where(F.upper("confidence") == confidence.upper())
    if min_upside is not None:
        df = df.where(F.col("upside") >= min_upside)
    if min_cap is not None:
        df = df.where(F.coalesce("market_cap", F.lit(0.0)) >= min_cap)
    if q:
        df = df.where(F.contains(F.lower(F.col("symbol").cast("string")), F.lit(q.lower()))
                      | F.contains(F.lower("name"), F.lit(q.lower())))
    order = ranking_order()
    top = with_ranking_keys(df).orderBy(*order).limit(max(1, limit))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_s", "_u", "_v")


# (upper bound, label) of the upside report (fixed values)
UPSIDE_BUCKETS = [(-0.5, "<-50%"), (0.0, "-50..0%"), (0.25, "0..25%"), (0.5, "25..50%"),
                  (1.0, "50..100%")]


def upside_distribution(df: DataFrame) -> DataFrame:
    label = F.lit(">100%")
    for hi, name in reversed(UPSIDE_BUCKETS):
        cond = F.col("upside") < hi if name == "<-50%" else F.col("upside") <= hi
        label = F.when(cond, name).otherwise(label)
    label = F.when(F.col("upside").isNull(), "missing").otherwise(label)
    return df.groupBy(label.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("n_eligible"))


def histogram(df: DataFrame, value: str, bins: int = 12) -> DataFrame:
    """Equal-width bins between minimum and maximum, the maximum in the last bin."""
    known = df.where(F.col(value).isNotNull()).select(value)
    bounds = known.agg(F.struct(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n")).alias("b"))
    x = known.withColumn("b", bounds.scalar()).where(F.col("b.n") >= 3)
    width = (F.col("b.hi") - F.col("b.lo")) / bins
    at = F.least(F.floor((F.col(value) - F.col("b.lo")) / width), F.lit(bins - 1))
    return x.withColumn("bin", F.coalesce(at, F.lit(0))).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("b.lo") + F.col("bin") * width).alias("from"))
