"""Point-in-time visibility of statements and as-of joins.

A statement becomes visible on ``available_from`` and stays the newest vintage
of its period until the next one arrives.  That interval is computed once;
reading at a date is then a filter, and reading at many dates is one sorted
pass per symbol instead of an inequality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant import settings as S

FAR = "9999-12-31"


def period_end() -> Column:
    return F.when(
        F.col("quarter") == 0, F.make_date("year", F.lit(12), F.lit(31))
    ).otherwise(F.last_day(F.make_date("year", F.greatest(F.col("quarter"), F.lit(1)) * 3, F.lit(1))))


def rule_date() -> Column:
    month, day = S.ANNUAL_VISIBLE
    lag = F.element_at(F.array(*[F.lit(x) for x in S.QUARTER_LAG_DAYS]),
                       F.greatest(F.col("quarter"), F.lit(1)).cast("int"))
    return F.when(
        F.col("quarter") == 0, F.make_date(F.col("year") + 1, F.lit(month), F.lit(day))
    ).otherwise(F.date_add(period_end(), lag))


def annotate(statements: DataFrame) -> DataFrame:
    """Add period_end, available_from and the basis of that date."""
    published = F.to_date("published_at")
    real = published > period_end()
    return statements.withColumns({
        "period_end": period_end(),
        "available_from": F.when(real, F.date_add(published, S.PUBLICATION_DELAY_DAYS))
        .otherwise(rule_date()),
        "available_basis": F.when(real, S.BASIS_ACTUAL).otherwise(S.BASIS_RULE),
    })


def vintages(annotated: DataFrame, ordinal: str) -> DataFrame:
    """Validity interval of every vintage of a period: [available_from, valid_to)."""
    w = Window.partitionBy("symbol", "year", "quarter").orderBy("available_from", ordinal)
    return annotated.withColumn(
        "valid_to", F.coalesce(F.lead("available_from").over(w), F.lit(FAR).cast("date")))


def as_of_view(vintage_rows: DataFrame, as_of: str, freq: str = "all") -> DataFrame:
    """Newest visible vintage of every period at one date."""
    at = F.lit(as_of).cast("date")
    view = vintage_rows.where((F.col("available_from") <= at) & (F.col("valid_to") > at))
    if freq == "annual":
        view = view.where(F.col("quarter") == 0)
    elif freq == "quarter":
        view = view.where(F.col("quarter") != 0)
    elif freq != "all":
        raise ValueError(f"unknown freq {freq}")
    return view


def attach_as_of(dates: DataFrame, events: DataFrame, by: list[str], date_col: str,
                 event_col: str, payload: list[str], tie: list[str] | None = None) -> DataFrame:
    """For each row of ``dates`` the payload of the newest event on or before it.

    Both sides are laid on one timeline per key and the last event is carried
    forward: one shuffle and one sort, no pairs, no inequality join.
    """
    ties = tie or []
    body = F.struct(*payload)
    left = dates.select("*", F.col(date_col).alias("_t"), F.lit(1).alias("_side"),
                        *[F.lit(None).cast(events.schema[c].dataType).alias(f"_k_{c}") for c in ties],
                        F.lit(None).cast(events.select(body.alias("x")).schema["x"].dataType).alias("_p"))
    right = events.select(*by, F.col(event_col).alias("_t"), F.lit(0).alias("_side"),
                          *[F.col(c).alias(f"_k_{c}") for c in ties], body.alias("_p"))
    order = Window.partitionBy(*by).orderBy("_t", "_side", *[f"_k_{c}" for c in ties])
    carried = F.last("_p", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_c", carried)
    return both.where(F.col("_side") == 1).select(
        *dates.columns, *[F.col(f"_c.{c}").alias(c) for c in payload])


def latest_periods(annotated: DataFrame, ordinal: str, payload: list[str]) -> DataFrame:
    """Running newest period per symbol: what a reader at each publication date sees."""
    key = F.struct("period_end", "quarter", "available_from", ordinal, *payload)
    w = Window.partitionBy("symbol").orderBy("available_from", ordinal)
    newest = F.max(key).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return annotated.select("symbol", F.col("available_from").alias("seen_from"),
                            F.col(ordinal).alias("seen_order"), newest.alias("n")).select(
        "symbol", "seen_from", "seen_order", "n.*")


def prices_as_of(panel: DataFrame, signal_dates: DataFrame,
                 stale_days: int = S.PRICE_STALE_DAYS) -> DataFrame:
    """Last bar within ``stale_days`` of each signal date, per symbol.

    A bar answers for the days until the next bar (at most ``stale_days``); the
    signal dates inside that span are found by an equi-join on the month.
    """
    w = Window.partitionBy("symbol").orderBy("time")
    upto = F.least(
        F.coalesce(F.date_sub(F.lead("time").over(w), 1), F.lit(FAR).cast("date")),
        F.date_add("time", stale_days - 1))
    months = F.sequence(F.trunc("time", "month"), F.trunc("_upto", "month"),
                        F.expr("interval 1 month"))
    spans = panel.withColumn("_upto", upto).withColumn("_month", F.explode(months))
    # one row a signal date, so the dates are sent to the bars, which keep their partitioning
    dates = F.broadcast(signal_dates.select("as_of", F.trunc("as_of", "month").alias("_month")))
    hit = spans.join(dates, "_month").where(F.col("as_of").between(F.col("time"), F.col("_upto")))
    return hit.select(
        "as_of", *[c for c in panel.columns if c != "time"],
        F.col("time").alias("as_of_price"), (F.col("time") == F.col("as_of")).alias("traded_today"))


def annual_as_of(annual: DataFrame, as_of: str, years: int = 10) -> DataFrame:
    """Yearly rows visible at a date by the fixed rule, the newest ``years`` of them."""
    month, day = S.ANNUAL_VISIBLE
    visible = annual.where(
        F.make_date(F.col("year") + 1, F.lit(month), F.lit(day)) <= F.lit(as_of).cast("date"))
    newest = Window.partitionBy("symbol").orderBy(F.desc("year"))
    return visible.withColumn("_rn", F.row_number().over(newest)).where(
        F.col("_rn") <= years).drop("_rn")
