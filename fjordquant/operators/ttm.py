"""Trailing twelve months, quarter hygiene and reconciliation with annual figures.

Everything runs on one row per (symbol, quarter index); a RANGE frame over the
index skips nothing silently, because a missing quarter lowers the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant.operators.pit import annotate


def qindex() -> Column:
    return F.col("year") * 4 + F.col("quarter") - 1


def qlabel(q: Column) -> Column:
    return F.concat(F.floor(q / 4).cast("string"), F.lit("-Q"), (q % 4 + 1).cast("string"))


def dedupe_quarters(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row per (symbol, quarter): copies counted, differing copies flagged.

    Copies are compared by the smallest and largest of their value structs, an
    aggregate with map-side combine, so any number of copies is fine.
    """
    values = F.struct(*[F.col(c) for c in fields])
    keyed = rows.where(F.col("quarter").between(1, 4)).withColumn("q", qindex())
    agg = keyed.groupBy("symbol", "q").agg(
        F.count(F.lit(1)).alias("copies"), F.min(values).alias("lo"), F.max(values).alias("hi"))
    return agg.select(
        "symbol", "q", F.floor(F.col("q") / 4).cast("int").alias("year"),
        (F.col("q") % 4 + 1).cast("int").alias("quarter"), "copies",
        (F.col("copies") > 1).alias("repeated"),
        (~F.col("lo").eqNullSafe(F.col("hi"))).alias("conflict"),
        *[F.col(f"lo.{c}").alias(c) for c in fields])


def quarter_report(deduped: DataFrame) -> DataFrame:
    """Missing, conflicting and identical quarters in each symbol's last four."""
    last = F.max("q").over(Window.partitionBy("symbol"))
    recent = deduped.withColumn("last", last).where(F.col("q") > F.col("last") - 4)

    def labels(flag: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(flag, qlabel(F.col("q")))))

    have = F.collect_set("q")
    wanted = F.sequence(F.max("last") - 3, F.max("last"))
    out = recent.groupBy("symbol").agg(
        F.max("last").alias("last"),
        F.transform(F.array_except(wanted, have), qlabel).alias("missing"),
        labels(F.col("conflict")).alias("conflicting"),
        labels(F.col("repeated") & ~F.col("conflict")).alias("identical"))
    return out.select(
        "symbol", qlabel(F.col("last")).alias("last_quarter"),
        F.array_join("missing", ",").alias("missing"),
        F.array_join("conflicting", ",").alias("conflicting"),
        F.array_join("identical", ",").alias("identical"))


def with_ttm(deduped: DataFrame, flows: list[str], stocks: list[str]) -> DataFrame:
    """TTM at every quarter that closes four consecutive, unambiguous quarters."""
    four = Window.partitionBy("symbol").orderBy("q").rangeBetween(-3, 0)
    five = Window.partitionBy("symbol").orderBy("q").rangeBetween(-4, 0)
    bad = F.sum(F.col("conflict").cast("int"))
    ok = (F.count(F.lit(1)).over(four) == 4) & (bad.over(four) == 0)
    cols = {f"{c}_ttm": F.when(F.count(c).over(four) == 4, F.sum(c).over(four)) for c in flows}
    df = deduped.withColumns(cols | {
        "ok": ok,
        "equity_avg_5": F.when((F.count("equity").over(five) == 5) & (bad.over(five) == 0),
                               F.avg("equity").over(five)),
    })
    out = df.where("ok").withColumns({
        "ttm_label": F.concat(F.lit("TTM Q"), "quarter", F.lit("/"), "year"),
        "ttm_periods": F.concat_ws(",", *[qlabel(F.col("q") - k) for k in (3, 2, 1, 0)]),
        "roe_ttm": F.try_divide(
            F.coalesce(*[f"{c}_ttm" for c in ("net_income_parent", "net_income") if c in flows]),
            F.col("equity_avg_5")),
    })
    return out.select("symbol", "q", "year", "quarter", "ttm_label", "ttm_periods",
                      *cols, *stocks, "equity_avg_5", "roe_ttm")


def ttm_history(deduped: DataFrame) -> DataFrame:
    """TTM parent profit of every valid end quarter with the date it became known."""
    stamped = annotate(deduped)
    four = Window.partitionBy("symbol").orderBy("q").rangeBetween(-3, 0)
    ok = ((F.count(F.lit(1)).over(four) == 4)
          & (F.sum(F.col("conflict").cast("int")).over(four) == 0)
          & (F.count("net_income_parent").over(four) == 4))
    df = stamped.withColumns({
        "ok": ok, "ni_ttm": F.sum("net_income_parent").over(four),
        "known": F.max("available_from").over(four),
        "published": F.max("published_at").over(four),
    })
    return df.where("ok").select(
        "symbol", "q", F.col("known").alias("available_from"), "ni_ttm",
        F.concat(F.lit("TTM Q"), "quarter", F.lit("/"), "year").alias("ttm_label"),
        F.concat_ws(",", *[qlabel(F.col("q") - k) for k in (3, 2, 1, 0)]).alias("ttm_periods"),
        F.col("published").alias("ttm_published_at"))


def ttm_snapshot(deduped: DataFrame, max_lag: int = 1) -> DataFrame:
    """Current TTM per symbol, or the reason why there is none.

    The market quarter is the one most symbols end with (the later on a tie).
    """
    last = deduped.groupBy("symbol").agg(F.max("q").alias("q"))
    votes = last.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    market = votes.agg(F.max_by("q", F.struct("n", "q"))).scalar()
    ttm = ttm_history(deduped)
    joined = last.join(ttm, ["symbol", "q"], "left").withColumn("market", market)
    stale = F.col("q") < F.col("market") - max_lag
    return joined.select(
        "symbol", qlabel(F.col("q")).alias("last_quarter"),
        F.when(~stale, F.col("ni_ttm")).alias("ni_ttm"),
        F.when(~stale, F.col("ttm_label")).alias("ttm_label"),
        F.when(~stale, F.col("ttm_periods")).alias("ttm_periods"),
        F.when(~stale, F.col("ttm_published_at")).alias("ttm_published_at"),
        F.when(stale, "stale").when(F.col("ni_ttm").isNull(), "incomplete").alias("skipped"))


def deaccumulate(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Year-to-date values to single quarters; ambiguous or gapped ones are null."""
    per = rows.groupBy("symbol", "year", "quarter").agg(*[
        x for c in fields for x in (
            F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"),
            (F.count(c) == F.count(F.lit(1))).alias(f"full_{c}"))])
    w = Window.partitionBy("symbol", "year").orderBy("quarter")
    single = per.withColumns({
        c: F.when((F.col(f"lo_{c}") == F.col(f"hi_{c}")) & F.col(f"full_{c}"), F.col(f"lo_{c}"))
        for c in fields})
    follows = F.lag("quarter").over(w) == F.col("quarter") - 1
    return single.select("symbol", "year", "quarter", *[
        F.when(F.col("quarter") == 1, F.col(c))
        .when(follows, F.col(c) - F.lag(c).over(w)).alias(c) for c in fields])


def reconcile_annual(deduped: DataFrame, annual: DataFrame, fields: list[str],
                     tolerance: float = 0.02) -> DataFrame:
    """Sum of quarters against the annual figure per (symbol, year, field)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in fields])).alias("p")
    q = deduped.select("symbol", "year", "conflict", "quarter", pairs).groupBy(
        "symbol", "year", F.col("p.field").alias("field")).agg(
        F.max(F.col("conflict").cast("int")).alias("dup"), F.count(F.lit(1)).alias("n"),
        F.count("p.v").alias("n_values"), F.sum("p.v").alias("total"))
    a = annual.select("symbol", "year", pairs).select(
        "symbol", "year", F.col("p.field").alias("field"), F.col("p.v").alias("annual"))
    j = q.join(a, ["symbol", "year", "field"], "full")
    base = F.when(F.col("annual") != 0, F.abs("annual")).otherwise(
        F.greatest(F.abs("total"), F.lit(1.0)))
    usable = ((F.col("dup") == 0) & (F.col("n") == 4) & (F.col("n_values") == 4)
              & F.col("annual").isNotNull())
    diff = (F.col("total") - F.col("annual")) / base
    status = (
        F.when(F.col("dup") > 0, "quý trùng")
        .when(F.coalesce("n", F.lit(0)) != 4, "thiếu quý")
        .when(F.col("annual").isNull(), "thiếu số năm")
        .when(F.col("n_values") != 4, "thiếu số quý")
        .when(F.abs(F.col("total") - F.col("annual")) <= tolerance * base, "khớp")
        .otherwise("lệch"))
    return j.select(
        "symbol", "year", "field", F.when(usable, F.col("total")).alias("quarters_sum"),
        "annual", F.when(usable, diff).alias("diff_pct"), status.alias("status"))
