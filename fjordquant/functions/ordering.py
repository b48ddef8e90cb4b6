"""Exact quantiles and ranks of groups of any size.

A ``percentile`` aggregate or a rank window keeps one whole group in one
task.  A cross-section (all symbols of one date or of one top industry) has no
such bound, so the functions here never bring a group together.  Equal values are
collapsed to counts first, values fall into buckets whose order follows the
value order, bucket counts are accumulated, and only inside a bucket are values
sorted.  A window therefore holds the buckets of a group or the distinct values
of one bucket, never the group.  All steps are pure functions of the row,
so a lost executor's work is recomputed to the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTION = 2048  # buckets per doubling of the value
COARSE = 16  # the same where only the buckets of a few positions are read


def order_bucket(v: Column) -> Column:
    """A bucket number that never decreases as ``v`` grows."""
    magnitude = F.floor(F.log2(F.abs(v)) * RESOLUTION) + 1200 * RESOLUTION
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(
        F.signum(v).cast("long") * magnitude
    )


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, total, below): distinct values with their exact position."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", order_bucket(F.col("_v")))
    )
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    buckets = buckets.select(
        *keys,
        "_b",
        (F.sum("_bn").over(upto) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        counts.join(buckets, [*keys, "_b"])
        .withColumn("_below", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))
        .select(*keys, "_v", "_n", "_below", "_total")
    )


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], n_name: str = "n"
) -> DataFrame:
    """Linearly interpolated exact quantiles per group, plus the value count."""
    ranked = value_counts(df, keys, value)
    hi = F.col("_below") + F.col("_n")
    aggs = [F.max("_total").alias(n_name)]
    for name, p in probs.items():
        at = (F.col("_total") - 1) * p
        lo_pos, hi_pos = F.floor(at), F.ceil(at)
        v_lo = F.max(F.when((F.col("_below") <= lo_pos) & (lo_pos < hi), F.col("_v")))
        v_hi = F.max(F.when((F.col("_below") <= hi_pos) & (hi_pos < hi), F.col("_v")))
        frac = F.max(at - lo_pos)
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def with_average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Attach the tie-averaged rank of ``value`` inside ``keys`` (null for null)."""
    ranks = value_counts(df, keys, value).select(
        *keys,
        F.col("_v").alias(value),
        (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name),
    )
    return df.join(ranks, [*keys, value], "left")


def with_share_at_most(
    df: DataFrame, keys: list[str], value: str, name: str, min_values: int = 1
) -> DataFrame:
    """Attach the share of the group's values that are <= the row's own value."""
    shares = value_counts(df, keys, value).select(
        *keys,
        F.col("_v").alias(value),
        F.when(
            F.col("_total") >= min_values, (F.col("_below") + F.col("_n")) / F.col("_total")
        ).alias(name),
    )
    return df.join(shares, [*keys, value], "left")


def grouped_order_stats(df: DataFrame, keys: list[str], value: str,
                        positions: dict[str, Column]) -> DataFrame:
    """Values at given 0-based positions of each group's sorted values.

    A position is a column over ``_total`` (the group's value count).  ``df`` is read
    twice: counts of coarse buckets, combined before the shuffle, tell which bucket holds
    a position, and only the values of those buckets are exchanged and sorted.  The groups
    are few (nodes of an industry tree at the signal dates), so their buckets are sent to
    the rows.
    """
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"),
        F.floor(order_bucket(F.col(value)) / (RESOLUTION // COARSE)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_c").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    buckets = rows.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_cn")).select(
        *keys, "_c", "_cn", (F.sum("_cn").over(upto) - F.col("_cn")).alias("_before"),
        F.sum("_cn").over(Window.partitionBy(*keys)).alias("_total"))

    def holds(low: str, n: str, at: Column) -> Column:
        return (F.col(low) <= at) & (at < F.col(low) + F.col(n))

    hit = F.lit(False)
    for p in positions.values():
        hit = hit | F.coalesce(holds("_before", "_cn", p), F.lit(False))
    # a group whose positions all lie outside keeps its count
    first = F.col("_before") == 0
    inside = Window.partitionBy(*keys, "_c").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = rows.join(F.broadcast(buckets.where(hit | first).drop("_cn")), [*keys, "_c"]).groupBy(
        *keys, "_c", "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_total").alias("_total")
    ).withColumn("_below", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))
    return found.groupBy(*keys).agg(F.max("_total").alias("n_values"), *[
        F.max(F.when(holds("_below", "_n", p), F.col("_v"))).alias(name)
        for name, p in positions.items()])


def reread_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                     n_name: str = "n") -> DataFrame:
    """``grouped_quantiles`` of few groups over a written table, from ``grouped_order_stats``."""
    spots = {}
    for name, p in probs.items():
        at = (F.col("_total") - 1) * p
        spots |= {f"_lo_{name}": F.floor(at), f"_hi_{name}": F.ceil(at)}
    found = grouped_order_stats(df, keys, value, spots)

    def between(name: str, p: float) -> Column:
        at = (F.col("n_values") - 1) * p
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return found.select(*keys, F.col("n_values").alias(n_name),
                        *[between(name, p) for name, p in probs.items()])


def sorted_quantile(s: Column, p: float) -> Column:
    """Interpolated quantile of a short sorted array without nulls (``sort_array`` is
    compiled, unlike ``array_sort`` with its comparator)."""
    pos = (F.size(s) - 1) * F.lit(p)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    return F.when(F.size(s) > 0, F.get(s, lo) + (F.get(s, hi) - F.get(s, lo)) * (pos - lo))
