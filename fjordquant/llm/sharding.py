"""Rendezvous (highest random weight) hashing of records over weighted shards.

Every shard draws a uniform number from (record key, shard) and scores
``-ln(u) / weight``; the smallest score wins.  A shard is chosen with a
probability in proportion to its weight, and a shard that is added can only
take records over, because the scores of the others do not change.

Edge cases: a null key hashes the row's text instead (null text: empty), so a
block of keyless rows still spreads; repeated rows get the same shard and slots
of their own; an empty table gives an empty result; a shard of weight 0 gets
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant.llm.common import fresh
from fjordquant.session import materialise

SLOT_BUCKETS = 1024  # ranges a shard is numbered in; each is sorted by itself


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard number for ``key`` (a long) as an int column."""
    if not any(w > 0 for w in weights):
        raise ValueError("one weight must be positive")

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / weight).alias("score"), F.lit(shard).alias("shard"))

    scored = [score(s, w) for s, w in enumerate(weights) if w > 0]
    best = scored[0] if len(scored) == 1 else F.least(*scored)
    return best["shard"].cast("int")


def assign(df: DataFrame, key: str, text: str, weights: Sequence[float],
           grown_weights: Sequence[float] | None = None, digest: Sequence[Column] = (),
           ) -> DataFrame:
    """``key``, the ``digest`` columns, shard, slot and grown_shard of every row.

    Slots are gapless from 0 inside a shard.  They come from counts: rows are
    numbered inside SLOT_BUCKETS ranges of a shard, and the ranges' counts (a
    table of a fixed size) give each range its start, so no task ever holds a
    shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    stable = F.when(F.col(key).isNull(), F.xxhash64(body, F.lit("no key"))).otherwise(
        F.xxhash64(F.col(key)))
    shard, grown, slot = fresh(df, "shard", "grown_shard", "slot")
    hashed, bucket = fresh(df.select(*digest) if digest else df, "_hash", "_bucket")
    rows = df.select(F.col(key), *digest, stable.alias(hashed))
    rows = rows.select(
        *[c for c in rows.columns if c != hashed],
        rendezvous_shard(F.col(hashed), weights).alias(shard),
        (rendezvous_shard(F.col(hashed), grown_weights) if grown_weights
         else F.lit(None).cast("int")).alias(grown),
        F.pmod(F.xxhash64(F.col(hashed), F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int")
        .alias(bucket),
        F.col(hashed))
    rows = materialise(rows)
    counts = rows.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, bucket,
                           F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, bucket).orderBy(hashed)
    return (
        rows.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, [shard, bucket])
        .withColumn(slot, (F.col("_start") + F.col("_at")).cast("long"))
        .drop("_start", "_at", bucket, hashed)
    )
