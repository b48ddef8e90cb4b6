"""Exponential smoothing as plain window sums.

The recursion ``E(t) = (1-a) E(t-1) + a x(t)`` unrolls to a weighted sum whose
weights shrink by ``1-a`` per bar.  Inside a block the sum is a running window sum
of ``x(i) / (1-a)^i``; the block before contributes its own total, decayed.  The
block's length follows from ``a``: a power of 8 for which ``(1-a)^-block`` stays
below 1e261 and ``(1-a)^block`` is below 1e-32, so whatever is older than two
blocks lies under the last bit of a double for every ``a``.  The windows run over
one symbol's bars, which the calendar bounds.  No Python worker runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_DECAY = 600.0  # natural logarithm of the largest power inside a block


def block_length(alpha: float) -> int:
    """The largest power of 8 whose decay stays within MOST_DECAY, 1 at least."""
    rate = -math.log1p(-alpha)
    return 8 ** max(0, math.floor(math.log(MOST_DECAY / rate, 8)))


def with_ewm(df: DataFrame, by: list[str], position: str, specs: list[dict]) -> DataFrame:
    """Add smoothed columns; see ``_in_blocks`` for the specs. ``alpha`` lies in (0, 1]."""
    groups: dict[int, list[dict]] = {}
    for s in specs:
        groups.setdefault(block_length(s["alpha"]) if s["alpha"] < 1 else 0, []).append(s)
    for block, own in sorted(groups.items()):
        if block:
            df = _in_blocks(df, by, position, own, block)
        else:  # nothing is carried over
            df = df.withColumns({s["name"]: F.when(
                F.col(position) >= s["start"] + s.get("min_periods", 1) - 1, F.col(s["value"]))
                for s in own})
    return df


def _in_blocks(df: DataFrame, by: list[str], position: str, specs: list[dict], block: int
               ) -> DataFrame:
    """Add smoothed columns of specs that share a block length.

    ``position`` is the 0-based bar number inside ``by``.  Each spec holds
    ``name``, ``value`` (a column without gaps from ``start`` on), ``alpha``,
    ``start`` (position of the first value, which seeds the recursion) and
    ``min_periods``.
    """
    pos = F.col(position)
    inner = pos % block
    work = df.withColumn("_block", F.floor(pos / block))
    terms: dict[str, Column] = {}
    for s in specs:
        decay = 1.0 - s["alpha"]
        weight = F.when(pos == s["start"], F.lit(1.0)).otherwise(F.lit(s["alpha"]))
        terms[f"_t_{s['name']}"] = F.when(
            pos >= s["start"], F.col(s["value"]) * weight * F.pow(F.lit(decay), -inner)
        ).otherwise(0.0)
    work = work.withColumns(terms)
    inside = (
        Window.partitionBy(*by, "_block").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*by).orderBy("_block").rangeBetween(-1, -1)
    sums: dict[str, Column] = {}
    for s in specs:
        sums[f"_s_{s['name']}"] = F.sum(f"_t_{s['name']}").over(inside)
        sums[f"_p_{s['name']}"] = F.sum(f"_t_{s['name']}").over(before)
    work = work.withColumns(sums)
    out: dict[str, Column] = {}
    for s in specs:
        decay = 1.0 - s["alpha"]
        value = F.pow(F.lit(decay), inner) * F.col(f"_s_{s['name']}") + F.pow(
            F.lit(decay), inner + block
        ) * F.coalesce(F.col(f"_p_{s['name']}"), F.lit(0.0))
        exact = F.when(pos == s["start"], F.col(s["value"])).otherwise(value)
        out[s["name"]] = F.when(pos >= s["start"] + s.get("min_periods", 1) - 1, exact)
    work = work.withColumns(out)
    scratch = ["_block"] + [f"_{k}_{s['name']}" for s in specs for k in "tsp"]
    return work.drop(*scratch)
