"""Technical state at chosen dates: arrays against the window frames."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from fjordquant.operators import technical as T

DAY = dt.date(2020, 1, 3)
NUMBERS = ["i", "ema12", "ema26", "atr", "avg_gain", "avg_loss", "macd", "signal", "hist", "rsi", "tenkan",
           "kijun", "base_a", "base_b", "chikou", "senkou_a", "senkou_b", "macd_cross_at", "macd_bars",
           "tk_bars", "base_bars", "break_bars", "hist_slope", "rsi_slope", "upper", "lower", "volume_ratio",
           "thickness", "divergence_strength", "total_score"]
WORDS = ["zone", "macd_cross", "tk_cross", "base_cross", "divergence", "rsi_zone", "tk_strength", "twist",
         "chikou_free", "above_zero"]


def _rows():
    rng = random.Random(5)
    rows = []
    for s, n, holes in ((1, 700, 0.0), (2, 300, 0.03), (3, 4, 0.0), (4, 130, 0.3), (5, 1, 0.0), (None, 60, 0.0)):
        p = 50.0
        for k in range(n):
            p = round(p * (1 + rng.gauss(0, 0.02)), 2)
            low, high = sorted((round(p * (1 + rng.gauss(0, 0.01)), 2), p))
            row = [low, high, low, p, float(rng.randrange(1, 900))]
            if rng.random() < holes:  # all prices, or only the first and the last one
                row[:4] = [None] * 4 if rng.random() < 0.5 else [None, high, low, None]
            rows.append((s, DAY + dt.timedelta(k), *row))
    rows.append((2, None, 1.0, 2.0, 1.0, 2.0, 5.0))
    return rows


def test_chosen_bars_have_the_state_of_the_windows(spark):
    bars = spark.createDataFrame(
        _rows(), "symbol long, time date, open double, high double, low double, close double, volume double"
    ).repartition(3)
    days = [DAY + dt.timedelta(k) for k in (0, 3, 40, 118, 119, 131, 200, 261, 299, 480, 699, 5000)]
    wanted = spark.createDataFrame([(s, d) for s in (1, 2, 3, 4, 5, 9) for d in [*days, days[3]]],
                                   "symbol long, time date")
    at = T.with_scores(T.technical_state(bars, wanted=wanted))
    # no sliding frame is left, and the bars are exchanged once
    physical = at._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in physical and physical.count("Exchange hashpartitioning") == 1
    whole = T.with_scores(T.technical_state(bars)).join(wanted.distinct(), ["symbol", "time"])
    keys = ["symbol", "time"]
    got = {(r.symbol, r.time): r for r in at.select(*keys, *NUMBERS, *WORDS).collect()}
    want = whole.select(*keys, *NUMBERS, *WORDS).collect()
    assert len(got) == len(want) == at.count() and len(want) > 25
    assert {w.divergence for w in want} >= {"bullish", "bearish"} or {w.zone for w in want} > {None}
    for w in want:
        g = got[w.symbol, w.time]
        assert [g[c] for c in WORDS] == [w[c] for c in WORDS], (g, w)
        for c in NUMBERS:
            assert (g[c] is None) == (w[c] is None), (c, g, w)
            assert w[c] is None or np.isclose(g[c], w[c], rtol=1e-9, atol=1e-9), (c, g[c], w[c])


def test_chosen_bars_of_many_batches(spark):
    rng = random.Random(8)
    rows = [(s, DAY + dt.timedelta(k), 1.0, 2.0 + s % 3, 1.0, 1.0 + rng.random(), 5.0)
            for s in range(90) for k in range(150 + s)]
    bars = spark.createDataFrame(
        rows, "symbol long, time date, open double, high double, low double, close double, volume double")
    wanted = bars.where(F.dayofmonth("time") == 28).select("symbol", "time")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a task reads several batches
    try:
        got = {(r.symbol, r.time): r.total_score
               for r in T.with_scores(T.technical_state(bars, wanted=wanted)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = T.with_scores(T.technical_state(bars)).join(wanted, ["symbol", "time"]).collect()
    assert len(got) == len(want) == wanted.count()
    assert all(np.isclose(got[w.symbol, w.time], w.total_score, atol=1e-8) for w in want)
