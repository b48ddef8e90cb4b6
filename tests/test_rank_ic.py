"""Rank correlations of scores and forward returns against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd

from fjordquant.catalog import backtest as BT
from fjordquant.operators import evaluation as EV

DAY = dt.date(2020, 1, 3)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_ic_equals_brute_force_with_ties_and_gaps(spark, tmp_path):
    rng = random.Random(2)
    names, rows = ["p", "q"], []
    for day, n in ((DAY, 90), (DAY + dt.timedelta(31), 25), (DAY + dt.timedelta(60), 12)):
        for s in range(n):
            x = [None if rng.random() < 0.1 else round(rng.uniform(0, 100), k) for k in (-1, 6)]
            y = [None if rng.random() < 0.2 else round(rng.gauss(0, 0.1), 2) for _ in range(3)]
            rows.append((day, s % 60, *x, *y))  # a symbol may come twice
    rows.append((None, 1, 1.0, 2.0, 0.1, 0.1, 0.1))
    spark.createDataFrame(
        rows, "as_of date, symbol long, p double, q double, fwd_1m double, fwd_3m double, fwd_6m double"
    ).repartition(5).write.parquet(str(tmp_path / "panel"))
    panel = spark.read.parquet(str(tmp_path / "panel"))
    ic = EV.rank_ic(EV.long_panel(panel, names))
    got = {(r.factor, r.horizon, r.as_of): r for r in ic.collect()}
    want = {}
    for day in {r[0] for r in rows if r[0]}:
        for i, f in enumerate(names):
            for j, h in enumerate((1, 3, 6)):
                both = [(r[2 + i], r[4 + j]) for r in rows if r[0] == day and None not in (r[2 + i], r[4 + j])]
                if len(both) >= 20:
                    x, y = (pd.Series(c).rank() for c in zip(*both))
                    want[f, h, day] = (len(both), np.corrcoef(x, y)[0, 1])
    assert set(got) == set(want) and len(want) >= 6
    for k, (n, c) in want.items():
        assert got[k].n == n and np.isclose(got[k].ic, c, atol=1e-12)
    # a row is exchanged once for each of its values and once for all of their ranks,
    # not for every pair of a factor and a horizon
    moved = [x for x in physical(ic).split("\n") if "Exchange hashpartitioning" in x]
    assert not any("factor" in x and "v#" in x for x in moved) and "SortMergeJoin" not in physical(ic)


def test_portfolios_and_coefficients_read_one_universe(spark, monkeypatch):
    def again(*_):
        raise AssertionError("worked out a second time")

    for name in ("signal_bars", "hist_universe"):
        monkeypatch.setattr(BT, name, again)
    u = spark.createDataFrame(
        [(DAY, 1, "A", DAY, 1.0, 2.0, 3.0, 0.1, 0.2, True)],
        "as_of date, symbol long, icb1 string, as_of_price date, market_cap double, avg_value_20d double, "
        "ret_1m double, roe double, ret_3m double, liquidity_flag boolean")
    bars, sig = BT.base(spark, "nowhere", ("bars", "sums", u))
    assert bars == "bars" and [(r.score, r.upside, r.eligible) for r in sig.collect()] == [(100.0, 0.2, True)]


def test_one_coefficient_ranks_one_pair_of_series(spark, tmp_path):
    rows = [(DAY, s, float(s % 7), float(s % 5), 0.1 * (s % 11), 0.3) for s in range(40)]
    spark.createDataFrame(rows, "as_of date, symbol long, p double, q double, fwd_1m double, fwd_3m double"
                          ).write.parquet(str(tmp_path / "panel"))
    ic = EV.rank_ic(EV.long_panel(spark.read.parquet(str(tmp_path / "panel")), ["p"], [1]))
    assert "fwd_3m" not in physical(ic) and "q#" not in physical(ic)
    row = ic.first()
    x, y = (pd.Series([r[k] for r in rows]).rank() for k in (2, 4))
    assert (row.factor, row.horizon, row.n) == ("p", 1, 40) and np.isclose(row.ic, np.corrcoef(x, y)[0, 1])


def test_equal_ranks_have_no_coefficient(spark):
    # merged partial deviations of one value are not zero, so a quotient of rounding errors came out
    rows = [(f"a{n}", 1, DAY, (n + 1) / 2, float(s)) for n in range(20, 260, 3) for s in range(n)]
    rows += [("d", 1, DAY, float(s), 30.5) for s in range(60)] + [("e", 1, DAY, float(s), float(-s)) for s in range(60)]
    ranks = spark.createDataFrame(rows, "factor string, horizon int, as_of date, rx double, ry double").repartition(7)
    got = EV.rank_ic(ranks).collect()
    assert [r.factor for r in got] == ["e"] and np.isclose(got[0].ic, -1.0)
