"""Steps that grow with the tables: results against brute force, and what the plans shuffle."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from fjordquant.catalog import analysis as AN
from fjordquant.operators import evaluation as EV
from fjordquant.operators import indicators as I
from fjordquant.operators import portfolio as PF
from fjordquant.plans import domain as D

DAY = dt.date(2020, 1, 3)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_rolling_beta_equals_brute_force_without_sliding_frames(spark):
    rng = random.Random(7)
    rows = [(s, DAY + dt.timedelta(7 * k), rng.gauss(0, 0.1), 0.0 if s == 2 else rng.gauss(0, 0.02))
            for s, n in ((1, 61), (2, 40), (3, 5), (4, 8)) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol long, week date, r double, rb double")
    rolled = I.rolling_beta(df, 30)
    assert "-29, currentrow" not in plan(rolled)
    got = {(r.symbol, r.week): r for r in rolled.collect()}
    assert len(got) == len(rows)
    for s in (1, 2, 3, 4):
        own = [x for x in rows if x[0] == s]
        for k, x in enumerate(own):
            part = own[max(0, k - 29):k + 1]
            r = got[s, x[1]]
            assert r.n_weeks == len(part)
            a, b = np.array([p[2] for p in part]), np.array([p[3] for p in part])
            if len(part) < 26 or b.max() == b.min():
                assert r.beta is None
            else:
                assert np.isclose(r.beta, np.cov(a, b)[0, 1] / b.var(ddof=1), rtol=1e-9)


def _bars(spark, days=160, symbols=4):
    rng = random.Random(3)
    rows = [(s, DAY + dt.timedelta(k), *[rng.uniform(5, 9) for _ in range(2)])
            for s in range(symbols) for k in range(days) if rng.random() < 0.8]
    return rows, spark.createDataFrame(rows, "symbol long, time date, open double, close double")


def test_forward_returns_shuffle_only_asked_bars(spark):
    rows, bars = _bars(spark)
    days = sorted({r[1] for r in rows})
    cal = spark.createDataFrame(list(zip(days, range(len(days)))), "time date, idx int")
    at = [days[3], days[20], days[-2]]
    scores = spark.createDataFrame([(a, s) for a in at for s in range(5)], "as_of date, symbol long")
    df = EV.market_forward_returns(scores, bars, cal)
    assert plan(df.select("*")).split("== Physical Plan ==")[1].count("hashpartitioning(symbol") == 0
    opens = {(r[0], days.index(r[1])): r[2] for r in rows}
    got = df.collect()
    assert len(got) == 15
    for r in got:
        i = days.index(r.as_of) + 1
        for h, v in ((21, r.fwd_1m), (63, r.fwd_3m), (126, r.fwd_6m)):
            a, b = opens.get((r.symbol, i)), opens.get((r.symbol, i + h))
            assert (v is None) if a is None or b is None else np.isclose(v, b / a - 1)


def test_portfolio_moves_share_the_partitioning_of_symbols(spark):
    rows, bars = _bars(spark)
    days = sorted({r[1] for r in rows})
    cal = spark.createDataFrame(list(zip(days, range(len(days)))), "time date, idx int")
    dates = spark.createDataFrame([(days[5],), (days[60],)], "as_of date")
    targets = PF.in_scenarios(PF.named(spark.createDataFrame(
        [(days[5], 0, 0.5), (days[5], 1, 0.5), (days[60], 1, 1.0)],
        "as_of date, symbol long, weight double"), "x"), [("base", 1, 0.0025)])
    moves = PF.weight_moves(targets, bars, cal, dates)
    physical = plan(moves).split("== Physical Plan ==")[1]
    # neither the bars of a schedule nor the legs are exchanged again
    assert "hashpartitioning(freq" not in physical and "hashpartitioning(scenario" in physical
    assert sum("hashpartitioning(scenario" in x and "symbol" in x for x in physical.split("\n")) == 0
    total = moves.agg(F.sum("traded")).first()[0]
    assert np.isclose(total, 2.0)  # bought 0.5 and 0.5, sold 0.5, bought 0.5 more


def test_statements_come_from_one_scan(spark, monkeypatch):
    scans, sums = [], D.quarter_sums
    monkeypatch.setattr(D, "quarter_sums", lambda *a: scans.append(a) or sums(*a))
    bars = AN.signal_bars(spark, "/root/testdata/sf0.001")
    AN.hist_valuation(spark, "/root/testdata/sf0.001", bars)
    assert len(scans) == 1
