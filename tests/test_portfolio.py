"""Fills at the first own open, costs, selling and scenarios of the set-based returns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fjordquant.operators import portfolio as PF

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(8)]


def returns(spark, bars, weights, scenarios, signals):
    frame = spark.createDataFrame(
        [(s, DAYS[i], float(o), float(c)) for s, i, o, c in bars], "symbol string, time date, open double, close double")
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(DAYS)], "time date, idx int")
    targets = spark.createDataFrame(
        [("s", "M", DAYS[i], x, float(w)) for i, x, w in weights],
        "strategy string, freq string, as_of date, symbol string, weight double")
    dates = spark.createDataFrame([(DAYS[i],) for i in signals], "as_of date")
    rows = PF.daily_returns(PF.in_scenarios(targets, scenarios), frame, calendar, dates).collect()
    return {(r["scenario"], DAYS.index(r["time"])): (r["r"], r["traded"]) for r in rows}


def flat(symbol, days, price=100):
    return [(symbol, i, price, price) for i in days]


def test_missing_bar_waits_for_the_first_own_open(spark):
    bars = flat("a", range(8)) + [("b", 0, 100, 100), ("b", 5, 200, 210), ("b", 6, 210, 210)]
    got = returns(spark, bars, [(2, "b", 1.0)], [("base", 1, 0.0)], [2])
    assert [k for _, k in sorted(got)] == [3, 4, 5, 6, 7]
    assert [got["base", k][0] for k in (3, 4, 6, 7)] == [0, 0, 0, 0]
    assert got["base", 5] == (pytest.approx(0.05), 1.0)  # from its own open on, not from the old close


def test_old_weight_is_kept_until_the_own_open_and_costs_fall_there(spark):
    bars = [("a", 0, 100, 100), ("a", 1, 100, 100), ("a", 2, 100, 110), ("a", 5, 121, 130), ("a", 6, 1, 1)]
    got = returns(spark, bars + flat("b", range(8)), [(0, "a", 1.0)],
                  [("base", 1, 0.002), ("double", 1, 0.004)], [0, 3])
    assert got["base", 1] == (pytest.approx(-0.001), 1.0)
    assert got["base", 2][0] == pytest.approx(0.10)
    assert got["base", 4] == (0, 0)            # due, but no bar
    assert got["base", 5] == (pytest.approx(0.10 - 0.001 - 0.001), 1.0)
    assert got["base", 6] == (0, 0)            # sold: a later fall does not matter
    assert got["double", 1][0] == pytest.approx(-0.002)


def test_one_plan_holds_scenarios_of_different_delay(spark):
    bars = [("a", i, 100 + i, 100 + i) for i in range(8)]
    got = returns(spark, bars, [(0, "a", 1.0)], [("base", 1, 0.0), ("late", 2, 0.0)], [0])
    assert ("late", 1) not in got and got["late", 2] == (0, 1.0)
    assert got["base", 2][0] == pytest.approx(102 / 101 - 1)
    assert got["late", 3][0] == got["base", 3][0] == pytest.approx(103 / 102 - 1)


def test_unchanged_weight_costs_nothing(spark):
    got = returns(spark, flat("a", range(8)), [(0, "a", 0.5), (3, "a", 0.5)], [("base", 1, 0.1)], [0, 3])
    assert got["base", 4] == (0, 0)


def test_normal_cdf_expression(spark):
    from statistics import NormalDist

    z = [-9.0, -3.2, -0.5, 0.0, 1.0, 4.5, 30.0, None]
    df = spark.createDataFrame([(x,) for x in z], "z double").select("z", PF.normal_cdf(F.col("z")).alias("p"))
    for row in df.collect():
        assert row.p is None if row.z is None else row.p == pytest.approx(NormalDist().cdf(row.z), abs=1e-12)
