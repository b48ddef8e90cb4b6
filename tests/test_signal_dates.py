"""Steps over all symbols of all signal dates: results against brute force, and what they exchange."""

import datetime as dt
import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from fjordquant.catalog import analysis as AN
from fjordquant.functions import ordering as O
from fjordquant.operators import analysis as A
from fjordquant.operators import peers as PE
from fjordquant.operators import pit as P
from fjordquant.operators import valuation as V
from fjordquant.session import SETTLING, settle

DAY = dt.date(2020, 1, 3)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _values():
    rng = random.Random(4)
    rows = [(g, round(rng.gauss(0, 3), 1)) for g in range(3) for _ in range(60 * g + 1)]
    return rows + [(1, None), (5, None), (2, 0.0), (2, -1e6), (2, 1e-9), (None, 1.0)]


def test_order_statistics_read_only_the_buckets_they_need(spark):
    df = spark.createDataFrame(_values(), "g int, v double")
    t = F.col("_total")
    spots = {"a": F.floor((t - 1) * 0.25), "b": F.floor((t - 2) * 0.9) + 1, "out": t + 3, "neg": t * 0 - 1}
    got = {r.g: r for r in O.grouped_order_stats(df, ["g"], "v", spots).collect()}
    quantiles = {r.g: r for r in O.reread_quantiles(df, ["g"], "v", {"p": 0.5, "q": 0.9}, "k").collect()}
    assert set(got) == set(quantiles) == {0, 1, 2}
    for g, r in got.items():
        own = sorted(v for k, v in _values() if k == g and v is not None)
        b = math.floor((len(own) - 2) * 0.9) + 1
        assert r.n_values == quantiles[g].k == len(own) and r.out is None and r.neg is None
        assert r.a == own[math.floor((len(own) - 1) * 0.25)]
        assert r.b == (own[b] if 0 <= b < len(own) else None)
        assert np.allclose([quantiles[g].p, quantiles[g].q], np.quantile(own, [0.5, 0.9]))
    # rows meet their buckets without an exchange, and only counts and picked values move
    assert "BroadcastHashJoin" in physical(O.grouped_order_stats(df, ["g"], "v", spots))
    assert "SortMergeJoin" not in physical(O.grouped_order_stats(df, ["g"], "v", spots))


def test_prices_of_signal_dates_keep_the_partitioning_of_symbols(spark):
    rng = random.Random(3)
    rows = [(s, DAY + dt.timedelta(k), float(k)) for s in range(6) for k in range(200) if rng.random() < 0.2]
    dates = [DAY + dt.timedelta(k) for k in (28, 57, 88, 150)]
    panel = spark.createDataFrame(rows, "symbol long, time date, price double").repartition("symbol")
    out = P.prices_as_of(panel, spark.createDataFrame([(x,) for x in dates], "as_of date"))
    assert "_month" not in "".join(x for x in physical(out).split("\n") if "hashpartitioning" in x)
    got = {(r.as_of, r.symbol): (r.price, r.as_of_price) for r in out.collect()}
    want = {}
    for x in dates:
        for s in range(6):
            seen = [r for r in rows if r[0] == s and x - dt.timedelta(30) < r[1] <= x]
            if seen:
                want[x, s] = max((r[1], r[2]) for r in seen)[::-1]
    assert got == want


def _universe(spark, n=60):
    rng = random.Random(9)
    rows = []
    for s in range(n):
        roe = rng.uniform(0.05, 0.4)
        rows.append((DAY, s, "A", f"A{s % 2}", f"A{s % 2}{s % 3}", "Z", s % 11 != 0, round(1 + 6 * roe + rng.gauss(0, 0.3), 1),
                     roe, 8.0, "x", 1.0, 1.0, 1.0))
    return rows, spark.createDataFrame(
        rows, "as_of date, symbol long, icb1 string, icb2 string, icb3 string, icb4 string, liquidity_flag boolean, "
        "pb double, roe double, pe double, company_type string, ev_ebitda double, net_margin double, ni_growth double")


def test_regression_without_the_symbol_itself_equals_brute_force(spark):
    rows, u = _universe(spark)
    fit = PE.pb_roe_regression(u, PE.peer_levels(u))
    assert all("node" not in keys for keys in re.findall(r"SortMergeJoin \[(.*?)\]", physical(fit)))
    got = {r.symbol: r for r in fit.collect()}
    clean = [r for r in rows if r[6]]
    assert len(got) > 40
    for r in rows:
        peers = [c for c in clean if c[5] == r[5] and c[1] != r[1] and -0.2 < c[8] < 0.6]
        x, y = np.array([c[8] for c in peers]), np.array([c[7] for c in peers])
        slope, cut = np.polyfit(x, y, 1)
        g = got[r[1]]
        assert g.n_fit == len(peers)
        want = np.clip(cut + slope * r[8], *np.quantile(y, [0.25, 0.9]))
        assert np.isclose(g.slope, slope, rtol=1e-6) and np.isclose(g.pb_target, want, rtol=1e-6), (g, want)


def test_blend_and_dcf_equal_a_loop_without_folds(spark):
    rng = random.Random(6)
    names = [f"{m}_{sc}" for m in V.METHODS for sc in V.SCENARIOS]
    rows = []
    for k in range(300):
        row = [["NON_FINANCIAL", "BANK", "INSURANCE"][k % 3], 50.0]
        for _ in V.METHODS:
            base = rng.uniform(5, 200)
            row += [None] * 3 if rng.random() < 0.3 else [base * 0.8, base, base * rng.choice([1.2, -1.0, 1.3])]
        rows.append((k, *row))
    df = spark.createDataFrame(rows, "k int, company_type string, price double, " + ", ".join(f"{n} double" for n in names))
    out = V.blend(df)
    for r in out.collect():
        weights = V.S.METHOD_WEIGHTS[r.company_type]
        good = [(m, weights[m], [r[f"{m}_{sc}"] for sc in V.SCENARIOS]) for m in V.METHODS if weights.get(m, 0) > 0]
        good = [g for g in good if all(v is not None and v > 0 for v in g[2])]
        if len(good) >= 3:
            med = np.median([g[2][1] for g in good])
            good = [g for g in good if med / 2.5 <= g[2][1] <= med * 2.5]
        assert r.n_methods == len(good) and [x["key"] for x in r.usable] == [g[0] for g in good]
        mass = sum(g[1] for g in good)
        for j, sc in enumerate(V.SCENARIOS):
            want = sum(g[2][j] * g[1] for g in good) / mass if good else None
            assert (r[f"target_{sc}"] is None) == (want is None)
            assert want is None or abs(r[f"target_{sc}"] - want) <= 50.0 + 1e-6  # rounded to hundreds
        bases = [g[2][1] for g in good]
        assert (r.dispersion is None) == (len(bases) < 2)
        assert len(bases) < 2 or np.isclose(r.dispersion, max(bases) / min(bases))
    plain = spark.range(1).select(F.lit(3.0).alias("fcff3"), F.lit(1.0).alias("debt"), F.lit(2.0).alias("cash"),
                                  F.lit(0.0).alias("short_investments"), F.lit(0.0).alias("minority_interest"),
                                  F.lit(2.0).alias("shares"))
    dcf = plain.select(V._dcf_value(F.lit(0.12), F.lit(0.1)).alias("v"))
    assert "aggregate(" not in physical(dcf)
    f, pv, gt, n = 3.0, 0.0, V.S.TERMINAL_GROWTH, V.S.DCF_YEARS
    for t in range(1, n + 1):
        f *= 1 + 0.1 + (gt - 0.1) * (t - 1) / (n - 1)
        pv += f / 1.12 ** t
    assert np.isclose(dcf.first().v, (pv + f * (1 + gt) / (0.12 - gt) / 1.12 ** n + 1.0) / 2.0)


def test_settled_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        return {f.toString() for f in (disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size()))
                if "shuffle_" in f.toString()}

    before, settings = files(), {k: spark.conf.get(k, None) for k in SETTLING}
    df = spark.range(5000).withColumn("g", F.col("id") % 97).groupBy("g").count()
    out = settle(df)
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 97
    assert {k: spark.conf.get(k, None) for k in SETTLING} == settings


def test_past_scores_are_written_step_by_step(spark, monkeypatch):
    written = []
    monkeypatch.setattr(AN, "settle", lambda df: written.append(df.columns) or df)
    bars = spark.createDataFrame([], "symbol long, time date, open double, high double, low double, close double, "
                                 "volume double")
    u = spark.createDataFrame([], "as_of date, symbol long, icb1 string, icb2 string, icb3 string, icb4 string, "
                              "liquidity_flag boolean, as_of_price date")
    monkeypatch.setattr(AN, "hist_valuation", lambda *a: (a[3], spark.createDataFrame(
        [], "as_of date, symbol long, " + ", ".join(f"{c} double" for c in A.VALUED))))
    monkeypatch.setattr(A, "sector_view", lambda u, index, impacts, levels: levels)
    monkeypatch.setattr(A, "score_universe", lambda *a: a)
    AN.hist_scores(spark, "nowhere", bars, u, bars)
    assert [c[0:2] for c in written] == [["as_of", "symbol"], ["symbol", "as_of_price"], ["as_of", "symbol"]]
    assert "past" not in written[2] and "upside" in written[2]
