import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fjordquant.functions import text as X
from fjordquant.functions.ordering import (
    grouped_quantiles, order_bucket, with_average_rank, with_share_at_most)
from fjordquant.functions.smoothing import block_length, with_ewm


def test_smoothing_equals_recursion_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    n = 2 * block_length(0.2) + 300
    x = pd.DataFrame({"s": 1, "i": range(n), "x": rng.normal(size=n).cumsum() + 50})
    out = with_ewm(spark.createDataFrame(x), ["s"], "i", [
        {"name": "a", "value": "x", "alpha": 2 / 10, "start": 0, "min_periods": 9},
        {"name": "b", "value": "x", "alpha": 1 / 14, "start": 25, "min_periods": 1},
    ]).toPandas().sort_values("i")
    want = x.x.ewm(span=9, adjust=False, min_periods=9).mean()
    np.testing.assert_allclose(out.a, want, rtol=1e-12)
    late = x.x.where(x.i >= 25).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(out.b, late, rtol=1e-12)


def test_quantiles_and_ranks_with_one_hot_group(spark):
    rng = np.random.default_rng(5)
    g = np.where(rng.random(6000) < 0.4, 0, rng.integers(1, 40, 6000))
    v = np.round(rng.normal(scale=3, size=6000), 2)
    v[:500] = 0.0
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf)
    got = grouped_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").v.quantile([0.25, 0.9]).unstack()
    np.testing.assert_allclose(got[["a", "b"]], want, atol=1e-9)
    r = with_average_rank(df, ["g"], "v", "r").toPandas()
    np.testing.assert_allclose(r.r, r.groupby("g").v.rank())
    s = with_share_at_most(df, ["g"], "v", "s", 3).toPandas()
    np.testing.assert_allclose(s.s.astype(float), s.groupby("g").v.rank(method="max", pct=True).where(
        s.groupby("g").v.transform("size") >= 3))


def test_buckets_follow_the_value_order(spark):
    vals = sorted([0.0, 1e-300, -1e-300, 1.0, 1.0000001, 2.0, -5.5, -5.4, 1e12, -1e12, 3e-7])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    b = [r[0] for r in df.select(order_bucket(F.col("v"))).collect()]
    assert b == sorted(b)


def test_text_folding_numbers_and_slugs(spark):
    rows = [("Đầu tư Nước ngoài — Ngân hàng",), ("Tiê̂n",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(X.words_only(F.col("t"))).collect()]
    assert got == ["dau tu nuoc ngoai ngan hang", "tien", ""]
    assert df.select(X.node_key(2, F.col("t"))).collect()[2][0] == "2-na"
    nums = spark.createDataFrame([("lãi 1.234,50 và +5 hoặc 1,234.5; mã a12, 007 rồi 1.234.567",)], "t string")
    assert nums.select(X.numbers_in(F.col("t"))).collect()[0][0] == sorted(
        ["1234.5", "+5", "1234.5", "7", "1234567"])
    fmt = spark.createDataFrame([(1234.5,), (None,)], "v double")
    assert [r[0] for r in fmt.select(X.number_vi(F.col("v"), 1)).collect()] == ["1.234,5", "N/A"]
    assert fmt.select(X.percent_vi(F.lit(0.125), sign=True)).first()[0] == "+12,5%"


def test_smoothing_for_any_span(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame({"s": "A", "i": range(5000), "x": rng.random(5000) * 100})
    spans = [1, 2, 3, 5, 9, 26, 60, 200, 500]
    out = with_ewm(spark.createDataFrame(x), ["s"], "i", [
        {"name": f"e{n}", "value": "x", "alpha": 2 / (n + 1), "start": 0} for n in spans])
    got = out.orderBy("i").toPandas()
    for n in spans:
        want = x.x.ewm(span=n, adjust=False).mean()
        assert np.allclose(got[f"e{n}"], want, rtol=1e-11), n


def test_references_and_unicode_space(spark):
    from fjordquant.functions.text import sentences, squeeze, strip_html

    df = spark.createDataFrame([("<p>Caf&eacute; &#272;&#x1F600; &amp;lt; &bogus; A&nbsp;B &lt;</p>", "n\u1ee3\u00a0x\u1ea5u", "Mot.\u00a0Hai")], "h string, t string, s string")
    r = df.select(strip_html(F.col("h")).alias("h"), squeeze(F.col("t")).alias("t"), sentences(F.col("s")).alias("s")).first()
    assert r.h == "Caf\u00e9 \u0110\U0001F600 &lt; &bogus; A B <"
    assert r.t == "no xau" and r.s == ["Mot.", "Hai"]
