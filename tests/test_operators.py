import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fjordquant.operators import cleaning as C
from fjordquant.operators import filings as FI
from fjordquant.operators import indicators as I
from fjordquant.operators import news as N
from fjordquant.operators import pit as P
from fjordquant.operators import portfolio as PF
from fjordquant.operators import scoring as SC
from fjordquant.operators import technical as T
from fjordquant.operators import ttm as TTM


def bars(spark, closes, symbol="A"):
    days = pd.bdate_range("2024-01-01", periods=len(closes))
    return spark.createDataFrame(pd.DataFrame({
        "symbol": symbol, "time": days.date, "open": closes, "high": [c * 1.01 for c in closes],
        "low": [c * 0.99 for c in closes], "close": closes, "volume": 1000.0}))


def test_clean_bars_integer_dates_and_duplicates(spark):
    raw = spark.createDataFrame(
        [("aaa", 20240105, 10.0, 9.0, 11.0, 10.5, 100, 0), ("AAA", 20240105, 10.0, 12.0, 9.0, 11.0, 5, 1),
         ("AAA", 20240104, 10.0, 12.0, 9.0, 0.0, 5, 2)],
        "`<Ticker>` string, `<DTYYYYMMDD>` long, `<Open>` double, `<High>` double, `<Low>` double, "
        "`<Close>` double, `<Volume>` long, ordinal int")
    rows = C.clean_bars(raw, "ordinal").collect()
    assert len(rows) == 1
    assert rows[0].time == dt.date(2024, 1, 5) and rows[0].close == 11.0 and rows[0].low == 9.0


def test_flat_series_has_rsi_100_and_no_divergence(spark):
    df = I.oscillators(bars(spark, [10.0] * 40)).orderBy("i").toPandas()
    assert df.rsi.iloc[:14].isna().all() and (df.rsi.iloc[14:] == 100.0).all()
    assert (df.macd.dropna().abs() < 1e-9).all()


def test_swings_equal_a_loop(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=300).cumsum(), 1) + 100
    out = I.with_position(bars(spark, list(x))).withColumn("s", I.swing("close")).orderBy("i").toPandas()
    want = []
    for i in range(len(x)):
        w = x[i - 5:i + 6] if 5 <= i < len(x) - 5 else None
        if w is not None and w[5] == w.max() and w.argmax() == 5:
            want.append("H")
        elif w is not None and w[5] == w.min() and w.argmin() == 5:
            want.append("L")
        else:
            want.append(None)
    assert [None if pd.isna(v) else v for v in out.s] == want


def test_technical_state_needs_no_future(spark):
    rng = np.random.default_rng(2)
    x = list(np.exp(rng.normal(scale=0.02, size=200).cumsum()) * 50)
    cols = ["macd_cross", "macd_bars", "zone", "tk_cross", "break_bars", "divergence", "total_score"]
    full = T.with_scores(T.technical_state(bars(spark, x))).where("i = 159").select(*cols).first()
    cut = T.with_scores(T.technical_state(bars(spark, x[:160]))).where("i = 159").select(*cols).first()
    assert full == cut


def test_disclosure_dates(spark):
    rows = [("A", 2023, 0, None), ("A", 2024, 1, None), ("A", 2024, 4, None),
            ("A", 2024, 2, dt.date(2024, 7, 20)), ("A", 2024, 3, dt.date(2024, 9, 1))]
    df = spark.createDataFrame(rows, "symbol string, year int, quarter int, published_at date")
    got = {(r.year, r.quarter): r.available_from for r in P.annotate(df).collect()}
    assert got == {
        (2023, 0): dt.date(2024, 4, 1), (2024, 1): dt.date(2024, 5, 15), (2024, 4): dt.date(2025, 3, 1),
        (2024, 2): dt.date(2024, 7, 21), (2024, 3): dt.date(2024, 11, 14)}


def quarter_rows(spark, rows):
    return spark.createDataFrame(
        rows, "symbol string, year int, quarter int, net_income_parent double, net_income double, "
        "equity double, published_at date")


def test_ttm_blocks_gaps_and_conflicts(spark):
    ok = [("A", 2023 + i // 4, i % 4 + 1, 10.0 * (i + 1), 1.0, 100.0, None) for i in range(6)]
    gap = [("B", *r[1:]) for r in ok if r[1:3] != (2023, 4)]
    dup = [("C", *r[1:]) for r in ok] + [("C", 2024, 1, 999.0, 1.0, 100.0, None)]
    same = [("D", *r[1:]) for r in ok] + [("D", 2024, 1, 50.0, 1.0, 100.0, None)]
    d = TTM.dedupe_quarters(quarter_rows(spark, ok + gap + dup + same),
                            ["net_income_parent", "net_income", "equity", "published_at"])
    out = {(r.symbol, r.q): r for r in TTM.with_ttm(d, ["net_income_parent"], ["equity"]).collect()}
    q = 2023 * 4 + 3
    assert out[("A", q)].net_income_parent_ttm == 100.0
    assert out[("A", q + 1)].equity_avg_5 == 100.0 and out[("A", q)].equity_avg_5 is None
    assert not any(k[0] == "B" for k in out)
    assert [k for k in out if k[0] == "C"] == [("C", q)]
    assert ("D", q + 2) in out


def test_capped_selection_equals_the_greedy_loop(spark):
    random.seed(4)
    day = [(dt.date(2024, 1, 31), f"S{i:03d}", random.choice("XYZ"), random.random() < 0.8,
            round(random.random(), 1), round(random.random(), 2), float(i)) for i in range(80)]
    df = spark.createDataFrame(day, "as_of date, symbol string, icb1 string, eligible boolean, "
                                    "score double, upside double, avg_value_20d double")
    got = [r.symbol for r in PF.select_top(df, 10).orderBy("rank").collect()]
    pool = sorted((r for r in day if r[3]), key=lambda r: (-r[4], -r[5], -r[6], r[1]))
    want, count = [], {}
    for r in pool:
        if count.get(r[2], 0) < 3 and len(want) < 10:
            want.append(r[1])
            count[r[2]] = count.get(r[2], 0) + 1
    assert got == want


def test_rating_moves_one_notch_and_low_confidence_watches(spark):
    rows = [("a", 0.15, 75.0, "CAO"), ("b", 0.25, 80.0, "CAO"), ("c", -0.2, 30.0, "CAO"),
            ("d", 0.25, 35.0, "TRUNG BÌNH"), ("e", 0.25, 90.0, "THẤP")]
    df = spark.createDataFrame(rows, "s string, upside double, score double, confidence string")
    for g in ("macro", "sector", "quality", "growth", "valuation", "technical", "sentiment"):
        df = df.withColumn(f"score_{g}", F.lit(None).cast("double"))
    got = {r.s: r.rating for r in SC.with_rating(df).collect()}
    assert got == {"a": "MUA", "b": "MUA", "c": "BÁN", "d": "KHẢ QUAN", "e": "THEO DÕI"}


def test_company_matching_with_ambiguous_tickers(spark):
    news = spark.createDataFrame([
        (1, "Giá GAS tăng mạnh hôm nay", ""), (2, "Cổ phiếu GAS tăng trần", ""),
        (3, "Lợi nhuận FPT vượt kế hoạch", ""), (4, "Hòa Phát mở rộng nhà máy", ""),
        (5, "Công ty Vinamilk (VNM) chia cổ tức", ""), (6, "(HOSE: HPG) niêm yết thêm", ""),
    ], "guid int, title string, body string")
    firms = spark.createDataFrame([
        (1, "GAS", "PV Gas", "Tổng công ty Khí"), (2, "FPT", "FPT", "Công ty cổ phần FPT"),
        (3, "HPG", "Hòa Phát", "Tập đoàn Hòa Phát"), (4, "VNM", "Vinamilk", "Công ty Sữa"),
    ], "symbol int, code string, brand string, name string")
    got = {(r.guid, r.symbol): r.reason for r in N.match_companies(news, firms).collect()}
    assert got == {
        (2, 1): "mã được nêu kèm ngữ cảnh chứng khoán", (3, 2): "mã cổ phiếu xuất hiện độc lập",
        (4, 3): "khớp thương hiệu không dấu", (5, 4): "mã trong ngoặc sau tên doanh nghiệp",
        (6, 3): "mã sàn trong ngoặc"}


def test_filing_sections_opinion_and_risks(spark):
    text = ("Ý kiến của kiểm toán viên: ý kiến ngoại trừ. Bảng cân đối kế toán ở đây. "
            "Thuyết minh: có nợ xấu; và tranh chấp.\nThuyết minh lần hai.")
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    s = {r.section: r.body for r in FI.sections(docs).collect()}
    assert s["bang_can_doi"] == "Bảng cân đối kế toán ở đây."
    assert s["thuyet_minh"].startswith("Thuyết minh: có nợ xấu") and "lần hai" not in s["thuyet_minh"]
    o = FI.audit_opinion(docs).first()
    assert (o.opinion, o.evidence, o.scanned) == ("ngoại trừ", "ý kiến ngoại trừ", True)
    assert sorted(r.keyword for r in FI.risk_hits(docs).collect()) == ["nợ xấu", "tranh chấp"]


def test_policy_patterns_are_unicode_aware(spark):
    df = spark.createDataFrame([("Luật Đất đai mới",), ("Luật sư nói gì",), ("Giá vàng lên",), ("abc",)], "t string")
    got = [r[0] for r in df.select(N.classify(F.col("t"), F.lit(""))).collect()]
    assert got == [N.CATEGORY_POLICY, N.CATEGORY_OTHER, N.CATEGORY_MARKET, N.CATEGORY_OTHER]


def test_as_of_attach_takes_the_newest_on_or_before(spark):
    ev = spark.createDataFrame([("A", dt.date(2024, 1, 10), 1), ("A", dt.date(2024, 2, 10), 2)],
                               "symbol string, seen date, v int")
    d = spark.createDataFrame([("A", dt.date(2024, 1, 9)), ("A", dt.date(2024, 1, 10)), ("A", dt.date(2024, 3, 1))],
                              "symbol string, as_of date")
    out = P.attach_as_of(d, ev, ["symbol"], "as_of", "seen", ["v"]).orderBy("as_of").collect()
    assert [r.v for r in out] == [None, 1, 2]
