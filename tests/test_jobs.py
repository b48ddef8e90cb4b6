import datetime as dt
import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from fjordquant.catalog import ENTRIES
from fjordquant.plans import domain as D
from fjordquant.sources import store as STORE
from fjordquant.sources import vendor as V
from fjordquant.streaming import live as L

SF = "/root/testdata/sf0.001"


def test_every_query_has_check_sql():
    assert {n for n, e in ENTRIES.items() if e.sql is None} == set()
    assert set(ENTRIES) <= set(entry_module.queries()) & set(entry_module.oracle_sql())


def test_stream_equals_batch(spark):
    stream = L.drain(L.daily_bars(L.quote_stream(spark, SF)), "update", ["symbol", "time"])
    q = D.quotes(spark, SF)
    order = F.struct("ts", "event_id")
    batch = q.groupBy("symbol", F.to_date("ts").alias("time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    assert stream.count() == batch.count() and stream.exceptAll(batch.select(stream.columns)).isEmpty()


def test_publish_merge_and_partitions(spark, tmp_path):
    cols = "symbol string, time date, open double, high double, low double, close double, volume double"
    old = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0)], cols)
    new = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 2.0, 1.0),
                                 ("B", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 3.0, 1.0)], cols)
    assert {r.symbol: r.close for r in STORE.merge_bars(old, new).collect()} == {"A": 2.0, "B": 3.0}
    assert [r.symbol for r in STORE.refresh_bars(old, new).collect()] == ["A"]
    path = STORE.publish(STORE.merge_bars(old, new), str(tmp_path / "bars"))
    assert STORE.read_bars(spark, path, ["B"], "2024-01-01", ["symbol", "close"]).collect()[0].close == 3.0
    STORE.publish(old, str(tmp_path / "bars"))
    assert [r.close for r in STORE.current(spark, str(tmp_path / "bars")).collect()] == [1.0]
    assert STORE.pointer_of(spark, str(tmp_path / "bars"))[0] == 2
    scores = spark.createDataFrame([("A", 1.0, "2024-01-31"), ("A", 2.0, "2024-02-29")], "symbol string, score double, as_of string")
    out = str(tmp_path / "scores")
    STORE.publish_scores(scores, out)
    STORE.publish_scores(scores.where("as_of = '2024-02-29'").withColumn("score", F.lit(5.0)), out)
    assert sorted(r.score for r in spark.read.parquet(out).collect()) == [1.0, 5.0]
    STORE.export_csv(scores, str(tmp_path / "csv"), ["symbol", "score"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_signature_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (2, "y")], "a int, b string")
    c = spark.createDataFrame([(2, "y"), (1, "x")], "a int, b string")
    sig = [STORE.input_signature(x, ["a", "b"]).first().signature for x in (a, b, c)]
    assert sig[0] == sig[1] != sig[2]


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(canon(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [
    "session_panel", "industry_snapshot", "ttm_snapshot", "annual_ratios", "peer_comparison",
    "macro_impacts", "risk_keyword_hits", "sector_capped_selection"])
def test_queries_equal_their_check_sql(spark, name):
    con = duckdb.connect()
    for t in ("region nation supplier orders lineitem events documents pages benchmark").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = ENTRIES[name].run(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(ENTRIES[name].sql)
    names = [d[0] for d in rel.description]
    want = sorted((tuple(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want


def test_repeated_and_late_items_are_dropped(spark, tmp_path):
    schema = "guid string, ts timestamp"
    batches = [[("a", "2024-01-05 10:00:00"), ("b", "2024-01-05 09:30:00")],
               [("a", "2024-01-05 10:00:00"), ("c", "2024-01-05 08:30:00")],
               # late rows are judged by the watermark that held before the last batch
               [("c", "2024-01-05 08:30:00"), ("late", "2024-01-05 07:30:00"), ("d", "2024-01-05 10:05:00")]]
    for k, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "guid string, ts string")
        part.select("guid", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(
            f"{tmp_path}/in/{k}")
        time.sleep(1.1)  # files are read in the order of their times
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option(
        "maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = L.drain(L.once_per_id(source, "guid", "ts"), "append")
    assert sorted(r.guid for r in out.collect()) == ["a", "b", "c", "d"]


def test_csv_has_a_byte_order_mark_and_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', 1.5), ("Nguyễn", None), ("x;y", 2.0)], "Name string, value double")
    path = str(tmp_path / "csv")
    STORE.export_csv(rows.coalesce(1), path, ["Name", "value"])
    part = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert part.startswith("﻿Name,value".encode())
    back = STORE.read_csv(spark, path, {"name": "string", "value": "double", "unit": "string"})
    assert back.columns == ["name", "value", "unit"]
    assert sorted((r.name, r.value, r.unit) for r in back.collect()) == sorted(
        [('a "b", c', 1.5, None), ("Nguyễn", None, None), ("x;y", 2.0, None)])
    (tmp_path / "hand").mkdir()
    (tmp_path / "hand" / "a.csv").write_text("﻿ Value ,NAME,more\n.,a,1\n7,b,2\n", encoding="utf-8")
    hand = STORE.read_csv(spark, str(tmp_path / "hand"), {"name": "string", "value": "double"})
    assert sorted((r.name, r.value) for r in hand.collect()) == [("a", None), ("b", 7.0)]


def test_only_changed_missing_and_old_results_are_computed_again(spark):
    day = dt.date(2024, 1, 10)
    inputs = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("C", 4), ("D", 5)], "symbol string, v int")
    seen = []

    def compute(rows):
        seen.append(sorted(r.symbol for r in rows.select("symbol").distinct().collect()))
        return rows.groupBy("symbol").agg(F.sum("v").alias("total"))

    marks = STORE.input_signature(inputs, ["v"], ["symbol"]).select("symbol", "signature")
    first = STORE.refresh_results(
        spark.createDataFrame([], "symbol string, total long, signature string, updated_at date"),
        inputs, ["symbol"], ["v"], compute, F.lit(day))
    assert seen == [["A", "B", "C", "D"]] and {r.symbol: r.total for r in first.collect()} == {"A": 3, "B": 3, "C": 4, "D": 5}
    old = F.when(F.col("symbol") == "C", F.lit(day - dt.timedelta(days=8))).otherwise(F.lit(day))
    stored = first.drop("reused").where("symbol <> 'D'").withColumn("updated_at", old)
    changed = inputs.withColumn("v", F.when(F.col("symbol") == "B", 30).otherwise(F.col("v")))
    second = STORE.refresh_results(stored, changed, ["symbol"], ["v"], compute, F.lit(day))
    assert seen[1] == ["B", "C", "D"]
    assert {r.symbol: (r.total, r.reused) for r in second.collect()} == {
        "A": (3, True), "B": (30, False), "C": (4, False), "D": (5, False)}
    assert marks.count() == 4


def test_periods_become_rows_and_last_line_wins(spark):
    wide = spark.createDataFrame(
        [("A", "head", "Assets", 0, None, None), ("A", "x", "X", 1, 1.0, 2.0), ("A", "x", "X", 2, 10.0, None),
         ("A", "y", "Y", 3, None, 4.0)],
        "symbol string, item_id string, item string, line int, `2022` double, `2023` double")
    out = V.reshape_periods(wide, "symbol", ["item"], "line")
    assert out.columns == ["symbol", "period", "x", "y"]
    assert sorted(tuple(r) for r in out.collect()) == [("A", "2022", 10.0, None), ("A", "2023", None, 4.0)]


def test_first_source_with_rows_gives_all_rows(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "symbol string, year int, v int")
    out = V.fallback_chain([("a", make(("A", 2020, 1))), ("b", make(("A", 2023, 2), ("B", 2020, 3), ("B", 2021, 4), ("B", 2022, 5)))],
                           "symbol", "year", 2)
    assert sorted((r.symbol, r.year, r.source) for r in out.collect()) == [
        ("A", 2020, "a"), ("B", 2021, "b"), ("B", 2022, "b")]
