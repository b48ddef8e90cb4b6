import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fjordquant.llm import langid as L

SF = "/root/testdata/sf0.01"


def folded(text):
    table = L.symbol_table()
    out = []
    for s in (int(table[ord(c)]) for c in text or ""):
        if s or (out and out[-1]):
            out.append(s)
    if out and out[-1]:
        out.append(0)
    return out


def brute_grams(text):
    s = [0, 0, 0] + folded(text)
    return [tuple(s[i - 3:i + 1]) for i in range(3, len(s))]


def code(gram):
    return gram[0] << 18 | gram[1] << 12 | gram[2] << 6 | gram[3]


def test_grams_equal_brute_force():
    texts = ["Hello, world! 12", "", None, "é", "  a  b ", "ABC", "1 2", "ñandú\nx"]
    codes, first = L.gram_codes(pa.array(texts))
    for i, t in enumerate(texts):
        assert codes[first[i]:first[i + 1]].tolist() == [code(g) for g in brute_grams(t)], t


def test_probabilities_sum_to_one_and_match_the_formula():
    counts = Counter(g for t in ["abab abba", "abcd", "aab ba"] for g in brute_grams(t))
    grams = sorted(counts, key=code)
    model = L.kneser_ney(["x"], [(np.array([code(g) for g in grams], np.uint32),
                                  np.array([counts[g] for g in grams]))])

    def p(gram, order=4):
        if order == 0:
            return 1 / 64
        types = {g[4 - order:] for g in counts} if order == 4 else None
        if order == 4:
            table = counts
        else:
            longer = {g[-(order + 1):] for g in counts}
            table = Counter(g[1:] for g in longer)
        d = L.discount(np.array(list(table.values())))
        own = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        rest = p(gram[1:], order - 1)
        if not total:
            return rest
        del types
        return max(table.get(gram, 0) - d, 0) / total + d * len(own) / total * rest

    probe = [(0, 0, 1, 2), (1, 2, 1, w := 2), (1, 2, 3, 4), (5, 6, 7, 8), (0, 0, 0, 1)]
    for g in probe:
        got = model.entropies(np.array([code(g)], np.uint32), np.array([0, 1]))[0, 0]
        assert math.isclose(got, -math.log(p(g)), rel_tol=1e-4), g
    every = np.array([code((0, 0, 1, w)) for w in range(64)], np.uint32)
    total = np.exp(-model.entropies(every, np.arange(65))[0]).sum()
    assert math.isclose(total, 1, rel_tol=1e-3)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs, "doc_id", "text", "lang").where(L.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, None, "en", 1), (3, "123 !!", "fr", 1),
            (None, "le chat et le chien", None, 1), (4, "le chat et le chien", "fr", 1),
            (1, "the cat and the dog", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.text): (r.lang_pred, r.accepted) for r in
           L.identify(df, "doc_id", "text", "lang").collect()}
    assert got[(2, None)] == ("und", False) and got[(3, "123 !!")] == ("und", False)
    assert L.identify(df.limit(0), "doc_id", "text", "lang").count() == 0
    none = L.identify(df.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang")
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_rare_language_is_calibrated_or_kept(spark, monkeypatch):
    """A language that a plain sample would miss is not measured against a mean of 0."""
    rng = random.Random(3)
    words = {x: ["".join(rng.choice(s) for _ in range(rng.randint(2, 8))) for _ in range(400)]
             for x, s in (("aa", "abcdefghi"), ("zz", "nopqrstuvw"))}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(60)), x)
            for i, x in enumerate(["aa"] * 700 + ["zz"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for least in (200, 0):
        monkeypatch.setattr(L, "CALIBRATION_ROWS", 10)
        monkeypatch.setattr(L, "CALIBRATION_LEAST", least, raising=False)
        got = L.identify(df, "doc_id", "text", "lang").where("lang = 'zz'").collect()
        assert len(got) == 30 and all(r.lang_pred == "zz" and r.accepted for r in got), least
    sample = [("aa", "aa", 9.0, 1.5, 100)] * 50
    assert L.calibrate(sample).accepts("zz", np.array([2.9]), np.array([300])).all()
    assert not L.calibrate(sample).accepts("aa", np.array([2.9]), np.array([300])).any()


def test_final_model_counts_all_training_rows(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} word", "aa") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, _ = L.train(df, "doc_id", "text", "lang")
    texts = [r.text for r in df.where(~L.held_out(F.col("doc_id"))).collect()]
    assert model.keys.tolist() == sorted({code(g) for t in texts for g in brute_grams(t)})


def test_every_training_row_calibrates(spark, monkeypatch):
    """Limits and scores rest on all labelled rows, whichever side computes them."""
    rng = random.Random(5)
    words = {x: ["".join(rng.choice(s) for _ in range(rng.randint(2, 8))) for _ in range(60)]
             for x, s in (("aa", "abcdefghi"), ("bb", "efghijklm"))}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(1, 12))), x)
            for i, x in enumerate(["aa", "bb"] * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = df.where(~L.held_out(F.col("doc_id"))).count()
    seen, calibrate = [], L.calibrate
    monkeypatch.setattr(L, "calibrate", lambda sample: seen.append(len(sample)) or calibrate(sample))
    _, driver = L.train(df, "doc_id", "text", "lang")
    assert seen == [n]
    monkeypatch.setattr(L, "CALIBRATION_ROWS", n - 1)
    _, spread = L.train(df, "doc_id", "text", "lang")
    assert seen == [n]
    assert np.allclose(driver.edges, spread.edges) and np.allclose(driver.share, spread.share)
    for x in ("aa", "bb"):
        assert math.isclose(driver.mean[x], spread.mean[x], rel_tol=1e-9)
        assert math.isclose(driver.limit[x], spread.limit[x], rel_tol=1e-9)


def test_workers_hold_small_pieces(monkeypatch):
    """The arrays of a task do not grow with its batch beyond the batch itself."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["aa"] * len(texts))],
                                       ["text", "lang"])
    seen = []

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            seen.append(run)
            return self

        def groupBy(self, *names):
            return self

        def agg(self, *sums):
            return self

    class Sum:
        def __init__(self, name):
            pass

        def alias(self, name):
            return name

    monkeypatch.setattr(L.F, "sum", Sum)
    L.count_grams(Rows())
    L.symbol_table()
    tracemalloc.start()
    out = list(seen[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    codes = L.gram_codes(batch.column(0))[0]
    keys, n = np.unique(codes, return_counts=True)
    assert out[0].column("gram").to_numpy().tolist() == keys.tolist()
    assert out[0].column("n").to_numpy().tolist() == n.tolist()
    assert peak < 30e6, peak


def test_models_of_the_folds_leave_the_executors(spark, monkeypatch):
    rows = [(i, f"word{'abcdefgh'[i % 8]} other", "aa") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast",
                        lambda value: made.append(broadcast(value)) or made[-1])
    L.train(df, "doc_id", "text", "lang")
    assert len(made) == L.FOLDS
    assert not any(b._jbroadcast.isValid() for b in made)
