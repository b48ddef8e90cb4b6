import corpus_pipeline as P
from pyspark.sql import functions as F


def test_stages_keep_columns_and_drop_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("_row", F.lit(1))
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.count()
        assert 0 < rows <= before, name
        before, docs = rows, spark.createDataFrame(out.collect(), out.schema)
    last = P.tokens(spark, docs, "/root/testdata/sf0.001")
    assert last.count() == before
    assert last.where("ids_sha256 IS NULL OR decoded_sha256 IS NULL").count() == 0


def brute_kept(rows):
    """Rows that stay, by comparing all pairs of word 5-gram sets."""
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    best = {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0, i)
        if sets[i]:
            best[root[i]] = min(best.get(root[i], rank), rank)
    return sorted((r for i, r in enumerate(rows) if not sets[i] or best[root[i]][2] == i), key=str)


def test_near_copies_by_row_with_null_and_repeated_ids(spark):
    text = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    a, b, c, d = (text(x) for x in "abcd")
    rows = [(7, a), (3, a), (7, b), (None, c), (None, c), (None, c + " end"), (9, d), (9, d), (5, None),
            (5, ""), (None, None), (None, a), (None, text("e")), (2, "one two"), (4, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.near_copies(spark, df, "")
    assert got.columns == df.columns
    # of null ids any row of the component may be first
    norm = lambda rs: sorted(((i, (t or "").removesuffix(" end")) for i, t in rs), key=str)
    assert norm(tuple(r) for r in got.collect()) == norm(brute_kept(rows))
