import random

from fjordquant.llm import decontaminate as D

ITEM = "A train leaves at 7 and travels 120 km with Alice and Bob, then Alice pays 35 dollars for the whole ride."
SWAP = "A train leaves at 9 and travels 450 km with Carol and Dave, then Carol pays 12 dollars for the whole ride."
MIXED = "A train leaves at 9 and travels 450 km with Carol and Carol, then Eve pays 12 dollars for the whole ride."
OTHER = "Plain words of a question without any number that asks what the answer to it may be today"


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item long")
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b, sorted((tuple(r) for r in D.report(d, "doc_id", "text", b, "item_id", "text").collect()), key=str)


def test_templates_and_slots(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice("alpha beta the of gamma delta and to".split()) for _ in range(n))
    docs = [(1, f"{filler(50)}. {ITEM} {filler(30)}", 0), (2, SWAP, 0), (3, MIXED, 0), (4, filler(5000), 0),
            (5, None, 0), (6, "", 0), (7, OTHER.upper(), 0), (7, OTHER.upper(), 0), (None, ITEM, 0),
            (8, " ".join(ITEM.split()[:12]), 0), (9, OTHER.replace("any", "a single", 1), 0)]
    d, b, got = run(spark, docs, [(10, ITEM), (11, OTHER), (12, "too short"), (13, None)])
    assert {(r[0], r[1]) for r in got} == {(1, 10), (2, 10), (7, 11), (None, 10)}
    by = {r[0]: r for r in got}
    assert by[1][4] is True and by[2][4] is False and by[2][3] == 1.0
    left = sorted((r.doc_id for r in D.clean(d, "text", b, "item_id", "text").collect()))
    assert left == [3, 4, 5, 6, 8, 9]


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)])[2] == [] and run(spark, [(1, ITEM, 0)], [])[2] == []


def test_all_planted_items_are_found(spark):
    """Documents that hold a whole item, by plain substring, are exactly the reported ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.report(docs, "doc_id", "text", items, "item_id", "text").collect()}
    norm = lambda t: " " + " ".join(t.lower().split()) + " "
    texts = {r.doc_id: norm(r.text) for r in docs.collect()}
    want = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if norm(r.text).strip() in t}
    assert want <= got and len(got - want) <= len(want) // 5


LONG = ("Alice walks 35 dollars worth of road to the mill and then Bob gives 12 dollars to the man of the house "
        "who sells 7 kg of the best flour in town and 90 more loaves of bread")


def test_inserted_or_missing_word_between_repeated_values(spark):
    words = LONG.split()
    more = " ".join(words[:16] + ["really"] + words[16:])
    less = " ".join(words[:18] + words[19:])
    swap = more.replace("35", "44").replace("12", "71").replace("Bob", "Carol").replace("90", "13")
    mixed = " ".join("euros" if i == 3 else w for i, w in enumerate(more.split()))
    _, _, got = run(spark, [(1, more, 0), (2, less, 0), (3, swap, 0), (4, mixed, 0)], [(10, LONG)])
    assert {r[0] for r in got} == {1, 2, 3} and {r[0]: r[4] for r in got}[1] is True


def test_verbatim_copies_in_any_case_and_white_space(spark):
    docs = [(1, ITEM.upper(), 0), (2, ITEM.lower(), 0), (3, ITEM.title(), 0), (4, ITEM.replace(" ", "\n"), 0),
            (5, ITEM.replace(" ", "  "), 0), (6, ITEM.replace(" ", " "), 0), (7, "and so " + ITEM, 0),
            (8, SWAP.replace(" ", " \t\n"), 0), (9, MIXED.upper(), 0)]
    _, _, got = run(spark, docs, [(10, ITEM)])
    assert {r[0] for r in got} == {1, 2, 3, 4, 5, 6, 7, 8}
    assert all(r[2] == 1.0 and r[4] is (r[0] != 8) for r in got)


def test_repeated_items_and_items_without_id(spark):
    items = [(10, ITEM), (10, ITEM), (11, ITEM), (12, LONG), (12, OTHER), (None, OTHER), (None, LONG), (None, None)]
    d, b, got = run(spark, [(1, ITEM, 0), (2, OTHER, 0), (3, "no leak", 0), (4, f"{ITEM} {OTHER}", 0)], items)
    assert [r[:2] for r in got] == sorted([(1, 10), (1, 11), (2, 12), (2, None), (4, 10), (4, 11), (4, 12), (4, None)], key=str)
    assert [r.doc_id for r in D.clean(d, "text", b, "item_id", "text").collect()] == [3]
