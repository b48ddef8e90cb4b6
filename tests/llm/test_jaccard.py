import random
import re

from pyspark.sql import functions as F

from fjordquant.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, percent=90):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3
                    else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = find(i)
            first[r] = min(key, first.get(r, key))
    return sorted(((k, len(s), first.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))),
                  key=str)


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "ñandú", "A", "the"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = []
    passage = text(40)
    for _ in range(40):
        docs.append(text(rng.randint(1, 80)))
    for _ in range(25):  # documents that share a passage
        docs.append(text(rng.randint(0, 30)) + passage + text(rng.randint(0, 30)))
    base = text(150)
    for _ in range(60):  # near copies, some linked and some not
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        docs.append(copy)
    docs += [list(docs[-1])] * 7
    rows = [(i * 3, " ".join(d)) for i, d in enumerate(docs)]
    rows += [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "One"),
             (9006, "one two"), (9006, "one two"), (None, "one two"), (None, "lonely null id here"),
             (9007, "x " * 5000)]
    rng.shuffle(rows)
    return rows


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    return sorted((tuple(r) for r in jaccard.link(df, "doc_id", "text").collect()), key=str)


def test_components_equal_brute_force(spark):
    rows = fixture(1)
    assert got(spark, rows) == brute(rows)


def test_hot_tokens_go_through_centres(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 3)
    rows = fixture(2)
    assert got(spark, rows) == brute(rows)


def test_documents_that_share_a_passage_form_no_group(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(20)]
    rows = [(k, " ".join([f"d{k}w{i}" for i in range(rng.randint(30, 60))] + passage
                         + [f"d{k}v{i}" for i in range(30)])) for k in range(40)]
    rows += [(100, rows[7][1] + " end"), (101, rows[9][1] + " more")]
    members, real = [], jaccard.by_centres

    def spy(groups, *rest):
        members.append(groups.count())
        return real(groups, *rest)

    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "by_centres", spy)
    assert got(spark, rows) == brute(rows)
    assert members == [0]


def test_empty_table(spark):
    assert got(spark, []) == []
