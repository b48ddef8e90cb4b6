import random

import numpy as np
import pytest

from fjordquant.llm import jaccard, sketching
from fjordquant.llm import textscan as S
from fjordquant.llm.common import Scratch
from tests.llm.test_jaccard import WORD, fixture, lower


def brute(rows, width=5, percent=85):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
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
    out = [(k, len(s), first.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))]
    return sorted(((k, n, c, k == c) for k, n, c in out), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "doc_id long, text string, node string, n int")
    found = sketching.near_duplicates(df, "doc_id", "text")
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def edited(seed, size, copies, most):
    """Copies of one text with up to ``most`` words changed: links lie on both sides of 0.85."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(900)}" for _ in range(size)]
    rows = []
    for k in range(copies):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(size)] = f"x{rng.randrange(30)}"
        rows.append((10_000 + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("hot", [16, 1])
def test_components_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sketching, "PARTNERS", hot)
    monkeypatch.setattr(jaccard, "HOT", 4 * hot)
    rows = fixture(5) + edited(1, 120, 90, 4) + edited(2, 60, 40, 3)
    assert got(spark, rows) == brute(rows)


def test_large_buckets_of_scattered_copies(spark, monkeypatch):
    monkeypatch.setattr(sketching, "PARTNERS", 1)
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "MERGED_LEVELS", 1)
    rows = edited(3, 150, 150, 6)
    assert got(spark, rows) == brute(rows)


def test_few_candidates_among_scattered_copies(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for k in range(120):  # some 0.76 alike, so no two are linked but by chance
        copy = list(base)
        for at in rng.sample(range(150), 2):
            copy[at] = f"x{k}"
        rows.append((k, " ".join(copy)))
    candidates, real = [], jaccard.by_centres

    def spy(*args):
        links, pairs = real(*args)
        candidates.append(sum(p.count() for p in pairs))
        return links, pairs

    monkeypatch.setattr(sketching, "PARTNERS", 1)
    monkeypatch.setattr(jaccard, "by_centres", spy)
    assert got(spark, rows) == brute(rows)
    assert candidates and candidates[0] < 8 * len(rows)


def test_groups_of_large_buckets_follow_few_links(spark, monkeypatch):
    followed, real = [], jaccard.components

    def spy(edges, store):
        followed.append(edges.count())
        return real(edges, store)

    monkeypatch.setattr(sketching, "PARTNERS", 1)
    monkeypatch.setattr(jaccard, "components", spy)
    rows = edited(7, 150, 150, 6)
    assert got(spark, rows) == brute(rows)
    # of near copies, of large buckets, of late links: none holds a row for each bucket of a set
    assert len(followed) == 3 and max(followed) < 4 * len(rows)


def test_bucket_groups_are_those_linked_by_a_set(spark):
    large = spark.createDataFrame(
        [(1, 10), (2, 10), (2, 11), (3, 11), (1, 12), (7, 20), (7, 21), (9, 30), (8, 30), (8, 31)],
        "bucket long, node long").selectExpr(
            "bucket", "count(*) over (partition by bucket) all", "node", "node + 100 n", "node root")
    found = sketching.bucket_groups(large, Scratch(spark)).select("g", "node", "n", "root")
    groups = {}
    for g, node, n, root in found.collect():
        assert (n, root) == (node + 100, node)
        groups.setdefault(g, []).append(node)
    assert sorted(map(sorted, groups.values())) == [[10, 11, 12], [20, 21], [30, 31]]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_sketch_fills_every_place_and_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 3, 50, 2000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        out = sketching.sketches(base, np.array([0, n]))
        assert (out != sketching.NO_VALUE).all()
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    both = sketching.sketches(np.concatenate([a, b]), np.array([0, 1000, 2000]), 4096)
    assert abs((both[0] == both[1]).mean() - 900 / 1100) < 0.03


def test_extra_rounds_change_nothing(monkeypatch):
    tokens = S.mix(np.arange(70, dtype=np.uint64))
    first = np.array([0, 20, 20, 70])
    one = sketching.sketches(tokens, first)
    monkeypatch.setattr(sketching, "HASHES_AT_ONCE", 1)
    assert (sketching.sketches(tokens, first) == one).all()
