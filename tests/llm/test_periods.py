import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from fjordquant.llm import periods, queries_round3
from fjordquant.llm import textscan as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            part = w[start:start + length]
            smaller = any(all(part[k] == part[k - r] for k in range(r, length)) for r in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted((s, ln, q) for s, ln, q in out)


def brute(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {k for s, ln, q in runs for k in range(s + q, s + ln)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{ln},{q}\n" for s, ln, q in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def scan(docs):
    hashes = np.array([hash(x) & ((1 << 63) - 1) for d in docs for x in d], np.uint64)
    first = np.cumsum([0] + [len(d) for d in docs])
    s, ln, q = periods.runs_of(S.mix(hashes), first)
    return [sorted((a - first[k], b, c) for a, b, c in zip(s.tolist(), ln.tolist(), q.tolist())
                   if first[k] <= a < first[k + 1]) for k in range(len(docs))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=4))
def test_runs_of_few_words_equal_brute_force(docs):
    assert scan(docs) == [brute_runs(d) for d in docs]


def test_overlapping_and_nested_runs_equal_brute_force():
    rng = random.Random(3)
    docs = []
    for _ in range(120):
        d = []
        while len(d) < rng.randint(1, 150):
            block = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
            d += (block * rng.randint(1, 7))[:rng.randint(1, 70)]
        docs.append(d * rng.choice([1, 1, 1, 5]))
    assert scan(docs) == [brute_runs(d) for d in docs]


def test_long_text_of_one_word_is_one_run():
    docs = [["x"] * 200_000, [str(i % 50_000) for i in range(200_000)], []]
    assert scan(docs) == [[(0, 200_000, 1)], [(0, 200_000, 50_000)], []]


def rows():
    rng = random.Random(7)
    some = lambda k: " ".join(rng.choice(["a", "b", "Ünï", "d e", "x"]) for _ in range(k))
    out = [(i, some(rng.randint(0, 90))) for i in range(400)]
    out += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (None, "x x x x x x x"),
            (None, None), (1004, " a\nb  " * 300), (1004, " a\nb  " * 300), (-5, some(50))]
    out += [(k, None) for k in range(2000, 2060)] + [(k, "\n ") for k in range(3000, 3060)]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    data = rows()
    spark.createDataFrame([(t, i, "clash") for i, t in data],
                          "text string, doc_id long, runs string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = queries_round3.op12_sparse_diagonals(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
        "collapsed_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((brute(*r) for r in data), key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "text string, n_words string")
    assert periods.find_runs(empty, "text", ["n_words"]).collect() == []
