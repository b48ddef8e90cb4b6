import random
import re
import zlib
from collections import Counter

import numpy as np

from fjordquant.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    out, form = [], {}
    close = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.append((w, f, root, n[w], len(close[w]), n[f] if f else None))
    return sorted(out)


def mutated(rng, word, letters):
    k, c = rng.randrange(len(word)), rng.choice(letters)
    return rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k + 1:], word[:k] + c + word[k:]])


def rows(seed, letters="abcé", size=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(size)]
    words += [mutated(rng, w, letters) for w in words for _ in range(3)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "Aaaaa", "ÀÿØ÷×ab", "x" * 300, "x" * 299]
    out = []
    for k in range(300):
        out.append((k, rng.choice([" ", "-", "1", "ı"]).join(
            rng.choice(words[:1 + rng.randrange(len(words))]) for _ in range(rng.randint(0, 40)))))
    return out + [(900, None), (901, ""), (902, "1 \n"), (None, "aaaaa bbbbb"), (903, "ccccc " * 400),
                  (903, "ccccc " * 400), (904, "caſe Straße naïve")]


def got(spark, data):
    df = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, word string")
    return sorted(tuple(r) for r in variants.groups(df, "doc_id", "text").select(
        "word", "form", "root", "n", "n_near", "form_n").collect())


def test_equal_to_brute_force(spark):
    data = rows(1)
    assert got(spark, data) == brute(data)


def test_small_buckets_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(variants, "WORDS", 20)
    data = rows(2)
    assert got(spark, data) == brute(data)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_searches_find_each_neighbour_once():
    rng = random.Random(5)
    for _ in range(40):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 8))) for _ in range(60)})
        index = [w.encode() for w in words]
        a, b = variants.one_edit(index, index, np.zeros(len(words), np.int64))
        pairs = sorted(zip(a.tolist(), b.tolist()))
        assert pairs == [(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if near(w, v)]
