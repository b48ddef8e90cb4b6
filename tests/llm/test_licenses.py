import random
import re

from fjordquant.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    places = []
    for t in L.BASE:
        p = t.text.split()
        places += [(i, t.label) for i in range(len(w)) if w[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in places})))


def test_summary(spark):
    rng = random.Random(5)
    vocabulary = "under the mit license apache version 2 cc by nc é x".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["Released UNDER the-MIT license.", "Licensed under CC BY-NC 4.0.", None, "", "cc", "CC-BY/NC " * 40]
    notice = L.NOTICES[0].text.split()
    changed = notice[:9] + ["extra"] + notice[9:20] + notice[21:]
    texts += ["Intro words. " + " ".join(changed) + " and more.",
              "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, texts[-3], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in L.summary(df, "doc_id", "text").collect()), key=str)
    want = sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert [g[:6] for g in got] == want
    by_id = {g[0]: g for g in got}
    assert by_id[len(texts) - 2][6] == "mit" and by_id[len(texts) - 2][7] >= 0.9
    assert by_id[len(texts) - 1][6] == "gpl-3"
    for g in got:
        assert set(filter(None, g[5].split(","))) <= set(filter(None, g[6].split(","))) and 0 <= g[7] <= 1
    assert L.summary(df.limit(0), "doc_id", "text").count() == 0
