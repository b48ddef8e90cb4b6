import hashlib
import re
import zlib

from pyspark.sql import functions as F

from fjordquant.llm import chat, quality, sharding

ODD = [(1, "a b"), (2, None), (3, ""), (None, "no id"), (None, None), (1, "a b"), (4, "x " * 30000)]


def test_sharding_laws(spark):
    rows = ODD + [(i, f"text {i}") for i in range(10, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc")
    out = sharding.assign(df.drop("shard"), "doc_id", "text", [1.0] * 24, [1.0] * 25, [crc]).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert {r.crc for r in out if r.doc_id == 2} == {zlib.crc32(b"")}
    assert sharding.assign(df.drop("shard").limit(0), "doc_id", "text", [1.0, 2.0]).count() == 0
    heavy = sharding.assign(df.drop("shard"), "doc_id", "text", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r.shard: r["count"] / len(rows) for r in heavy}
    assert set(share) == {0, 1} and 0.7 < share[1] < 0.8


def test_repeated_windows_and_odd_texts(spark):
    rows = ODD + [(9, "a b c d e f a b c d e"), (10, "a a a a a a"), (11, "l1\nl1\n\n l1\nl1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in quality.score(df, "text").collect()}
    assert (got[9].n_repeat_words, got[10].n_repeat_words, got[11].n_dup_lines) == (10, 6, 2)
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[4].n_words == 30000 and got[4].n_repeat_words == 30000
    assert quality.score(df.limit(0), "text").count() == 0


def test_chat_round_trip(spark):
    own = "</s>[INST] ok [/INST]"
    cut = "x</s><s>[INST] 0 user [/INST] y\\l\\e"
    rows = [(1, 0, "user", own), (1, 1, "assistant", own), (2, 0, "user", cut), (2, 1, "assistant", cut),
            (2, 1, "assistant", cut), (3, None, None, None), (3, 0, "a[b", ""), (None, 0, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df, "conv_id", "turn", "role", "text")
           .withColumn("loss", chat.loss_text(F.col("turns"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", own), ("assistant", own)]
    assert [tuple(t) for t in got[2].turns] == [("user", cut), ("assistant", cut), ("assistant", cut)]
    assert got[2].escape_level == 1 and got[2].loss == cut * 2
    assert [tuple(t) for t in got[3].turns] == [("", ""), ("a[b", "")] and got[None].loss == "é"
    assert hashlib.sha256(got[None].loss.encode()).hexdigest()
    # no control string is left in a text: what stands between the turns' own marks is clean
    for r in got.values():
        for body in re.findall(r"<s>\[INST\] \d [^ ]* \[/INST\] (.*?)</s>(?=<s>\[INST\] \d|$)", r.formatted, re.S):
            assert not any(mark in body for mark in chat.CONTROL)
    assert got[1].escape_level == 1 and "\\l/s>\\bINST] ok \\b/INST]" in got[1].formatted
    assert got[None].escape_level == 0
    assert chat.format_conversations(df.limit(0), "conv_id", "turn", "role", "text").count() == 0
