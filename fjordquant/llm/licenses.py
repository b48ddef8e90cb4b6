"""License scan by diagonal voting.

Every run of K words of a text is hashed and joined with the positions of the
same hash in the license templates.  Hits vote for the diagonal (text position
minus template position); neighbouring diagonals of a text, which an inserted or
missing word separates, are merged; the span that a merged diagonal covers is
fetched again and verified by its words.  A template marked exact counts only
where all of its words stand consecutively.

Edge cases: null text counts as empty; a text without words or hits has no label
and score 0; repeated rows give the same result each; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordquant.llm import textscan as S
from fjordquant.llm.common import fresh
from fjordquant.llm.jaccard import only
from fjordquant.session import materialise

K = 3
GAP = 3              # diagonals this close belong together
VOTE_SHARE = 0.6     # of a template's word runs that must vote
VERIFY_SHARE = 0.8   # of a template's words that must stand in the span in order


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


# Base phrases and the wording of well-known license notices.
BASE = [
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
]
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
                    "software and associated documentation files the software to deal in the software "
                    "without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are "
                    "permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or "
                    "without fee is hereby granted"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
]


def scan_words(column: pa.Array) -> S.Words:
    return S.words(column, S.separators(S.NON_ALNUM_BYTES), lower=True)


def template_runs(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(hash, template, at): a table as large as the templates, a few hundred rows."""
    rows = []
    for t, template in enumerate(templates):
        words = scan_words(pa.array([template.text])).hashes()
        rows += [(int(h), t, q) for q, h in enumerate(S.windows(words, K).view(np.int64))]
    return spark.createDataFrame(rows, "hash long, template int, at int")


def text_runs(rows: DataFrame) -> DataFrame:
    """(key, text_key, n_words, runs) of (key, text_key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, "text"):
            words = scan_words(batch.column(2))
            runs = S.windows(words.hashes(), K).view(np.int64)
            a, b = words.first[:-1], words.first[1:]
            size = np.maximum(b - a - K + 1, 0)
            at = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(a - at[:-1], size) + np.arange(at[-1])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(runs[take]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((b - a).astype(np.int64)), lists],
                ["key", "text_key", "n_words", "runs"])

    return rows.select("key", "text_key", "text").mapInArrow(
        run, "key long, text_key long, n_words long, runs array<long>")


def common_in_order(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence; ``a`` is a template."""
    row = [0] * (len(a) + 1)
    for word in b:
        left = 0
        for i, x in enumerate(a, 1):
            up = row[i]
            row[i] = left + 1 if x == word else max(up, row[i - 1])
            left = up
    return row[-1]


def best_notices(checked: list[tuple], templates: list[Template]) -> list[tuple]:
    """Of notices that start within GAP words, the best match; the longer of equals."""
    out = [x for x in checked if templates[x[2]].exact]
    group: list[tuple] = []
    for x in sorted((x for x in checked if not templates[x[2]].exact), key=lambda x: x[3]):
        if group and x[3] - group[0][3] > GAP:
            out.append(max(group, key=lambda x: (x[4], len(templates[x[2]].text))))
            group = []
        group.append(x)
    if group:
        out.append(max(group, key=lambda x: (x[4], len(templates[x[2]].text))))
    return out


def verify(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """(key, text_key, template, start, share) of (key, text_key, text, spans)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [[w.encode() for w in t.text.split()] for t in templates]
        for batch in S.slices(batches, "text"):
            words = scan_words(batch.column(2))
            out: list[tuple] = []
            for i, spans in enumerate(batch.column(3).to_pylist()):
                a, b = int(words.first[i]), int(words.first[i + 1])
                key, text_key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                checked: list[tuple] = []
                for s in spans:
                    lo, hi = a + max(s["begin"], 0), min(a + s["stop"], b)
                    found = [words.data[x:y].tobytes()
                             for x, y in zip(words.start[lo:hi], words.end[lo:hi])]
                    t = s["template"]
                    share = float(found == own[t]) if templates[t].exact else \
                        common_in_order(own[t], found) / len(own[t])
                    checked.append((key, text_key, t, lo - a, share))
                out += best_notices(checked, templates)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("key", "text_key", "template", "start", "share"), x)) for x in out],
                schema=pa.schema([("key", pa.int64()), ("text_key", pa.int64()),
                                  ("template", pa.int32()), ("start", pa.int32()),
                                  ("share", pa.float64())]))

    return rows.mapInArrow(
        run, "key long, text_key long, template int, start int, share double")


def scan(df: DataFrame, key: str, text: str, templates: list[Template]) -> DataFrame:
    """Attach n_words and spans: array of (template, start, share) that are verified."""
    spark = df.sparkSession
    n_words, spans, text_key = fresh(df, "n_words", "spans", "_text_key")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(body).alias("text_key"),
                     body.alias("text"))
    runs = F.broadcast(template_runs(spark, templates))
    scanned = text_runs(rows)
    # one row for each hit, and one with the word count for each text
    hits = scanned.select("key", "text_key", "n_words", F.posexplode("runs").alias("pos", "hash")) \
        .join(runs, "hash").select("key", "text_key", "template", "at", "pos")
    hits = materialise(hits.distinct())
    exact = [i for i, t in enumerate(templates) if t.exact]
    length = F.element_at(F.array(*[F.lit(len(t.text.split())) for t in templates]),
                          F.col("template") + 1)
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(
        "key", "text_key", "template", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = Window.partitionBy("key", "text_key", "template").orderBy("diagonal")
    is_exact = F.col("template").isin(exact)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(is_exact, 0)
                       .otherwise(GAP), F.lit(True))
    merged = (
        votes.withColumn("run", F.sum(apart.cast("int")).over(
            order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "text_key", "template", "run")
        .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("first"),
             F.max("diagonal").alias("last"))
        .where(F.when(is_exact, F.col("votes") == length - K + 1)
               .otherwise(F.col("votes") >= VOTE_SHARE * (length - K + 1)))
        .groupBy("key", "text_key")
        .agg(F.array_agg(F.struct(
            "template", F.col("first").alias("begin"), (F.col("last") + length).alias("stop")))
            .alias("spans")))
    merged = materialise(merged)
    texts = only(rows, merged.select("text_key").distinct(), "text_key")
    fetched = texts.join(
        merged.withColumnRenamed("key", "k2").withColumnRenamed("text_key", "t2"),
        F.col("key").eqNullSafe(F.col("k2")) & (F.col("text_key") == F.col("t2"))).select(
        "key", "text_key", "text", "spans")
    found = verify(fetched, templates).where(F.col("share") >= VERIFY_SHARE).distinct().groupBy(
        "key", "text_key").agg(F.sort_array(F.array_agg(F.struct("template", "start", "share")))
                               .alias(spans))
    found = materialise(found.select(F.col("key").alias("_k"), F.col("text_key").alias("_t"), spans))
    counted = text_lengths(df, text, n_words, text_key)
    return counted.join(
        found, F.col(key).eqNullSafe(F.col("_k")) & (F.col(text_key) == F.col("_t")), "left"
    ).drop("_k", "_t", text_key).withColumn(spans, F.coalesce(
        F.col(spans), F.array().cast(found.schema[spans].dataType)))


def text_lengths(df: DataFrame, text: str, n_words: str, text_key: str) -> DataFrame:
    """The columns of ``df`` but for the text, with its word count and key."""
    inner = fresh(df, "_count")[0]
    kept = [c for c in df.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    source = df.select(*kept, F.xxhash64(body).alias(text_key), body.alias(inner))
    schema = source.drop(inner).schema.add(n_words, "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, inner):
            words = scan_words(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(words.first).astype(np.int64))], names)

    return source.mapInArrow(run, schema)


def summary(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    templates = BASE + NOTICES
    found = scan(df.select(key, text), key, text, templates)
    names = F.array(*[F.lit(t.label) for t in templates])
    base = F.filter("spans", lambda s: s["template"] < len(BASE))
    starts = F.transform(base, lambda s: s["start"].cast("long"))

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(
            spans, lambda s: F.element_at(names, s["template"] + 1)))), ",")

    return found.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"))
