"""Queries of near-duplicates by sketches, periodic runs and spelling variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordquant.llm import periods, sketching, variants
from fjordquant.llm.common import table
from fjordquant.llm.registry import query


@query("op11_fast_sketches")
def op11_fast_sketches(spark, d):
    return sketching.near_duplicates(table(spark, d, "documents"), "doc_id", "text",
                                     width=5, percent=85)


@query("op12_sparse_diagonals")
def op12_sparse_diagonals(spark, d):
    docs = table(spark, d, "documents")
    found = periods.find_runs(docs, "text", ["doc_id"], places=periods.planted)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    best = periods.longest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_search_schemes")
def op13_search_schemes(spark, d):
    return variants.groups(table(spark, d, "documents"), "doc_id", "text")
