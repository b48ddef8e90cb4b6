"""Queries of the operators that run numpy or Python inside tasks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fjordquant.llm import bpe, extract, jaccard, langid, licenses, warc
from fjordquant.llm.common import table
from fjordquant.llm.registry import query


@query("op10_adaptive_jaccard")
def op10_adaptive_jaccard(spark, d):
    return jaccard.link(table(spark, d, "documents"), "doc_id", "text", width=3, percent=90)


@query("op4_scan_bpe")
def op4_scan_bpe(spark, d):
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, d, "documents"), "doc_id", "text", vocabulary)


@query("op9_kneser_ney_language")
def op9_kneser_ney_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model, calibration = langid.train(docs, "doc_id", "text", "lang")
    rows = langid.predict(docs.select("doc_id", "text"), "text", model, calibration)
    return rows.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                       "score")


@query("op7_diagonal_voting")
def op7_diagonal_voting(spark, d):
    return licenses.summary(table(spark, d, "documents"), "doc_id", "text")


@query("op6_two_pass_blocks")
def op6_two_pass_blocks(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return extract.main_text(pages, "html").withColumn("n_chars", F.length("text").cast("long"))


@query("op5_boundary_chain")
def op5_boundary_chain(spark, d):
    path = warc.new_path(spark)
    warc.write(table(spark, d, "pages"), "page_id", "url", "html", path)
    return warc.read(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
