"""The corpus pipeline: stages in order, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordquant.llm import bpe, decontaminate, jaccard, langid, quality
from fjordquant.llm.common import fresh, table
from fjordquant.session import checkpoint_root, materialise

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BROADCAST_ROWS = 1_000_000  # rows to drop that are sent to all tasks (16 MB); beyond, a shuffle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; the predicted language replaces a missing label."""
    row, text = fresh(docs, "_row", "_text")
    model, calibration = langid.train(docs, "doc_id", "text", "lang")
    # the text goes through the workers once, the other columns in a box beside it
    boxed = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias(row),
                        F.col("text").alias(text))
    good = langid.predict(boxed, text, model, calibration).where("accepted")
    return good.select(*[
        F.coalesce(F.col(row)["lang"], F.col("lang_pred")).alias(c) if c == "lang"
        else F.col(text).alias(c) if c == "text" else F.col(row)[c].alias(c)
        for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weak-supervision model of the quality rules keeps."""
    return quality.keep_good(docs, "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id (null last), of these the
    first; rows without a word stay."""
    row = fresh(docs, "_row")[0]
    # written once, so that the numbers are the same wherever they are read
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    source = numbered.select(F.col(row).alias("row"), F.col("text").alias("text"))
    linked = jaccard.link(source, "row", "text", width=5, percent=80).where("n_shingles > 0")
    linked = materialise(linked.join(
        numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id")), "row").select(
        "row", "component_id", F.struct(F.col("id").isNull().alias("last"), "id", "row").alias("rank")))
    kept = linked.groupBy("component_id").agg(F.min("rank")["row"].alias("row"))
    dropped = materialise(linked.join(kept, "row", "left_anti").select(F.col("row").alias(row)))
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rest = numbered.join(F.broadcast(dropped) if few else dropped, row, "left_anti")
    return rest.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, also not with other numbers, names or units."""
    return decontaminate.clean(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left."""
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return bpe.digests(docs, "doc_id", "text", vocabulary)


STAGES = [
    ("language", language),
    ("quality_rules", rules),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{checkpoint_root(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
