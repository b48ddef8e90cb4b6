"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordquant.session import checkpoint_root

SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``, one for each given name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Words between runs of space, tab, line feed, VT, FF and CR; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def window_hashes(hashes: Column, width: int) -> Column:
    """One 64-bit hash for each run of ``width`` elements of an array of longs."""
    last = F.size(hashes) - width
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))


class Scratch:
    """Intermediate tables of one run in the shared folder; each goes when it is read no more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/scratch/{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, rows: int | None = None, per_task: int = 100_000) -> DataFrame:
        """``df`` written and read back, by as many tasks as at most ``rows`` rows need."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per_task)))
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)  # holds the frame, so that its id stays taken
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables whose last reader has been written."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
