"""Session defaults for local runs; a cluster's own settings always win."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "fjordquant") -> SparkSession:
    """A local session for tests and the bench, sized to the cores at hand."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOT: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="run-"))
    return _LOCAL_ROOT[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where many later steps read the same table: it is computed once, later
    plans start from a columnar scan of known size (so join strategies rest on
    real sizes), and a lost executor costs nothing that was written.
    """
    path = f"{checkpoint_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SETTLING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # the JVM never compiles a method above 8000 bytes; valuations take 2.6 times as long then
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def settle(df: DataFrame) -> DataFrame:
    """``materialise``, after which the shuffle files behind the table are deleted.

    The table is read from the shared folder from then on, so the files of its plan
    serve nobody; without this they stay until the driver collects garbage.
    """
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTLING}
    for k, v in SETTLING.items():
        conf.set(k, v)
    try:
        return materialise(df)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition by ``columns`` into the session's shuffle partitions.

    The windows that follow need this exchange anyway; naming the number keeps
    the adaptive planner from merging small but compute-heavy partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)
