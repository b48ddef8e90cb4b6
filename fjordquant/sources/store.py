"""Published tables: upserts, resumable partitions, exports, insert-or-ignore."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ["symbol", "time", "open", "high", "low", "close", "volume"]


def read_bars(spark: SparkSession, path: str, symbols: list | None = None,
              since: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Bars with symbol and date filters pushed to the scan and columns pruned."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if since is not None:
        df = df.where(F.col("time") >= F.lit(since).cast("date"))
    return df.select(*columns) if columns else df


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union where the newer record wins per (symbol, time)."""
    both = old.select(*BAR_COLUMNS).withColumn("_v", F.lit(0)).unionByName(
        new.select(*BAR_COLUMNS).withColumn("_v", F.lit(1)))
    row = F.struct(*BAR_COLUMNS[2:])
    return both.groupBy("symbol", "time").agg(F.max_by(row, "_v").alias("r")).select(
        "symbol", "time", "r.*")


def refresh_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental refresh: only symbols the store already has."""
    known = old.select("symbol").distinct()
    return merge_bars(old, new.join(known, "symbol", "left_semi"))


def publish(df: DataFrame, root: str, cluster: str = "symbol", order: str = "time") -> str:
    """All-or-nothing publish: write a new version, then move the pointer.

    A pointer entry carries the next sequence number; ``current`` reads the highest.
    Range partitioning by symbol keeps one symbol's bars in neighbouring row
    groups, so a symbol filter skips the rest.
    """
    version = f"{root}/v-{uuid.uuid4().hex}"
    df.repartitionByRange(cluster, order).sortWithinPartitions(cluster, order).write.parquet(version)
    spark = df.sparkSession
    seq = pointer_of(spark, root)[0] + 1
    spark.createDataFrame([(seq, version)], POINTER).write.mode("append").parquet(f"{root}/_current")
    return version


POINTER = "seq long, path string"


def pointer_of(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Sequence number and path of the published version; (0, None) before the first."""
    try:
        entries = spark.read.schema(POINTER).parquet(f"{root}/_current")
    except AnalysisException:
        return 0, None
    last = entries.agg(F.max(F.struct("seq", "path")).alias("last")).first()["last"]
    return (last["seq"], last["path"]) if last else (0, None)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published version of a store."""
    path = pointer_of(spark, root)[1]
    if path is None:
        raise ValueError(f"nothing is published under {root}")
    return spark.read.parquet(path)


def publish_scores(df: DataFrame, path: str) -> None:
    """One partition per signal date; only the dates in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "as_of").parquet(path)


def missing_dates(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Signal dates without a stored partition."""
    return wanted.join(existing.select("as_of").distinct(), "as_of", "left_anti")


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The visible columns as CSV with a byte-order mark, so that spreadsheets read UTF-8.

    The mark is written before the header's first name in every part file; quotes
    inside values are doubled.
    """
    first = f"\ufeff{columns[0]}"
    df.select(F.col(columns[0]).alias(first), *columns[1:]).write.mode("overwrite").options(
        header=True, quote='"', escape='"').csv(path)


def read_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """Known columns of CSV files as the given types.

    Headers are matched without byte-order mark, case and outer blanks; other columns
    are left out, absent ones are null, and values that do not parse ('.', 'n/a') are null.
    """
    raw = spark.read.options(header=True, quote='"', escape='"').csv(path)
    found = {c.lstrip("\ufeff").strip().lower(): c for c in raw.columns}
    return raw.select(*[
        (F.col(f"`{found[name]}`").try_cast(kind) if name in found else F.lit(None).cast(kind)).alias(name)
        for name, kind in types.items()])


def insert_new(existing: DataFrame, items: DataFrame, key: str = "guid") -> DataFrame:
    """Only the items whose key is not stored yet, one per key."""
    row = F.struct(*[c for c in items.columns if c != key])
    one = items.groupBy(key).agg(F.min(row).alias("r")).select(key, "r.*")
    return one.join(existing.select(key), key, "left_anti")


def recent(items: DataFrame, n: int = 6, category: str | None = None) -> DataFrame:
    if category:
        items = items.where(F.col("category") == category)
    return items.orderBy(F.desc("published_at"), "guid").limit(n)


def input_signature(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Order-free SHA-256 fingerprint of a table of any size, or of each of its groups.

    Row digests are summed in 32-bit pieces (an aggregate with map-side
    combine) and the sums are hashed; no list of rows is built.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    digest = F.sha2(F.concat_ws("|", *fields), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    by = by or []
    sums = rows.select(*by, *[p.alias(f"p{i}") for i, p in enumerate(parts)]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(8)])
    return sums.select(*by, "n", F.sha2(F.concat_ws("-", "n", *[f"p{i}" for i in range(8)]), 256)
                       .alias("signature"))


def refresh_results(stored: DataFrame, inputs: DataFrame, by: list[str], columns: list[str], compute,
                    now: Column, days: int = 7) -> DataFrame:
    """Results per key: stored ones while their inputs are the same, others computed anew.

    ``stored`` has the key, the result columns, ``signature`` and ``updated_at``.  A row
    is kept while its signature equals that of its present inputs and it is at most
    ``days`` old; ``compute`` sees the inputs of all other keys only.  Keys without
    inputs go.  The result has ``reused`` beside the columns of ``stored``.
    """
    marks = input_signature(inputs, columns, by).select(*by, "signature")
    kept = stored.where(F.date_diff(now, "updated_at") <= days).join(marks, [*by, "signature"], "left_semi")
    fresh = compute(inputs.join(kept.select(*by), by, "left_anti")).join(marks, by).withColumn(
        "updated_at", now)
    return kept.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


def weekly_rebased(equity: DataFrame, by: list[str]) -> DataFrame:
    """Friday values of an equity line rebased to 100 at its first value."""
    from pyspark.sql import Window

    week = F.next_day(F.date_sub("time", 1), "FRI")
    last = equity.groupBy(*by, week.alias("week")).agg(F.max_by("equity", "time").alias("equity"))
    base = F.first("equity").over(Window.partitionBy(*by).orderBy("week"))
    return last.select(*by, "week", (F.col("equity") / base * 100).alias("value"))


def provenance(df: DataFrame, source: str, as_of: str, note: str | None = None) -> DataFrame:
    """Attach where a block came from."""
    return df.withColumn("provenance", F.struct(
        F.lit(source).alias("source"), F.col(as_of).alias("as_of"), F.lit(note).cast("string").alias("note"),
        F.col(as_of).isNotNull().alias("ok")))


def source_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Distinct sources per key (the set of source names is a small fixed one)."""
    return df.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"))


def signals_payload(df: DataFrame, columns: list[str]) -> DataFrame:
    """Signal rows with their details as a JSON payload."""
    return df.select("symbol", F.to_json(F.struct(*columns)).alias("payload"))


def read_payload(signals: DataFrame, schema: str) -> DataFrame:
    return signals.select("symbol", F.from_json("payload", schema).alias("p")).select("symbol", "p.*")
