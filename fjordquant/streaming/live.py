"""Live quotes and news as Structured Streaming jobs.

Each job is a function from a streaming DataFrame to a streaming DataFrame;
``drain`` runs one over what is available now and returns the result as a
table, so the same job serves a test, a backfill and a running stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordquant.plans.domain import quotes_from
from fjordquant.session import checkpoint_root


def quote_stream(spark: SparkSession, folder: str, file_name: str = "events.parquet") -> DataFrame:
    """Ticks from landed files; new files in the folder are picked up as they come."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)
    return quotes_from(raw)


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run to the end of the available input into a table and read it.

    In update mode later batches replace earlier rows of the same keys.  The
    batch number makes a replayed batch overwrite itself, so a restart after a
    lost executor or driver leaves every row exactly once.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    out = f"{root}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    table = spark.read.option("basePath", out).parquet(out)
    if mode != "update":
        return table.drop("batch")
    row = F.struct(*[c for c in table.columns if c not in (*keys, "batch")])
    return table.groupBy(*keys).agg(F.max_by(row, "batch").alias("r")).select(*keys, "r.*")


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Newest quote per symbol (update mode)."""
    newest = F.max_by(F.struct("ts", "price", "volume"), F.struct("ts", "event_id"))
    return quotes.groupBy("symbol").agg(newest.alias("q")).select("symbol", "q.*")


def daily_bars(quotes: DataFrame, lateness: str = "1 day") -> DataFrame:
    """In-session daily bars, updated until the watermark closes the day."""
    order = F.struct("ts", "event_id")
    return (
        quotes.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", "1 day"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
             F.min("price").alias("low"), F.max_by("price", order).alias("close"),
             F.sum("volume").alias("volume"))
        .select("symbol", F.to_date("window.start").alias("time"), "open", "high", "low", "close",
                "volume"))


def once_per_id(items: DataFrame, key: str, time: str, lateness: str = "2 hours") -> DataFrame:
    """Exactly once per id; items later than the watermark are dropped."""
    return items.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def last_two_bars(bars: DataFrame) -> DataFrame:
    """Static side: last close, the one before, and the 250-session range."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("time"))
    r = bars.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= 250)
    return r.groupBy("symbol").agg(
        F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("ref"),
        F.max(F.when(F.col("rn") == 1, F.col("volume"))).alias("last_volume"),
        F.max("time").alias("ref_time"), F.min("close").alias("lo"), F.max("close").alias("hi"))


def with_change(quotes: DataFrame, static: DataFrame, price_scale: float = 1.0) -> DataFrame:
    """Quotes against the stored last bar; without a price the bar answers."""
    price = F.when(F.col("price") > 0, F.col("price") * price_scale)
    j = quotes.join(static, "symbol", "left")
    shown = F.coalesce(price, F.col("ref"))
    return j.select(
        "event_id", "symbol", "ts", shown.alias("price"),
        F.when(F.col("ref") != 0, shown - F.col("ref")).alias("change"),
        F.when(F.col("ref") != 0, shown / F.col("ref") - 1).alias("change_pct"),
        (shown * F.coalesce("volume", "last_volume")).alias("turnover"),
        price.isNull().alias("from_bar"), "lo", "hi")


def plausible(quotes: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Index quotes inside 0.5x..2x of their own 250-session range."""
    return quotes.where((F.col("price") >= low * F.col("lo")) & (F.col("price") <= high * F.col("hi")))


def is_stale(ts: Column, now: Column, seconds: int = 900) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(ts) > seconds


def repaired_turnover(value: Column, volume: Column) -> Column:
    """Smallest of value x 1, 1e3, 1e6 whose implied price is plausible."""
    usable = (value > 0) & (volume > 0)
    options = F.filter(F.array(value, value * 1e3, value * 1e6),
                       lambda a: (a / F.when(volume > 0, volume)).between(1e3, 1e6))
    return F.when(usable, F.array_min(options))
