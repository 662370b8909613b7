"""Continuous operators over streaming DataFrames, and a runner that drains a bounded stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, write it below ``folder`` and read the result.

    For ``complete`` and ``update`` modes each batch is written whole and the last
    version of the rows is read.
    """
    spark = stream.sparkSession
    out = f"{folder}/{uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(schema).parquet(f"{out}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a file stream with an event time."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path).withColumn("time", F.col("ts").cast("timestamp"))


def first_sightings(stream: DataFrame, key: str, delay: str = "60 days") -> DataFrame:
    """Each key's first event within the watermark; state is dropped once it has passed."""
    return stream.withWatermark("time", delay).dropDuplicatesWithinWatermark([key])


def thresholds(stream: DataFrame, limit: float, window: str = "10 seconds", delay: str = "1 hour") -> DataFrame:
    """Windows whose largest value exceeds the limit, each when the watermark has passed it; its state goes then."""
    sums = stream.withWatermark("time", delay).groupBy(F.window("time", window)).agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))
    return sums.where(F.col("top") > limit).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "top", "n")


def blocks(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of events and errors of tumbling windows, each when the watermark has passed it."""
    sums = stream.withWatermark("time", delay).groupBy(F.window("time", window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return sums.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "errors")


def sessions(stream: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no gap longer than ``gap``, each when the watermark has passed it."""
    runs = stream.withWatermark("time", delay).groupBy("user_id", F.session_window("time", gap)).agg(F.count(F.lit(1)).alias("n"))
    return runs.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def dispatched(stream: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Events by the queue that their type belongs to; others are dropped."""
    table = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])
    return stream.withColumn("queue", F.try_element_at(table, F.col("event_type"))).where("queue is not null")
