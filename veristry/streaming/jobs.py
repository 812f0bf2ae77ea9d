"""Streams over crawl events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and kind; distinct users are approximate, as exact ones need unbounded state."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    out = w.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", "users")


def first_seen(docs: DataFrame, late: str = "30 days") -> DataFrame:
    """Documents whose content hash has not arrived within the watermark."""
    return docs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def run_available(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Processes what is there now and returns the result as a table; the checkpoint lets a restart go on."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def latest_table(spark: SparkSession, stream: DataFrame, keys: list[str], order: str, folder: str, buckets: int = 64) -> DataFrame:
    """Keeps the row of largest ``order`` for each key, batch by batch, in a table of key buckets.

    A batch rewrites the buckets of its keys and no other, so what it writes
    follows its own size as long as that is small against the buckets; see
    ``BucketTable`` for failures and restarts.  A restart without new data
    returns the table as it is.
    """
    table = BucketTable(spark, folder, stream.schema, keys, buckets)

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")

    query = stream.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number, newest)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()
