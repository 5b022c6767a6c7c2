"""Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 100) -> DataFrame:
    """Files of an inbox as a stream, with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def activity(events: DataFrame, length: str = "1 day", late: str = "26 hours") -> DataFrame:
    """Counts and sums by window and kind of event; rows later than the watermark are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def activity_by(events: DataFrame, grain: str) -> DataFrame:
    """The same by calendar period: day, week (from Monday), month, quarter or year, which no window of fixed length gives."""
    w = events.groupBy(F.date_trunc(grain, "ts").alias("start"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def first_seen(items: DataFrame, key: str, late: str = "14 days") -> DataFrame:
    """Items whose key has not come within the watermark: a seen-ledger with retention."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, appended to a Parquet table; what was written once is not written again."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """The result over all that has arrived, written batch by batch as Parquet below folder; the last batch is read back.

    A batch that is written again, after a failure, replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number:09d}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    every = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result/*")
    if mode != "complete":
        return every
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result/batch={last:09d}")
