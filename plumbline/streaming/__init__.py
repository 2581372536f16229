"""Event windows, over a table or a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_totals(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum of value by event type and window; ``late`` bounds a stream's state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    sums = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return sums.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def event_stream(spark: SparkSession, folder: str, files_a_batch: int = 1, schema=None) -> DataFrame:
    """Events that arrive as Parquet files in a folder, some files to a micro-batch."""
    schema = schema or spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def append_totals(events: DataFrame, out: str, checkpoint: str, width: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Write the totals of each window to ``out`` once the watermark has passed its end, for all that is there now.

    Events that come later than ``late`` behind the newest are dropped; state
    and what has been read are kept in ``checkpoint``, from which a run that is
    started again goes on.
    """
    totals = windowed_totals(events, width, late)
    return totals.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(events: DataFrame, out: str, checkpoint: str, width: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Keep the totals of all windows so far in ``out``/batch=N, one folder a micro-batch; the greatest N counts."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n:06d}")  # again the same, should it be repeated

    totals = windowed_totals(events, width, late)
    return totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """What ``running_totals`` kept last."""
    held = spark.read.parquet(out)
    last = held.agg(F.max("batch")).first()[0]
    return held.where(F.col("batch") == last).drop("batch")
