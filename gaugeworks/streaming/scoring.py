"""Streaming scoring with a frozen threshold, and windowed alarm rates (an extension of the engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions.columns import decision


def score(stream: DataFrame, score: str, threshold: float, low: float, high: float) -> DataFrame:
    """Stateless: refused outside [low, high], else anomalous above the threshold, else normal."""
    ok = F.col(score).between(low, high)
    return stream.withColumn("decision", decision(ok, F.col(score), F.lit(float(threshold))))


def alarm_rates(scored: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and share of alarms in tumbling windows of event time, late rows dropped after ``late``."""
    own = scored.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return own.agg(F.count("*").alias("n"), F.avg((F.col("decision") == "anomalous").cast("double")).alias("alarm_rate")).select(F.col("w.start").alias("start"), "n", "alarm_rate")


def running_histogram(stream: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin, for the complete output mode."""
    place = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return stream.groupBy(place.alias("bin")).count()


def once_only(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its own partition, so a repeated one changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch.withColumn("batch", F.lit(epoch))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
