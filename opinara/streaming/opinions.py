"""Opinions as a stream: files arrive, windows close behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files as they arrive. Times become TIMESTAMP, as watermarks are refused on TIMESTAMP_NTZ."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and mean opinion by day and target; rows later than `late` are left out."""
    k = F.get_json_object("props", "$.k").cast("int")
    predicted = F.when(k < 33, -1).when(k < 66, 0).otherwise(1)
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("stance"))
    return days.agg(F.count("*").alias("n"), F.avg(predicted).alias("mean")).select(F.col("window.start").alias("day"), "stance", "n", "mean")


def run_available(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes all that has arrived, then stops: a poll-until-done loop with exactly-once files."""
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
