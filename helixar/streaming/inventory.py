"""Inventory as a stream: sequences that arrive are matched with the goals at once, and late events are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixar.operators import match


def match_arrivals(arrivals: DataFrame, goals: DataFrame, out: str, checkpoint: str, least: int = 30) -> StreamingQuery:
    """Append the hits of each micro-batch of arrivals(key, bases) to Parquet at `out`; a batch that is redone overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        match.exact_matches(goals, df, least).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(spark: SparkSession, path: str, schema, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of an event stream by type and tumbling window, with a watermark."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
