"""Daily bars from a stream of priced events: late events up to the watermark still count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """session, asset, close, dollar_volume of each day; append mode emits a day once the watermark has passed it."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("asset"), F.col("value").cast("decimal(18,2)").alias("value"))
    g = e.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "asset")
    g = g.agg((F.sum("value").cast("double") / F.count("*").cast("double")).alias("close"), F.sum("value").cast("double").alias("dollar_volume"))
    return g.select(F.to_date("w.start").alias("session"), "asset", "close", "dollar_volume")
