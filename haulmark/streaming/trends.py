"""Daily feedback trend over a stream of feedback rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_trend(feedback: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Ratings per day and intent; a day is final once the watermark has passed its end."""
    n = F.count(F.lit(1))
    up = F.count_if(F.col("rating") == 1)
    grouped = feedback.withWatermark("created_at", delay).groupBy(
        F.window("created_at", "1 day").alias("_w"), "intent_classification"
    )
    return grouped.agg(n.alias("total"), up.alias("positive")).select(
        F.to_date("_w.start").alias("feedback_date"),
        "intent_classification",
        "total",
        "positive",
        F.round(F.col("positive") * 100 / F.col("total"), 1).alias("satisfaction_pct"),
    )
