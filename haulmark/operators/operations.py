"""Daily operation figures that roll up to longer periods, and the freshness of the index.

A day is kept as two small tables: counts per day, and the number of answers per day and response
time in milliseconds.  Both are sums, so weeks or months come from the stored days without
reading the answers again, and percentiles of merged days are exact to the millisecond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.ranking import join_same, nearest_rank

#: Rates of a period: counted rows and the rows they are a share of.
RATES = {
    "citation_coverage_pct": ("cited", "answered"),
    "satisfaction_pct": ("liked", "rated"),
    "guardrail_trigger_pct": ("triggered", "answered"),
    "binding_block_pct": ("binding", "answered"),
    "vector_hit_pct": ("hits", "searched"),
}
_COUNTS = ["answered", "cited", "rated", "liked", "triggered", "binding", "searched", "hits"]


def daily_counts(answers: DataFrame, ratings: DataFrame, searches: DataFrame) -> DataFrame:
    """Counts per day: answers (at, applied_rules, cited), ratings (at, rating), searches (at, hit)."""
    day = F.to_date("at").alias("day")
    n = F.count(F.lit(1))
    parts = [
        answers.groupBy(day).agg(
            n.alias("answered"),
            F.count_if("cited").alias("cited"),
            F.count_if(F.size("applied_rules") > 0).alias("triggered"),
            F.count_if(F.exists("applied_rules", lambda r: r.contains("binding_opinion"))).alias("binding"),
        ),
        ratings.groupBy(day).agg(n.alias("rated"), F.count_if(F.col("rating") == 1).alias("liked")),
        searches.groupBy(day).agg(n.alias("searched"), F.count_if("hit").alias("hits")),
    ]
    rows = [p.select("day", *[F.col(c) if c in p.columns else F.lit(0).cast("long").alias(c) for c in _COUNTS]) for p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("day").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def daily_times(responses: DataFrame) -> DataFrame:
    """Number of responses (at, elapsed in seconds) per day and millisecond; unanswered ones are left out."""
    answered = responses.where("elapsed IS NOT NULL")
    return answered.groupBy(F.to_date("at").alias("day"), F.round(F.col("elapsed") * 1000).cast("long").alias("ms")).agg(F.count(F.lit(1)).alias("n"))


def rolled_up(table: DataFrame, period: str, keys: list[str] | None = None) -> DataFrame:
    """Stored days summed to ``period`` (day, week, month, ...), named by its first day."""
    numbers = [c for c in table.columns if c not in ("day", *(keys or []))]
    return table.groupBy(F.trunc("day", period).alias("day") if period != "day" else F.col("day"), *(keys or [])).agg(*[F.sum(c).alias(c) for c in numbers])


def response_p95(times: DataFrame, fraction: float = 0.95) -> DataFrame:
    """Nearest-rank percentile per day, in seconds, from counts per millisecond.

    A period has at most as many rows as there are milliseconds in the longest wait.
    """
    by_day = Window.partitionBy("day")
    position = F.floor(F.sum("n").over(by_day) * F.lit(fraction)) + 1
    seen = times.select("day", "ms", position.alias("_position"), F.sum("n").over(by_day.orderBy("ms")).alias("_seen"))
    return seen.where("_seen >= _position").groupBy("day").agg((F.min("ms") / 1000).alias("value"))


def series(counts: DataFrame, times: DataFrame) -> DataFrame:
    """day, metric and value for every figure that has a basis on that day."""
    rates = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("metric"), F.round(F.try_divide(F.col(part) * F.lit(100.0), F.col(whole).cast("double")), 4).alias("value"))
                for name, (part, whole) in RATES.items()
            ]
        )
    )
    rows = counts.select("day", rates.alias("_r")).select("day", "_r.metric", "_r.value").where("value IS NOT NULL")
    return rows.unionByName(response_p95(times).select("day", F.lit("response_p95_s").alias("metric"), "value"))


def freshness(files: DataFrame, batches: DataFrame, as_of: Column, group: str = "category", fraction: float = 0.95) -> DataFrame:
    """Seconds from the arrival of a file to the commit of the index batch that holds it.

    ``files`` has batch_id, arrived_at and ``group``; ``batches`` has batch_id and committed_at.
    Files whose batch isn't committed are open, and their age at ``as_of`` is given.  A group
    without indexed files has no percentile.
    """
    seconds = lambda t: F.unix_seconds(t.cast("timestamp"))
    # One row per committed batch; a batch that was repeated counts from its last commit.
    commits = batches.groupBy("batch_id").agg(F.max("committed_at").alias("committed_at"))
    paired = files.join(commits, "batch_id", "left").withColumn("lag_s", seconds(F.col("committed_at")) - seconds(F.col("arrived_at")))
    is_open = F.col("committed_at").isNull()
    totals = paired.groupBy(group).agg(
        F.count_if(~is_open).alias("n_indexed"),
        F.count_if(is_open).alias("n_open"),
        F.max(F.when(is_open, seconds(as_of) - seconds(F.col("arrived_at")))).alias("oldest_open_s"),
    )
    return join_same(totals, nearest_rank(paired.where(~is_open), [group], "lag_s", fraction, "p95_lag_s", width=60), [group], "left")
