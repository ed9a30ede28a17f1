"""Ranks and order statistics that do not pile one hot group onto one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys of the left side are returned."""
    other = right.select(*[F.col(k).alias(f"_same_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_same_{k}" for k in keys])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every group.

    Spark keeps only the first ``n`` rows per group and map task before it shuffles, so a
    hot group costs ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def bucketed_rank(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], rank: str, total: str
) -> DataFrame:
    """Exact row number and size of every group, without sorting a whole group in one task.

    ``bucket`` must grow with ``order`` (an hour for a timestamp order).  Rows are ranked
    inside a bucket; the rows of earlier buckets come from a table of counts.
    """
    placed = df.withColumn("_bucket", bucket)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_bucket",
        (F.sum("_n").over(by_key.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_key).alias(total),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    ranked = join_same(placed.withColumn("_local", local), offsets, [*keys, "_bucket"])
    return ranked.withColumn(rank, F.col("_before") + F.col("_local")).drop(
        "_bucket", "_local", "_before"
    )


def nearest_rank(
    df: DataFrame, groups: list[str], value: str, fraction: float, out: str, width: float = 1.0
) -> DataFrame:
    """Exact element at position floor(n * fraction) of the sorted values of every group.

    Null values are left out; rows with a null group are a group.  Works on counts per distinct value.  Counts per ``width`` wide band find the band that
    holds the position, and only the values of that band are put in order.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    values = values.withColumn("_band", F.floor(F.col(value) / F.lit(width)))
    bands = values.groupBy(*groups, "_band").agg(F.sum("_n").alias("_size"))
    by_group = Window.partitionBy(*groups)
    position = F.floor(F.sum("_size").over(by_group) * F.lit(fraction)) + 1
    bands = bands.select(
        *groups,
        "_band",
        "_size",
        (F.sum("_size").over(by_group.orderBy("_band")) - F.col("_size")).alias("_before"),
        position.alias("_position"),
    ).where(
        (F.col("_before") < F.col("_position"))
        & (F.col("_position") <= F.col("_before") + F.col("_size"))
    )
    inside = join_same(values, bands.drop("_size"), [*groups, "_band"])
    seen = F.sum("_n").over(Window.partitionBy(*groups).orderBy(value)) + F.col("_before")
    return (
        inside.withColumn("_seen", seen)
        .where(F.col("_seen") >= F.col("_position"))
        .groupBy(*groups)
        .agg(F.min(value).alias(out))
    )
