"""Role filters on categories, row filters for brokers, column masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.sources.sizing import broadcast_if_small


def role_policy(spark: SparkSession, policy: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per role: ``allowed`` lists its categories, NULL means every category."""
    rows = [
        (role, None if "all" in labels else labels)
        for role, labels in (policy or fv.ROLE_CATEGORIES).items()
    ]
    return spark.createDataFrame(rows, "role string, allowed array<string>")


def with_allowed(queries: DataFrame, policy: DataFrame) -> DataFrame:
    """Attach the allowed categories of the role; an unknown role stops the job."""
    known = policy.withColumn("_known", F.lit(True))
    joined = queries.join(broadcast_if_small(known), "role", "left")
    message = F.concat(F.lit("unknown role: "), F.coalesce("role", F.lit("NULL")))
    guard = F.when(F.col("_known"), F.col("allowed")).otherwise(
        F.raise_error(message).cast("array<string>")
    )
    return joined.select(*queries.columns, guard.alias("allowed"))


def visible_counts(chunks: DataFrame, policy: DataFrame) -> DataFrame:
    """Chunks and categories every role can see, and the share of all chunks."""
    per_category = chunks.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    sees = F.col("allowed").isNull() | F.array_contains("allowed", F.col("category"))
    total = chunks.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        # One row per category on one side, one row per role on the other.
        per_category.join(policy, sees)
        .groupBy("role")
        .agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_categories"))
        .withColumn("visible_pct", F.round(F.col("n_chunks") * 100 / total, 4))
    )


def seen_categories(hits: DataFrame, policy: DataFrame) -> DataFrame:
    """Categories that hits (role, category) show every role, in order, and those it may not see."""
    seen = hits.groupBy("role").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    # One row per role on both sides.
    both = policy.join(seen, "role", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    unexpected = F.when(F.col("allowed").isNull(), F.array().cast("array<string>")).otherwise(F.array_except("categories", "allowed"))
    return both.select("role", "categories", unexpected.alias("unexpected"))


def rows_of_user(rows: DataFrame, entitlements: DataFrame, user_id: str, column: str = "broker_name") -> DataFrame:
    """Row filter: the rows a broker user may see, each once, with the columns of ``rows``.

    ``entitlements`` (user_id, ``column``) is read for this user only; a row without a value in
    ``column`` is seen by nobody, a user without entitlements sees nothing.
    """
    own = entitlements.where(F.col("user_id") == user_id).select(column)
    return rows.join(broadcast_if_small(own), column, "left_semi").select(rows.columns)


def entitled_rows(rows: DataFrame, entitlements: DataFrame, column: str = "broker_name") -> DataFrame:
    """Every (user, row) pair a broker user may see; filter on ``user_id`` for one user."""
    return rows.join(entitlements.select("user_id", column).distinct(), column)
