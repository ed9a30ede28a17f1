"""Table maintenance: upserts, change feeds, deletes and counts between snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.sources.sizing import broadcast_if_small, within


def upsert(target: DataFrame, source: DataFrame, key: str, compare: str | None = None) -> DataFrame:
    """New snapshot: differing matches are replaced, unmatched source rows are added.

    With ``compare`` a match is replaced only when that column differs; a NULL on either
    side is no difference.  Without it every match is replaced.  The target is scanned and
    never shuffled as long as the source keys are small enough to broadcast.
    """
    left = target.select(F.col(key), *([F.col(compare).alias("_old")] if compare else []))
    right = source.select(F.col(key), *([F.col(compare).alias("_new")] if compare else []))
    # Matched, changed and unchanged keys are source keys, so the one count bounds all of them.
    hint = F.broadcast if within(right) else (lambda df: df)
    matched = left.join(hint(right), key)
    if not compare:
        return target.join(hint(matched.select(key)), key, "left_anti").unionByName(source)
    differs = F.coalesce(F.bool_or(F.col("_old") != F.col("_new")), F.lit(False))
    decided = matched.groupBy(key).agg(differs.alias("_changed"))
    changed = hint(decided.where("_changed").select(key))
    unchanged = hint(decided.where("NOT _changed").select(key))
    # Whole rows of the source travel once: those that are new or changed are all but the unchanged.
    return target.join(changed, key, "left_anti").unionByName(source.join(unchanged, key, "left_anti"))


def insert_new(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of the source whose key the target lacks, one row per key."""
    return source.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def replace_groups(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Replace all rows of every group (document) that occurs in the source."""
    groups = broadcast_if_small(source.select(key).distinct())
    return target.join(groups, key, "left_anti").unionByName(source)


def append_evolving(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows whose columns may be new or missing."""
    return target.unionByName(rows, allowMissingColumns=True)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows left after a delete; rows where the predicate is NULL stay."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def update_keys(df: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows whose key is listed."""
    marked = broadcast_if_small(keys.select(key).distinct()).withColumn("_hit", F.lit(True))
    joined = df.join(marked, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in df.columns
        ]
    )


def snapshot_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """insert, update and delete events between two snapshots.

    Only the key and a hash of the row travel through the shuffle.
    """

    def fingerprint(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in sorted(df.columns) if c != key]
        return df.select(key, F.sha2(F.to_json(F.struct(*rest)), 256).alias(name))

    both = fingerprint(old, "_old").join(fingerprint(new, "_new"), key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    return both.select(key, change.alias("change")).where(F.col("change").isNotNull())


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def purge_before(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Delete rows older than ``days`` before ``as_of``; rows without a time stay."""
    return delete_where(df, F.col(column) < as_of - F.make_interval(days=F.lit(days)))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of NULLs per required column, one row per column."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "n_nulls")


def orphan_counts(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Non-NULL references without a parent row."""
    # Counted per value first, so a hot reference is one row in the join.
    refs = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    missing = refs.join(parent.select(column), column, "left_anti")
    return missing.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    )
