"""Conversation history for all sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.ranking import bucketed_rank, top_n

PART_MESSAGES = 1000


def history(messages: DataFrame, n: int = fv.HISTORY_MESSAGES, mode: str = "last") -> DataFrame:
    """Last (or oldest) ``n`` messages per session; position 1 is the oldest shown."""
    if mode not in ("last", "oldest"):
        raise ValueError("mode must be 'last' or 'oldest'")
    if mode == "oldest":
        return top_n(messages, ["session_id"], [F.asc("created_at"), F.asc("content")], n, "position")
    recent = top_n(messages, ["session_id"], [F.desc("created_at"), F.desc("content")], n, "_back")
    # At most n rows per session are left, so turning the numbering round is cheap.
    return top_n(recent, ["session_id"], [F.asc("created_at"), F.asc("content")], n, "position").drop("_back")


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"))


def clear(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.join(sessions.select("session_id"), "session_id", "left_anti")


def last_user_message(messages: DataFrame) -> DataFrame:
    """Latest non-empty user message per session."""
    return (
        messages.where((F.col("role") == "user") & (F.length("content") > 0))
        .groupBy("session_id")
        .agg(F.max(F.struct("created_at", "content")).alias("_m"))
        .select("session_id", F.col("_m.content").alias("content"))
    )


def compact(
    messages: DataFrame,
    threshold: int = fv.COMPACTION_THRESHOLD,
    preview: int = 100,
    bucket: str = "hour",
    part_messages: int = PART_MESSAGES,
) -> DataFrame:
    """Replace the oldest half of every long session by a summary message.

    Ranks come from time buckets, so a session of any length is spread over tasks.  Lines are
    joined in parts of ``part_messages`` first, and the parts in order into the one summary of
    a session.  Messages without a time are the oldest; those without a session form one.
    """
    ranked = bucketed_rank(
        messages,
        ["session_id"],
        F.date_trunc(bucket, "created_at"),
        [F.asc("created_at"), F.asc("content")],
        "_rank",
        "_total",
    )
    half = F.expr("_total div 2")
    old = (F.col("_total") >= threshold) & (F.col("_rank") <= half)
    kept = ranked.where(~old).select(*messages.columns)
    shown = F.substring(F.coalesce("content", F.lit("")), 1, preview)
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("] "), shown)
    in_order = lambda number: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(number, "_line"))), lambda m: m["_line"]), "; "
    )
    parts = (
        ranked.where(old)
        .select("session_id", "_rank", "created_at", line.alias("_line"), F.expr(f"(_rank - 1) div {part_messages}").alias("_part"))
        .groupBy("session_id", "_part")
        .agg(in_order("_rank").alias("_line"), F.max("created_at").alias("created_at"))
    )
    summary = (
        parts.groupBy("session_id")
        .agg(in_order("_part").alias("_lines"), F.max("created_at").alias("created_at"))
        .select(
            "session_id",
            F.lit("system").alias("role"),
            F.concat(F.lit("Earlier conversation summary: "), "_lines").alias("content"),
            F.lit("system").alias("user_id"),
            "created_at",
        )
    )
    return kept.unionByName(summary)
