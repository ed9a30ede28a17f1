"""Ratings, their review, promotion to evaluation and underwriter overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.operators.tables import update_keys


def encode_rating(rating: Column) -> Column:
    """thumbs_up is 1, everything else (NULL too) is -1."""
    return F.when(rating == "thumbs_up", 1).otherwise(-1)


def _satisfaction(n: Column) -> Column:
    return F.round(F.count_if(F.col("rating") == 1) * 100 / F.nullif(n, F.lit(0)), 1)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return feedback.agg(
        n.alias("total_feedback"),
        F.count_if(F.col("rating") == 1).alias("thumbs_up"),
        F.count_if(F.col("rating") == -1).alias("thumbs_down"),
        F.coalesce(_satisfaction(n), F.lit(0.0)).alias("satisfaction_pct"),
        F.count_if("promoted_to_eval").alias("promoted_count"),
    )


def negative_feedback(feedback: DataFrame, limit: int = 20) -> DataFrame:
    """Newest negative feedback that has not been promoted yet."""
    return (
        feedback.where((F.col("rating") == -1) & ~F.col("promoted_to_eval"))
        .orderBy(F.desc("created_at"), F.asc("feedback_id"))
        .limit(limit)
        .select(
            "feedback_id",
            "created_at",
            "user_id",
            "question",
            F.left("answer", F.lit(200)).alias("response_preview"),
            "comment",
            "intent_classification",
        )
    )


def promote_to_eval(
    feedback: DataFrame, minimum: int = fv.PROMOTION_MINIMUM, limit: int = fv.PROMOTION_LIMIT
) -> DataFrame:
    """Evaluation entries made from negatives; none while there are fewer than ``minimum``."""
    negatives = negative_feedback(feedback, limit)
    enough = negatives.agg(F.count(F.lit(1)).alias("n"))
    fallback = F.concat(
        F.lit("Previous response was rated negatively: "),
        F.left(F.coalesce("response_preview", F.lit("")), F.lit(100)),
    )
    return negatives.where(enough.scalar() >= minimum).select(
        F.col("question").alias("query"),
        F.lit("user_feedback").alias("source"),
        "feedback_id",
        F.coalesce(F.nullif(F.col("comment"), F.lit("")), fallback).alias("expected_facts"),
    )


def mark_promoted(feedback: DataFrame, entries: DataFrame) -> DataFrame:
    return update_keys(feedback, entries, "feedback_id", {"promoted_to_eval": F.lit(True)})


def quality_trends(feedback: DataFrame, by_intent: bool = True) -> DataFrame:
    n = F.count(F.lit(1))
    keys = [F.to_date("created_at").alias("feedback_date")]
    if by_intent:
        keys.append(F.col("intent_classification"))
    return feedback.groupBy(*keys).agg(
        n.alias("total"),
        F.count_if(F.col("rating") == 1).alias("positive"),
        _satisfaction(n).alias("satisfaction_pct"),
    )


def override_matrix(overrides: DataFrame, decisions: list[str]) -> DataFrame:
    """Recommendation by decision counts."""
    counted = overrides.groupBy("ai_recommendation").pivot("uw_decision", decisions).count()
    return counted.na.fill(0, decisions)


def override_rate(overrides: DataFrame) -> DataFrame:
    differs = F.col("ai_recommendation") != F.col("uw_decision")
    n = F.count(F.lit(1))
    return overrides.groupBy("override_reason").agg(
        n.alias("n_decisions"),
        F.count_if(differs).alias("n_overrides"),
        F.round(F.count_if(differs) * 100 / n, 4).alias("override_pct"),
    )


def eval_export(feedback: DataFrame, overrides: DataFrame, override_weight: float = 2.0) -> DataFrame:
    """Negatives and all overrides as evaluation rows; overrides weigh more."""
    negatives = feedback.where(F.col("rating") == -1).select(
        F.col("feedback_id").alias("source_id"),
        F.lit("feedback").alias("source"),
        F.col("question").alias("subject"),
        F.lit(1.0).alias("weight"),
    )
    decisions = overrides.select(
        F.col("override_id").alias("source_id"),
        F.lit("override").alias("source"),
        F.col("submission_id").alias("subject"),
        F.lit(override_weight).alias("weight"),
    )
    return negatives.unionByName(decisions)
