"""Loss experience: premium earned over time, claims on policy terms, ratios.

A policy earns its premium evenly over the days from its effective date up to, but not
including, its expiration date.  A claim belongs to the calendar year of its loss date and to
the policy term that was in force on that day.  No claim and no premium is lost: years with
only one of the two keep their row, and so do claims outside every term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.ranking import join_same

_MONEY = "decimal(18,2)"


def _incurred() -> Column:
    return F.coalesce(F.sum(F.col("total_incurred").cast(_MONEY)), F.lit(0).cast(_MONEY)).cast("double")


def earned_premium(policies: DataFrame) -> DataFrame:
    """policy_id, insured_id, year and the premium the policy earns in that calendar year.

    A term without a day (no expiration, or one that is not after the effective date) earns
    everything in the year it becomes effective.
    """
    days = F.datediff("expiration_date", "effective_date")
    has_term = F.coalesce(days > 0, F.lit(False))
    last = F.when(has_term, F.year(F.date_sub("expiration_date", 1))).otherwise(F.year("effective_date"))
    # The outer form keeps a policy without dates, in a year of its own (null).
    years = policies.withColumn("year", F.explode_outer(F.sequence(F.year("effective_date"), last)))
    begin = F.greatest(F.col("effective_date"), F.make_date("year", F.lit(1), F.lit(1)))
    end = F.least(F.col("expiration_date"), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)))
    share = F.when(has_term, F.datediff(end, begin) / days).otherwise(F.lit(1.0))
    return years.select("policy_id", "insured_id", "year", (F.col("written_premium") * share).cast("decimal(24,6)").alias("earned"))


def loss_metrics(policies: DataFrame, claims: DataFrame, insureds: DataFrame) -> DataFrame:
    """Loss ratio, frequency and severity per insured and calendar year.

    Years with premium or claims have a row; a ratio without premium and a frequency without
    power units are null, a severity without claims is 0.
    """
    earned = earned_premium(policies).groupBy("insured_id", "year").agg(F.sum("earned").alias("_earned"))
    losses = claims.groupBy("insured_id", F.year("loss_date").alias("year")).agg(
        F.count(F.lit(1)).alias("_claims"), _incurred().alias("_incurred")
    )
    # Both sides become rows of one table, so that null keys need no join at all.
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    both = earned.select("insured_id", "year", "_earned", none("_claims", "long"), none("_incurred", "double")).unionByName(
        losses.select("insured_id", "year", none("_earned", "decimal(38,6)"), "_claims", "_incurred")
    )
    both = both.groupBy("insured_id", "year").agg(*[F.max(c).alias(c) for c in ("_earned", "_claims", "_incurred")])
    both = both.join(insureds.select("insured_id", "fleet_size"), "insured_id", "left")
    n, incurred = F.coalesce("_claims", F.lit(0)), F.coalesce("_incurred", F.lit(0.0))
    premium = F.col("_earned").cast("double")
    return both.select(
        "insured_id",
        "year",
        n.alias("num_claims"),
        incurred.alias("total_incurred"),
        premium.alias("earned_premium"),
        F.round(F.try_divide(incurred * 100, premium), 4).alias("loss_ratio"),
        F.round(F.try_divide(n.cast("double"), F.col("fleet_size").cast("double")), 6).alias("frequency"),
        F.coalesce(F.try_divide(incurred, n.cast("double")), F.lit(0.0)).alias("severity"),
    )


def year_results(metrics: DataFrame, expense_ratio: float) -> DataFrame:
    """Company-wide ratios per calendar year; the combined ratio adds ``expense_ratio`` (percent)."""
    total = metrics.groupBy("year").agg(
        F.sum("num_claims").alias("num_claims"),
        F.sum(F.col("total_incurred").cast(_MONEY)).cast("double").alias("total_incurred"),
        F.sum(F.col("earned_premium").cast("decimal(24,6)")).cast("double").alias("earned_premium"),
    )
    ratio = F.try_divide(F.col("total_incurred") * 100, F.col("earned_premium"))
    return total.withColumn("loss_ratio", F.round(ratio, 4)).withColumn("combined_ratio", F.round(ratio + expense_ratio, 4))


def claims_on_terms(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """``claims`` with ``term_policy_id``, the policy whose term covers the loss date.

    That is the claim's own policy where its term covers the day, else the insured's policy with
    the latest effective date among those in force (ties: the greatest id), else null.  Terms are
    laid out by the months they touch, so a claim meets only terms of its insured and month.
    """
    terms = policies.select("policy_id", "insured_id", "effective_date", "expiration_date")
    covers = (F.col("loss_date") >= F.col("effective_date")) & (F.col("loss_date") < F.col("expiration_date"))
    # Sizes are guessed from the files, without the rows that months add: no broadcast of either.
    own = terms.select(F.col("policy_id").alias("_own"), "effective_date", "expiration_date").hint("merge")
    matched = claims.join(own, F.col("policy_id") == F.col("_own"), "left")
    matched = matched.withColumn("_own", F.when(covers, F.col("_own"))).drop("effective_date", "expiration_date")

    months = F.sequence(F.trunc("effective_date", "month"), F.date_sub("expiration_date", 1), F.expr("INTERVAL 1 MONTH"))
    laid = terms.where("expiration_date > effective_date").withColumn("_month", F.explode(months))
    other = laid.select(F.col("policy_id").alias("_term"), F.col("insured_id").alias("_insured"), "effective_date", "expiration_date", "_month")
    asked = matched.where("_own IS NULL").select("claim_id", "insured_id", "loss_date", F.trunc("loss_date", "month").alias("_at"))
    met = asked.join(other.hint("merge"), (F.col("insured_id") == F.col("_insured")) & (F.col("_at") == F.col("_month")) & covers)
    latest = met.groupBy("claim_id").agg(F.max(F.struct("effective_date", "_term"))["_term"].alias("_other"))
    found = join_same(matched, latest, ["claim_id"], "left")
    return found.select(*claims.columns, F.coalesce("_own", "_other").alias("term_policy_id"))


def term_losses(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """Losses of every policy term, and of every insured outside all terms (policy_id null)."""
    placed = claims_on_terms(claims, policies)
    losses = placed.groupBy(F.col("term_policy_id").alias("policy_id"), F.when(F.col("term_policy_id").isNull(), F.col("insured_id")).alias("_insured")).agg(
        F.count(F.lit(1)).alias("num_claims"), _incurred().alias("total_incurred")
    )
    terms = policies.select("policy_id", F.col("insured_id").alias("_holder"), F.col("written_premium").cast(_MONEY).cast("double").alias("written_premium"))
    # A policy is one row on both sides; the rows outside all terms match none.
    both = terms.join(losses, "policy_id", "full_outer")
    n, incurred = F.coalesce("num_claims", F.lit(0)), F.coalesce("total_incurred", F.lit(0.0))
    return both.select(
        "policy_id",
        F.coalesce("_holder", "_insured").alias("insured_id"),
        n.alias("num_claims"),
        incurred.alias("total_incurred"),
        "written_premium",
        F.round(F.try_divide(incurred * 100, F.col("written_premium")), 4).alias("loss_ratio"),
    )
