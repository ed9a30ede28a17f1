"""Answers to the structured questions, as parametrised frames.

Every function answers its question for all accounts or segments at once; pass ``account``
to restrict it to companies whose name contains a text, ignoring case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.operators.underwriting import exact_mean
from haulmark.sources.sizing import broadcast_if_small


def rows() -> Column:
    return F.count(F.lit(1))


def money(column: str) -> Column:
    """Exact sum of amounts in cents."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def named(accounts: DataFrame, account: str | None) -> DataFrame:
    return accounts if account is None else accounts.where(F.col("company_name").ilike(f"%{account}%"))


def of_account(df: DataFrame, insureds: DataFrame, account: str | None = None) -> DataFrame:
    """Rows of an operational table with the company name of their account."""
    names = named(insureds, account).select("insured_id", "company_name")
    return df.join(names, "insured_id")


def fleet_overview(insureds: DataFrame) -> DataFrame:
    """Number of accounts and their average fleet."""
    return insureds.agg(rows().alias("n_insureds"), F.avg("fleet_size").alias("avg_fleet"))


def accounts_where(insureds: DataFrame, condition: Column) -> DataFrame:
    return insureds.where(condition).select("insured_id", "company_name", "fleet_size", "risk_tier", "safety_rating")


def premium_of(policies: DataFrame, condition: Column) -> DataFrame:
    return policies.where(condition).agg(rows().alias("n_policies"), money("written_premium").alias("premium"))


def premium_by_line(policies: DataFrame) -> DataFrame:
    return policies.groupBy("line_of_business").agg(
        rows().alias("n_policies"), exact_mean("written_premium", 2).alias("avg_premium")
    )


def driver_counts(drivers: DataFrame, insureds: DataFrame, condition: Column, account: str | None = None) -> DataFrame:
    """Drivers meeting a condition, per account."""
    counted = drivers.where(condition).groupBy("insured_id").agg(rows().alias("n_drivers"))
    return of_account(counted, insureds, account)


def driver_list(drivers: DataFrame, insureds: DataFrame, condition: Column, account: str | None = None) -> DataFrame:
    """The drivers that meet a condition, with their account."""
    columns = ["insured_id", "driver_id", "first_name", "driver_status", "mvr_points", "accidents_3yr"]
    return of_account(drivers.where(condition).select(*columns), insureds, account)


def claim_list(claims: DataFrame, insureds: DataFrame, condition: Column, account: str | None = None) -> DataFrame:
    """The claims that meet a condition, with their account; claims of unknown accounts stay."""
    columns = ["insured_id", "claim_id", "policy_id", "loss_date", "loss_type", "claim_status", "total_incurred"]
    names = named(insureds, account).select("insured_id", "company_name")
    return claims.where(condition).select(*columns).join(names, "insured_id", "left" if account is None else "inner")


def policies_above_ratio(policies: DataFrame, loss_runs: DataFrame, percent: float = 100.0) -> DataFrame:
    """Policies whose account and year have a loss ratio above ``percent``."""
    bad = loss_runs.where(F.col("loss_ratio") > percent).select("insured_id", "policy_year", "loss_ratio")
    return policies.select("policy_id", "insured_id", "policy_year", "line_of_business").join(bad, ["insured_id", "policy_year"])


def safety_profile(insureds: DataFrame, drivers: DataFrame, claims: DataFrame, account: str | None = None) -> DataFrame:
    """Safety figures of accounts side by side: ratings and scores, drivers, accidents, claims."""
    crew = drivers.groupBy("insured_id").agg(
        rows().alias("n_drivers"), exact_mean("mvr_points", 0).alias("avg_mvr"), F.sum("accidents_3yr").alias("accidents"), F.sum("violations_3yr").alias("violations")
    )
    losses = claims.groupBy("insured_id").agg(rows().alias("n_claims"))
    wanted = named(insureds, account).select(
        "insured_id", "company_name", "safety_rating", "csa_unsafe_driving", "csa_hos", "csa_vehicle_maint", "dashcam_coverage_pct", "fleet_size"
    )
    both = wanted.join(crew, "insured_id", "left").join(losses, "insured_id", "left")
    return both.fillna(0, ["n_drivers", "accidents", "violations", "n_claims"]).withColumn(
        "claims_per_unit", F.round(F.try_divide(F.col("n_claims").cast("double"), F.col("fleet_size").cast("double")), 6)
    )


def average_telematics(drivers: DataFrame) -> DataFrame:
    active = drivers.where(F.col("driver_status") == "Active")
    return active.agg(rows().alias("n_active"), exact_mean("telematics_score", 1).alias("avg_score"))


def claim_totals(claims: DataFrame, condition: Column) -> DataFrame:
    return claims.where(condition).agg(rows().alias("n_claims"), money("total_incurred").alias("incurred"))


def claims_by_account(claims: DataFrame, insureds: DataFrame, account: str | None = None) -> DataFrame:
    totals = claims.groupBy("insured_id").agg(
        rows().alias("n_claims"),
        F.count_if(F.col("claim_status") == "Open").alias("n_open"),
        money("total_incurred").alias("incurred"),
    )
    return of_account(totals, insureds, account)


def submissions_where(submissions: DataFrame, condition: Column) -> DataFrame:
    return submissions.where(condition).select(
        "submission_id", "company_name", "submission_status", "referral_required", "decline_reason"
    )


def average_days_to_quote(submissions: DataFrame) -> DataFrame:
    return submissions.agg(F.count("days_to_quote").alias("n_quoted"), F.avg("days_to_quote").alias("avg_days"))


def ratio_by_period(loss_runs: DataFrame, insureds: DataFrame, account: str | None = None) -> DataFrame:
    periods = loss_runs.select("insured_id", "policy_year", "loss_ratio", "num_claims")
    return of_account(periods, insureds, account)


def earned_premium(loss_runs: DataFrame) -> DataFrame:
    return loss_runs.agg(money("earned_premium").alias("earned_premium"))


def referral_decisions(referrals: DataFrame, condition: Column) -> DataFrame:
    return referrals.where(condition).select("referral_id", "insured_id", "referral_reason", "referral_tier", "decision")


def referral_reasons(referrals: DataFrame) -> DataFrame:
    return referrals.groupBy("referral_reason").agg(rows().alias("n_referrals"))


def account_overview(loss_runs: DataFrame, drivers: DataFrame, insureds: DataFrame) -> DataFrame:
    """Mean loss ratio and drivers of every account."""
    ratio = loss_runs.groupBy("insured_id").agg(exact_mean("loss_ratio").alias("avg_ratio"))
    crew = drivers.groupBy("insured_id").agg(rows().alias("n_drivers"))
    both = of_account(ratio, insureds).join(crew, "insured_id", "left")
    return both.withColumn("n_drivers", F.coalesce("n_drivers", F.lit(0)))


def compare_accounts(loss_runs: DataFrame, insureds: DataFrame) -> DataFrame:
    """Loss ratio of every account and year, each next to the mean of all accounts in that year."""
    rows = ratio_by_period(loss_runs, insureds).groupBy("company_name", "policy_year").agg(F.max("loss_ratio").alias("loss_ratio"))
    year = rows.groupBy("policy_year").agg(
        (F.sum(F.col("loss_ratio").cast("decimal(18,4)")).cast("double") / F.count("loss_ratio")).alias("year_ratio")
    )
    # One row per year.
    return rows.join(broadcast_if_small(year), "policy_year", "left")


def claims_in_month(claims: DataFrame, as_of: Column) -> DataFrame:
    """Claims of the calendar month before ``as_of``."""
    first = F.trunc(F.add_months(as_of, -1), "month")
    last = F.trunc(as_of, "month")
    month = claims.where((F.col("loss_date") >= first) & (F.col("loss_date") < last))
    return month.groupBy("loss_type").agg(rows().alias("n_claims"), money("total_incurred").alias("incurred"))


def premium_share(policies: DataFrame, insureds: DataFrame) -> DataFrame:
    """Premium at stake with every account and its share of the whole book."""
    total = policies.agg(money("written_premium").alias("p")).scalar()
    own = policies.groupBy("insured_id").agg(money("written_premium").alias("premium"))
    return of_account(own, insureds).withColumn("share_pct", F.round(F.col("premium") * 100 / total, 6))


def latest_periods(loss_runs: DataFrame, n: int = 3) -> DataFrame:
    from haulmark.functions.ranking import top_n

    return top_n(loss_runs, ["insured_id"], [F.desc("policy_year")], n).select(
        "insured_id", "policy_year", "num_claims", "total_incurred", "loss_ratio", "rank"
    )


def largest_open_claims(claims: DataFrame, n: int = 10) -> DataFrame:
    from haulmark.functions.ranking import top_n

    open_ = claims.where(F.col("claim_status") == "Open")
    order = [F.desc("total_incurred"), F.asc("claim_id")]
    return top_n(open_, ["insured_id"], order, n).select("insured_id", "claim_id", "loss_type", "total_incurred", "rank")
