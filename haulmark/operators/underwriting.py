"""Submission queue, assessments, loss metrics, referral rules and pricing of accounts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.ranking import join_same, top_n
from haulmark.functions.text import normalize_ratio
from haulmark.sources.sizing import broadcast_if_small, within


def exact_mean(column: str, scale: int = 4) -> Column:
    """Mean whose sum is exact, so that it does not depend on the order of the rows."""
    return F.sum(F.col(column).cast(f"decimal(18,{scale})")).cast("double") / F.count(column)


def _listed(limit: int, *items: Column) -> Column:
    return F.slice(F.array_compact(F.array(*items)), 1, limit)


def _percent(ratio: Column) -> Column:
    """Whole percent as text, halves to the even number."""
    return F.concat(F.bround(ratio * 100, 0).cast("bigint").cast("string"), F.lit("%"))


# ---- queue -------------------------------------------------------------------


def score_submissions(submissions: DataFrame) -> DataFrame:
    """Add ai_score (0 to 100) and risk_level derived from the three-year loss ratio."""
    ratio = F.col("loss_ratio_3yr")
    percent = F.when(ratio > 1, ratio).otherwise(ratio * 100)
    score = F.when(ratio > 1, F.least(ratio.cast("int"), F.lit(100))).otherwise((ratio * 100).cast("int"))
    scaled_above = lambda pct, share: F.when(ratio > 1, ratio > pct).otherwise(ratio > share)
    risk = F.when(scaled_above(75, 0.75), "High").when(scaled_above(55, 0.55), "Medium").otherwise("Low")
    return submissions.withColumns({"ai_score": score, "risk_level": risk})


def ranked_queue(submissions: DataFrame, limit: int = 100) -> DataFrame:
    return (
        score_submissions(submissions)
        .orderBy(F.desc_nulls_last("loss_ratio_3yr"), F.asc("submission_id"))
        .limit(limit)
        .select(
            "submission_id",
            "company_name",
            "submission_date",
            "submission_status",
            "ai_score",
            "risk_level",
            "referral_required",
            "fleet_size",
            "loss_ratio_3yr",
        )
    )


def queue_kpis(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("n_queue"),
        F.count_if(F.col("submission_status") == "New").alias("n_new"),
        F.count_if(F.col("risk_level") == "High").alias("n_high"),
        F.count_if("referral_required").alias("n_referrals"),
        F.coalesce(F.avg(F.coalesce("ai_score", F.lit(0))).cast("int"), F.lit(0)).alias("avg_score"),
    )


def search_queue(queue: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case."""
    wanted = text.strip().lower()
    if not wanted:
        return queue
    return queue.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(wanted) for c in columns]))


def queue_tab(queue: DataFrame, tab: str) -> DataFrame:
    tabs = {
        "all": F.lit(True),
        "referral": F.coalesce("referral_required", F.lit(False)),
        "high": F.col("risk_level") == "High",
    }
    return queue.where(tabs[tab])


# ---- assessment --------------------------------------------------------------


def submission_summary(submissions: DataFrame, insureds: DataFrame, loss_runs: DataFrame) -> DataFrame:
    """Submissions with their insured and the aggregated loss history, if any."""
    history = loss_runs.groupBy("insured_id").agg(
        F.sum("num_claims").alias("num_claims"),
        F.sum("large_losses").alias("large_losses"),
        exact_mean("frequency", 6).alias("frequency"),
    )
    account = insureds.select(
        "insured_id",
        "safety_rating",
        "csa_unsafe_driving",
        "risk_tier",
        "telematics_provider",
        "dashcam_coverage_pct",
    )
    return submissions.join(account, "insured_id").join(history, "insured_id", "left")


def assess(summary: DataFrame) -> DataFrame:
    """Add assessment, confidence, risk_indicators (5 at most) and next_steps (4 at most)."""
    ratio = normalize_ratio(F.col("loss_ratio_3yr"))
    safety = F.upper(F.coalesce("safety_rating", F.lit("")))
    csa = F.coalesce(F.col("csa_unsafe_driving").cast("double"), F.lit(0.0))
    tier = F.coalesce("risk_tier", F.lit("Standard"))
    referral = F.coalesce("referral_required", F.lit(False))
    fleet = F.coalesce(F.col("fleet_size").cast("int"), F.lit(0))
    large = F.coalesce(F.col("large_losses").cast("int"), F.lit(0))
    dashcam = F.coalesce(F.col("dashcam_coverage_pct").cast("double"), F.lit(0.0))
    unsafe = safety.isin("CONDITIONAL", "UNSATISFACTORY")

    assessment = (
        F.when(referral | (ratio > 0.80) | (csa > 65), "REFER TO SENIOR UNDERWRITER")
        .when((ratio > 0.65) | (tier == "Non-standard"), "REVIEW REQUIRED")
        .when(unsafe, "REFER — SAFETY CONCERN")
        .otherwise("WITHIN APPETITE")
    )
    number = lambda c: c.cast("string")
    indicators = _listed(
        5,
        F.when(ratio > 0.75, F.concat(F.lit("Loss ratio "), _percent(ratio), F.lit(" exceeds 75% appetite threshold"))),
        F.when(csa > 65, F.concat(F.lit("CSA Unsafe Driving score "), number(csa), F.lit(" > 65 threshold"))),
        F.when(large > 1, F.concat(number(large), F.lit(" large losses (>$100K) in loss history"))),
        F.when(fleet >= 40, F.concat(F.lit("Large fleet ("), number(fleet), F.lit(" units) — concentration risk"))),
        F.when(unsafe, F.concat(F.lit("FMCSA safety rating: "), safety)),
        F.when(
            dashcam < 50,
            F.concat(F.lit("Dashcam coverage only "), _percent(dashcam / 100), F.lit(" of fleet")),
        ),
    )
    steps = _listed(
        4,
        F.when(referral, F.lit("Escalate to senior underwriter with referral memo")),
        F.when(ratio > 0.65, F.lit("Request 5-year loss runs and loss control report")),
        F.when(csa > 50, F.lit("Review FMCSA CSA profile and driver qualification files")),
        F.lit("Verify MVR reports are on file for all drivers"),
        F.lit("Confirm safety programme documentation with insured"),
    )
    return summary.withColumns(
        {
            "assessment": assessment,
            "confidence": F.when((ratio < 0.75) & ~referral, 0.88).otherwise(0.72),
            "risk_indicators": F.when(
                F.size(indicators) == 0, F.array(F.lit("No adverse indicators identified"))
            ).otherwise(indicators),
            "next_steps": steps,
        }
    )


def assess_from_queue(queue: DataFrame) -> DataFrame:
    """The same columns from the queue row alone, for submissions without an insured."""
    score = F.coalesce(F.col("ai_score"), F.lit(0))
    ratio = normalize_ratio(F.col("loss_ratio_3yr"))
    referral = F.coalesce("referral_required", F.lit(False))
    fleet = F.coalesce(F.col("fleet_size").cast("int"), F.lit(0))
    risk = F.coalesce("risk_level", F.lit("Low"))
    assessment = (
        F.when(referral | (risk == "High"), "REFER TO SENIOR UNDERWRITER")
        .when(risk == "Medium", "REVIEW REQUIRED")
        .otherwise("WITHIN APPETITE")
    )
    lead = F.concat(F.lit("Loss ratio "), _percent(ratio))
    indicators = _listed(
        5,
        F.when(ratio > 0.75, F.concat(lead, F.lit(" exceeds 75% appetite threshold"))).when(
            ratio > 0.55, F.concat(lead, F.lit(" approaching appetite limit"))
        ),
        F.when(fleet >= 40, F.concat(F.lit("Large fleet ("), fleet.cast("string"), F.lit(" units) — elevated exposure"))),
        F.when(risk == "High", F.lit("AI risk model flagged as High — manual review required")),
        F.when(referral, F.lit("Referral triggered — senior underwriter sign-off required")),
    )
    careful = risk.isin("High", "Medium")
    steps = _listed(
        4,
        F.when(ratio > 0.75, F.lit("Request 5-year loss runs and obtain loss control report")),
        F.when(referral, F.lit("Escalate to senior underwriter with referral memo")),
        F.when(careful, F.lit("Verify MVR reports for all listed drivers")),
        F.when(careful, F.lit("Confirm fleet maintenance programme is documented")),
        F.lit("Confirm coverage limits and deductible structure with broker"),
    )
    return queue.withColumns(
        {
            "assessment": assessment,
            "confidence": F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.45), score / 100)), 2),
            "risk_indicators": F.when(
                F.size(indicators) == 0, F.array(F.lit("No adverse indicators at this time"))
            ).otherwise(indicators),
            "next_steps": steps,
        }
    )


def assess_all(submissions: DataFrame, insureds: DataFrame, loss_runs: DataFrame) -> DataFrame:
    """Full assessment where the insured is known, queue assessment for the others."""
    result = ["submission_id", "assessment", "confidence", "risk_indicators", "next_steps"]
    full = assess(submission_summary(submissions, insureds, loss_runs)).select(*result)
    rest = submissions.join(full.select("submission_id"), "submission_id", "left_anti")
    return (
        full.withColumn("basis", F.lit("account"))
        .unionByName(assess_from_queue(score_submissions(rest)).select(*result).withColumn("basis", F.lit("queue")))
    )


def short_verdict(assessment: Column) -> Column:
    text = F.upper(F.coalesce(assessment, F.lit("REVIEW REQUIRED")))
    return (
        F.when(text.contains("REFER"), "REFER")
        .when(text.contains("APPROV"), "APPROVE")
        .when(text.contains("DECLIN"), "DECLINE")
        .otherwise("REVIEW")
    )


# ---- bands -------------------------------------------------------------------


def band(value: Column, bounds: list[float], names: list[str], closed_right: bool = False) -> Column:
    """Name of the interval a value falls in; bounds are upper limits in rising order."""
    arms = None
    for bound, name in zip(bounds, names):
        test = value <= bound if closed_right else value < bound
        arms = F.when(test, name) if arms is None else arms.when(test, name)
    return F.when(value.isNotNull(), arms.otherwise(names[-1]))


def loss_ratio_action(ratio_pct: Column) -> Column:
    return band(
        ratio_pct,
        [40, 55, 70, 90],
        ["AUTO_RENEW", "RENEW_AS_IS", "REVIEW_RATE", "RATE_INCREASE_OR_NON_RENEW", "DECLINE_OR_NON_RENEW"],
    )


def csa_grade(score: Column) -> Column:
    return band(score, [30, 50, 65], ["Preferred", "Acceptable", "Borderline", "Decline"])


def fleet_band(units: Column) -> Column:
    return band(units, [10, 25, 50, 100], ["1-10", "11-25", "26-50", "51-100", "100+"], closed_right=True)


def years_band(years: Column) -> Column:
    return band(years, [2, 5, 10], ["<2", "2-5", "5-10", "10+"])


def loss_ratio_band(ratio_pct: Column) -> Column:
    return band(ratio_pct, [50, 75, 100], ["<50%", "50-75%", "75-100%", ">100%"])


def multi_year_ratio(loss_runs: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Latest ratio, 3- and 5-year averages and the trend per insured and year."""
    ordered = Window.partitionBy("insured_id").orderBy("policy_year")
    previous = F.lag("loss_ratio").over(ordered)
    mean = lambda years: (
        F.sum(F.col("loss_ratio").cast("decimal(18,4)")).over(ordered.rowsBetween(1 - years, 0)).cast("double")
        / F.count("loss_ratio").over(ordered.rowsBetween(1 - years, 0))
    )
    trend = (
        F.when(previous.isNull(), "STABLE")
        .when(F.col("loss_ratio") < previous - tolerance, "IMPROVING")
        .when(F.col("loss_ratio") > previous + tolerance, "DETERIORATING")
        .otherwise("STABLE")
    )
    return loss_runs.select(
        "insured_id",
        "policy_year",
        F.col("loss_ratio").alias("ytd_ratio"),
        mean(3).alias("three_year_ratio"),
        mean(5).alias("five_year_ratio"),
        trend.alias("trend"),
    )


def loss_trend(metrics: DataFrame, segments: DataFrame, segment: str) -> DataFrame:
    """Straight-line projection of ratio, frequency and severity to the year after the last."""
    joined = metrics.join(segments.select("insured_id", segment), "insured_id")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    yearly = joined.groupBy(segment, "policy_year").agg(
        money("total_incurred").alias("_incurred"),
        money("earned_premium").alias("_earned"),
        F.sum("num_claims").alias("_claims"),
        F.count(F.lit(1)).alias("_accounts"),
    )
    x = F.col("policy_year").cast("double")
    series = yearly.select(
        segment,
        x.alias("x"),
        (F.col("_incurred") * 100 / F.col("_earned")).alias("ratio"),
        (F.col("_claims") / F.col("_accounts")).alias("frequency"),
        F.coalesce(F.try_divide(F.col("_incurred"), F.col("_claims")), F.lit(0.0)).alias("severity"),
    )
    aggs = [F.max("x").alias("_last")]
    for y in ("ratio", "frequency", "severity"):
        aggs += [F.regr_slope(y, "x").alias(f"{y}_slope"), F.regr_intercept(y, "x").alias(f"_{y}0")]
    fitted = series.groupBy(segment).agg(*aggs)
    next_year = F.col("_last") + 1
    return fitted.select(
        segment,
        next_year.cast("int").alias("projected_year"),
        *[F.round(f"{y}_slope", 4).alias(f"{y}_slope") for y in ("ratio", "frequency", "severity")],
        *[
            F.round(F.col(f"_{y}0") + F.col(f"{y}_slope") * next_year, 2).alias(f"{y}_next")
            for y in ("ratio", "frequency", "severity")
        ],
    )


# ---- referral, drivers, renewal ---------------------------------------------


def referral_triggers(
    submissions: DataFrame,
    insureds: DataFrame,
    drivers: DataFrame,
    claims: DataFrame,
    policies: DataFrame,
    high_value: list[str] | None = None,
) -> DataFrame:
    """The referral rules a submission with an insured breaks, as codes, and the tier they route to.

    A CSA score is the worst of the four; cargo is referred as HAZMAT or as of high value.  An
    insured with an active policy that is not to be renewed goes to the Reserve Committee, also
    when no rule is broken.  A value that is missing breaks no rule.
    """
    high_value = fv.HIGH_VALUE_CARGO if high_value is None else high_value
    driver_share = drivers.groupBy("insured_id").agg(
        (F.count_if(F.col("driver_status") == "Excluded") / F.count(F.lit(1))).alias("_excluded")
    )
    worst_claim = claims.groupBy("insured_id").agg(
        F.max("total_incurred").alias("_max_claim"), F.max("catastrophic_flag").alias("_fatal")
    )
    dropped = policies.where("policy_status = 'Active'").groupBy("insured_id").agg(
        F.bool_or(F.col("renewal_status") == "Non-Renew").alias("_non_renewed")
    )
    account = insureds.select("insured_id", *fv.CSA_SCORES, "years_in_business")
    both = (
        submissions.join(account, "insured_id")
        .join(driver_share, "insured_id", "left")
        .join(worst_claim, "insured_id", "left")
        .join(dropped, "insured_id", "left")
    )
    ratio = normalize_ratio(F.col("loss_ratio_3yr"))
    csa = F.greatest(*fv.CSA_SCORES)
    codes = F.array_compact(
        F.array(
            F.when(ratio > 0.60, F.lit("LOSS_RATIO")),
            F.when(csa > 50, F.lit("CSA_SCORE")),
            F.when(F.col("primary_commodity").contains("Petroleum"), F.lit("HAZMAT")),
            F.when(F.col("primary_commodity").isin(high_value), F.lit("HIGH_VALUE_CARGO")),
            F.when(F.col("_excluded") > 0.10, F.lit("EXCLUDED_DRIVERS")),
            F.when(F.col("_fatal"), F.lit("FATALITY")),
            F.when(F.col("years_in_business") < 2, F.lit("NEW_VENTURE")),
            F.when(F.col("_max_claim") > fv.LARGE_LOSS, F.lit("LARGE_CLAIM")),
        )
    )
    tier = (
        F.when(
            F.array_contains("triggers", "FATALITY")
            | F.coalesce(F.col("_max_claim") >= fv.RESERVE_COMMITTEE_CLAIM, F.lit(False))
            | F.coalesce("_non_renewed", F.lit(False)),
            "Reserve Committee",
        )
        .when(F.arrays_overlap("triggers", F.array(F.lit("HAZMAT"), F.lit("HIGH_VALUE_CARGO"))), "CCO")
        .when(F.array_contains("triggers", "LOSS_RATIO") | F.array_contains("triggers", "CSA_SCORE"), "VP UW")
        .when(F.size("triggers") > 0, "Claims Director")
        .otherwise("NONE")
    )
    return both.withColumn("triggers", codes).withColumn("tier", tier).select(
        "submission_id", "insured_id", "triggers", "tier"
    )


def driver_flags(drivers: DataFrame) -> DataFrame:
    """Six quality flags per driver and their number."""
    flags = {
        "low_experience": F.col("years_cdl_experience") < 2,
        "high_mvr": F.col("mvr_points") >= 4,
        "many_accidents": F.col("accidents_3yr") >= 2,
        "many_violations": F.col("violations_3yr") >= 3,
        "low_telematics": F.col("telematics_score") < 70,
        "disqualified": F.col("disqualifying_offense"),
    }
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    flagged = drivers.withColumns(flags)
    return flagged.withColumn("n_flags", reduce(lambda a, b: a + b, [F.col(k).cast("int") for k in flags]))


def worst_driver(flagged: DataFrame) -> DataFrame:
    """Driver with the most flags per fleet; ties go to the smaller id."""
    first = top_n(flagged, ["insured_id"], [F.desc("n_flags"), F.asc("driver_id")], 1)
    return first.select("insured_id", "driver_id", "n_flags")


def renewal_outcome(policies: DataFrame, loss_runs: DataFrame, claims: DataFrame, referrals: DataFrame) -> DataFrame:
    """Auto-Renew, Non-Renew or Review Required for every active policy.

    Not renewed: a catastrophic claim, a claim referred for suspected fraud, or a latest loss ratio
    above 90 %.  Renewed without review: below 50 % and never referred.  A missing ratio is reviewed.
    """
    last = top_n(loss_runs, ["insured_id"], [F.desc("policy_year")], 1).select(
        "insured_id", F.col("loss_ratio").alias("_ratio")
    )
    bad = F.coalesce("catastrophic_flag", F.lit(False)) | F.coalesce("siu_referral", F.lit(False))
    losses = claims.groupBy("insured_id").agg(F.bool_or(bad).alias("_bad"))
    referred = referrals.groupBy("insured_id").agg(F.count(F.lit(1)).alias("_refs"))
    both = (
        policies.where(F.col("policy_status") == "Active")
        .join(last, "insured_id", "left")
        .join(losses, "insured_id", "left")
        .join(referred, "insured_id", "left")
    )
    refs = F.coalesce("_refs", F.lit(0))
    outcome = (
        F.when(F.coalesce("_bad", F.lit(False)) | (F.col("_ratio") > 90), "Non-Renew")
        .when((F.col("_ratio") < 50) & (refs == 0), "Auto-Renew")
        .otherwise("Review Required")
    )
    return both.select("policy_id", "insured_id", outcome.alias("outcome"))


# ---- completeness, claims, portfolio ----------------------------------------


def completeness(submissions: DataFrame, received: str = "received_docs", required: list[str] | None = None) -> DataFrame:
    """Missing document types and the share received; ``received`` is an array column."""
    wanted = F.array(*[F.lit(d) for d in (required or fv.REQUIRED_DOCUMENTS)])
    missing = F.array_except(wanted, F.coalesce(received, F.array().cast("array<string>")))
    return submissions.withColumn("missing_docs", missing).withColumn(
        "completeness_pct",
        F.round((F.size(wanted) - F.size("missing_docs")) / F.size(wanted), 4),
    )


def claims_development(claims: DataFrame, large_loss: float = fv.LARGE_LOSS) -> DataFrame:
    """Reporting lag, open share, reserves, litigation and large losses by loss type."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    n = F.count(F.lit(1))
    return claims.groupBy("loss_type").agg(
        n.alias("n_claims"),
        F.count_if(F.col("claim_status") == "Open").alias("n_open"),
        F.avg(F.datediff("report_date", "loss_date")).alias("avg_report_lag"),
        money("total_incurred").alias("incurred"),
        money("total_paid").alias("paid"),
        money("case_reserves").alias("reserves"),
        F.count_if(F.col("attorney_involved")).alias("n_attorney"),
        F.count_if(F.col("litigation_status").isin("Pre-Suit", "Suit Filed", "Trial Set")).alias("n_litigated"),
        F.count_if(F.col("total_incurred") >= large_loss).alias("n_large"),
    )


def portfolio_mix(policies: DataFrame, insureds: DataFrame, segment: str) -> DataFrame:
    """Premium, share of all premium and number of policies per segment."""
    premium = policies.agg(F.sum(F.col("written_premium").cast("decimal(18,2)")).alias("p")).scalar()
    per_insured = policies.groupBy("insured_id").agg(
        F.sum(F.col("written_premium").cast("decimal(18,2)")).alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    grouped = per_insured.join(insureds.select("insured_id", segment), "insured_id").groupBy(segment)
    return grouped.agg(F.sum("_p").alias("_p"), F.sum("_n").alias("n_policies")).select(
        segment,
        "n_policies",
        F.col("_p").cast("double").alias("premium"),
        F.round(F.try_divide(F.col("_p").cast("double") * 100, premium.cast("double")), 4).alias("premium_pct"),
    )


def segment_growth(policies: DataFrame, loss_runs: DataFrame, insureds: DataFrame, segment: str) -> DataFrame:
    """Premium, growth and loss ratio per segment and year, and segments that outgrow their losses.

    A segment outgrows its losses when it grows faster than the book while its loss ratio is above
    that of the book.  Growth is against the year before; without premium then it is null.
    """
    cents = "decimal(18,2)"
    of = F.broadcast if within(insureds) else (lambda df: df)
    segments = of(insureds.select("insured_id", segment))
    premium = policies.groupBy("insured_id", F.col("policy_year").alias("year")).agg(F.sum(F.col("written_premium").cast(cents)).alias("_p"))
    losses = loss_runs.groupBy("insured_id", F.col("policy_year").alias("year")).agg(F.sum(F.col("total_incurred").cast(cents)).alias("_l"))
    none = lambda c: F.lit(None).cast("decimal(28,2)").alias(c)
    both = premium.select("insured_id", "year", "_p", none("_l")).unionByName(losses.select("insured_id", "year", none("_p"), "_l"))
    years = both.join(segments, "insured_id", "left").groupBy(segment, "year").agg(*[F.sum(c).cast("double").alias(c) for c in ("_p", "_l")])
    # From here on one row per segment and year.
    total = years.groupBy("year").agg(*[F.sum(F.col(c).cast("decimal(28,2)")).cast("double").alias(f"all{c}") for c in ("_p", "_l")])
    before = years.select(segment, (F.col("year") + 1).alias("year"), F.col("_p").alias("_before"))
    before_all = total.select((F.col("year") + 1).alias("year"), F.col("all_p").alias("_before_all"))
    rows = join_same(years, before, [segment, "year"], "left").join(total, "year").join(before_all, "year", "left")
    change = lambda now, then: F.try_divide((F.col(now) - F.col(then)) * 100, F.col(then))
    ratio = lambda part, whole: F.try_divide(F.coalesce(part, F.lit(0.0)) * 100, F.col(whole))
    growing = (change("_p", "_before") > change("all_p", "_before_all")) & (ratio("_l", "_p") > ratio("all_l", "all_p"))
    return rows.select(
        segment,
        "year",
        F.col("_p").alias("premium"),
        F.round(change("_p", "_before"), 4).alias("growth_pct"),
        F.round(ratio("_l", "_p"), 4).alias("loss_ratio"),
        F.coalesce(growing, F.lit(False)).alias("outgrows_losses"),
    )


def conversion(submissions: DataFrame, by: str) -> DataFrame:
    """How many submissions got how far, and the rates from step to step, per value of ``by``.

    Quoted are those with an offer: status Quoted, Bound or Lost.
    """
    status = F.col("submission_status")
    reached = {
        "n_reviewed": ~status.isin("Received", "New"),
        "n_quoted": status.isin("Quoted", "Bound", "Lost"),
        "n_bound": status == "Bound",
        "n_declined": status == "Declined",
    }
    counted = submissions.groupBy(by).agg(F.count(F.lit(1)).alias("n_submissions"), *[F.count_if(c).alias(n) for n, c in reached.items()])
    rate = lambda part, whole: F.round(F.try_divide(F.col(part) * F.lit(100.0), F.col(whole).cast("double")), 4)
    return counted.withColumns(
        {
            "quote_pct": rate("n_quoted", "n_submissions"),
            "bind_pct": rate("n_bound", "n_quoted"),
            "conversion_pct": rate("n_bound", "n_submissions"),
            "decline_pct": rate("n_declined", "n_submissions"),
        }
    )


def submission_funnel(submissions: DataFrame) -> DataFrame:
    """Counts, premium change and days to quote by status; new business without an expiring premium has no change."""
    n = F.count(F.lit(1))
    total = submissions.agg(F.count(F.lit(1)).alias("n")).scalar()
    change = F.try_divide((F.col("quoted_premium") - F.col("expiring_premium")) * 100, F.col("expiring_premium"))
    return submissions.groupBy("submission_status").agg(
        n.alias("n_submissions"),
        F.round(n * 100 / total, 4).alias("share_pct"),
        F.round(F.avg(change), 4).alias("avg_change_pct"),
        F.round(F.avg("days_to_quote"), 4).alias("avg_days_to_quote"),
    )


# ---- pricing and appetite ----------------------------------------------------


@dataclass(frozen=True)
class Rates:
    """Rates of an indication, as shares of the manual premium.

    Every band list holds (bound, share), highest bound first: the first bound that the value is
    above (``deductible``, ``dashcam``, ``years``: at or above) decides; below all of them it is 0.
    """

    base: float
    expense: float
    loss: tuple[tuple[float, float], ...] = ((90, 0.50), (70, 0.25), (55, 0.10))
    csa: tuple[tuple[float, float], ...] = ((80, 0.25), (65, 0.20), (50, 0.15))
    deductible: tuple[tuple[float, float], ...] = ((5000, 0.10),)
    dashcam: tuple[tuple[float, float], ...] = ((100, 0.10), (50, 0.05))
    years: tuple[tuple[float, float], ...] = ((20, 0.05),)


def _share(value: Column, bands: tuple[tuple[float, float], ...], reached: bool = False) -> Column:
    cases = [F.when(value >= bound if reached else value > bound, F.lit(float(share))) for bound, share in bands]
    return F.coalesce(*cases, F.lit(0.0))


def rating_accounts(insureds: DataFrame, loss_runs: DataFrame, policies: DataFrame) -> DataFrame:
    """Insureds with loss_ratio_pct (mean of the last three loss runs) and deductible (the least of
    the active policies); both are null where there is nothing to take them from."""
    latest = top_n(multi_year_ratio(loss_runs), ["insured_id"], [F.desc("policy_year")], 1)
    ratio = latest.select("insured_id", F.col("three_year_ratio").alias("loss_ratio_pct"))
    chosen = policies.where("policy_status = 'Active'").groupBy("insured_id").agg(F.min("deductible").alias("deductible"))
    return insureds.join(ratio, "insured_id", "left").join(chosen, "insured_id", "left")


def premium_indication(accounts: DataFrame, rates: Rates, territory: DataFrame, commodity: DataFrame) -> DataFrame:
    """Base x fleet x territory x commodity, plus surcharges for losses and CSA scores, less credits
    for deductible, cameras and years in business, plus expense.

    ``accounts`` are those of ``rating_accounts``.  ``territory`` (state_domicile, territory_factor)
    and ``commodity`` (primary_commodity, commodity_factor) are rate tables; a value that is not
    listed has factor 1, a missing one no surcharge and no credit.
    """
    rated = accounts.join(broadcast_if_small(territory), "state_domicile", "left").join(
        broadcast_if_small(commodity), "primary_commodity", "left"
    )
    manual = (
        F.lit(rates.base)
        * F.col("fleet_size")
        * F.coalesce("territory_factor", F.lit(1.0))
        * F.coalesce("commodity_factor", F.lit(1.0))
    )
    loss = _share(F.col("loss_ratio_pct"), rates.loss)
    csa = _share(F.greatest(*fv.CSA_SCORES), rates.csa)
    credit = (
        _share(F.col("deductible"), rates.deductible, reached=True)
        + _share(F.col("dashcam_coverage_pct"), rates.dashcam, reached=True)
        + _share(F.col("years_in_business"), rates.years, reached=True)
    )
    return rated.select(
        "insured_id",
        F.round(manual, 2).alias("manual_premium"),
        F.round(manual * loss, 2).alias("loss_surcharge"),
        F.round(manual * csa, 2).alias("csa_surcharge"),
        F.round(manual * credit, 2).alias("credits"),
        F.round(manual * (1 + loss + csa - credit) + rates.expense, 2).alias("indicated_premium"),
    )


def appetite_fit(summary: DataFrame) -> DataFrame:
    """Weighted share of satisfied appetite rules and one finding per broken rule."""
    ratio = normalize_ratio(F.col("loss_ratio_3yr"))
    rules = [
        ("LOSS_RATIO", 3, ratio <= 0.75, "Appetite limit 75%", "Refer to senior underwriter", F.concat(F.lit("3-year loss ratio "), _percent(ratio))),
        ("CSA", 2, F.coalesce(F.col("csa_unsafe_driving"), F.lit(0.0)) <= 65, "CSA limit 65", "Review CSA profile", F.concat(F.lit("CSA "), F.col("csa_unsafe_driving").cast("string"))),
        ("SAFETY_RATING", 2, F.coalesce(F.col("safety_rating") == "Satisfactory", F.lit(False)), "Rating must be Satisfactory", "Refer for safety", F.concat(F.lit("Rating "), F.coalesce("safety_rating", F.lit("none")))),
        ("COMMODITY", 1, ~F.col("primary_commodity").contains("Petroleum"), "HAZMAT needs referral", "Refer to senior underwriter", F.concat(F.lit("Commodity "), F.col("primary_commodity"))),
        ("TELEMATICS", 1, F.col("telematics_provider").isNotNull(), "Telematics expected", "Ask for telematics plan", F.lit("No provider")),
    ]
    weight = sum(r[1] for r in rules)
    met = reduce(lambda a, b: a + b, [F.when(r[2], r[1]).otherwise(0) for r in rules])
    findings = F.array_compact(
        F.array(
            *[
                F.when(
                    ~ok,
                    F.struct(
                        F.lit(code).alias("finding"),
                        evidence.alias("evidence"),
                        F.lit(rule).alias("rule"),
                        F.lit(round(w / weight, 4)).alias("confidence"),
                        F.lit(action).alias("action"),
                    ),
                )
                for code, w, ok, rule, action, evidence in rules
            ]
        )
    )
    return summary.withColumns({"fit_score": F.round(met / F.lit(float(weight)), 4), "findings": findings})
