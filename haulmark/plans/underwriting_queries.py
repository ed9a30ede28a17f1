"""Queries over the operational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.operators import accounts, experience, questions as qs
from haulmark.operators import underwriting as uw
from haulmark.plans import check_sql as cs
from haulmark.plans.models import table, with_models
from haulmark.plans.registry import query
from haulmark.sources.sizing import materialize

# ---- queue -------------------------------------------------------------------

_SCORED = {
    "scored": """SELECT *, CASE WHEN loss_ratio_3yr > 1 THEN least(CAST(trunc(loss_ratio_3yr) AS BIGINT), 100) ELSE CAST(trunc(loss_ratio_3yr * 100) AS BIGINT) END AS ai_score,
        CASE WHEN CASE WHEN loss_ratio_3yr > 1 THEN loss_ratio_3yr > 75 ELSE loss_ratio_3yr > 0.75 END THEN 'High'
             WHEN CASE WHEN loss_ratio_3yr > 1 THEN loss_ratio_3yr > 55 ELSE loss_ratio_3yr > 0.55 END THEN 'Medium' ELSE 'Low' END AS risk_level FROM submissions"""
}


def _sql(body: str, *models: str, **extra: str) -> str:
    return with_models(body, *models, extra=extra)


_QUEUE = """SELECT submission_id, company_name, submission_date, submission_status, ai_score, risk_level, referral_required, fleet_size, loss_ratio_3yr
    FROM scored ORDER BY loss_ratio_3yr DESC NULLS LAST, submission_id LIMIT 100"""


@query("u01_ranked_queue", _sql(_QUEUE, "submissions", **_SCORED))
def u01(spark, sf):
    return uw.ranked_queue(table(spark, sf, "submissions"))


@query(
    "u02_queue_kpis",
    _sql(
        """SELECT count(*) AS n_queue, count(*) FILTER (WHERE submission_status = 'New') AS n_new, count(*) FILTER (WHERE risk_level = 'High') AS n_high,
                  count(*) FILTER (WHERE referral_required) AS n_referrals, CAST(trunc(avg(COALESCE(ai_score, 0))) AS BIGINT) AS avg_score FROM scored""",
        "submissions",
        **_SCORED,
    ),
)
def u02(spark, sf):
    return uw.queue_kpis(uw.score_submissions(table(spark, sf, "submissions")))


@query(
    "u03_queue_search",
    _sql(
        "SELECT submission_id, company_name, broker_name FROM submissions WHERE contains(lower(company_name), '00042') OR contains(lower(submission_id), '00042') OR contains(lower(broker_name), '00042') OR contains(lower(broker_name), 'broker 7')",
        "submissions",
    ),
)
def u03(spark, sf):
    columns = ["company_name", "submission_id", "broker_name"]
    submissions = table(spark, sf, "submissions").select(*columns)
    by_name = uw.search_queue(submissions, "00042", columns)
    return by_name.unionByName(uw.search_queue(submissions, "Broker 7", columns)).distinct()


@query(
    "u03_queue_tabs",
    _sql(
        """SELECT 'all' AS tab, count(*) AS n_rows FROM scored UNION ALL SELECT 'referral', count(*) FROM scored WHERE referral_required
           UNION ALL SELECT 'high', count(*) FROM scored WHERE risk_level = 'High'""",
        "submissions",
        **_SCORED,
    ),
)
def u03_tabs(spark, sf):
    queue = uw.score_submissions(table(spark, sf, "submissions"))
    counts = [
        uw.queue_tab(queue, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("tab"), "n_rows")
        for t in ("all", "referral", "high")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ---- assessment --------------------------------------------------------------

_SUMMARY = {
    "summary": """SELECT s.*, i.safety_rating, i.csa_unsafe_driving, i.risk_tier, i.telematics_provider, i.dashcam_coverage_pct,
               l.num_claims, l.large_losses, l.frequency
        FROM submissions s JOIN insureds i ON s.insured_id = i.insured_id
        LEFT JOIN (SELECT insured_id, CAST(sum(num_claims) AS BIGINT) AS num_claims, CAST(sum(large_losses) AS BIGINT) AS large_losses,
                          CAST(sum(CAST(frequency AS DECIMAL(18, 6))) AS DOUBLE) / count(frequency) AS frequency FROM loss_runs GROUP BY insured_id) l
          ON l.insured_id = i.insured_id"""
}
_RATIO = "CASE WHEN COALESCE(loss_ratio_3yr, 0) > 1 THEN loss_ratio_3yr / 100 ELSE COALESCE(loss_ratio_3yr, 0) END"
_PCT = "concat(CAST(CAST(round_even(ratio * 100, 0) AS BIGINT) AS VARCHAR), '%')"


@query(
    "u04_submission_summary",
    _sql(
        """SELECT submission_id, insured_id, company_name, safety_rating, csa_unsafe_driving, risk_tier, dashcam_coverage_pct, num_claims, large_losses, frequency
           FROM summary""",
        "submissions",
        "insureds",
        "loss_runs",
        **_SUMMARY,
    ),
)
def u04(spark, sf):
    return _summary(spark, sf).select(
        "submission_id",
        "insured_id",
        "company_name",
        "safety_rating",
        "csa_unsafe_driving",
        "risk_tier",
        "dashcam_coverage_pct",
        "num_claims",
        "large_losses",
        "frequency",
    )


def _summary(spark, sf):
    return uw.submission_summary(
        table(spark, sf, "submissions"), table(spark, sf, "insureds"), table(spark, sf, "loss_runs")
    )


def _first(limit: int, items: list[str]) -> str:
    return f"array_to_string([x FOR x IN [{', '.join(items)}] IF x IS NOT NULL][1:{limit}], '|')"


_ASSESSED = {
    **_SUMMARY,
    "inputs": f"SELECT *, {_RATIO} AS ratio, upper(COALESCE(safety_rating, '')) AS safety, COALESCE(csa_unsafe_driving, 0) AS csa FROM summary",
    "full_assessment": f"""
        SELECT submission_id,
               CASE WHEN referral_required OR ratio > 0.80 OR csa > 65 THEN 'REFER TO SENIOR UNDERWRITER'
                    WHEN ratio > 0.65 OR risk_tier = 'Non-standard' THEN 'REVIEW REQUIRED'
                    WHEN safety IN ('CONDITIONAL', 'UNSATISFACTORY') THEN 'REFER — SAFETY CONCERN' ELSE 'WITHIN APPETITE' END AS assessment,
               CAST(CASE WHEN ratio < 0.75 AND NOT referral_required THEN 0.88 ELSE 0.72 END AS DOUBLE) AS confidence,
               COALESCE(NULLIF({_first(5, [
                   f"CASE WHEN ratio > 0.75 THEN concat('Loss ratio ', {_PCT}, ' exceeds 75% appetite threshold') END",
                   "CASE WHEN csa > 65 THEN concat('CSA Unsafe Driving score ', CAST(csa AS VARCHAR), ' > 65 threshold') END",
                   "CASE WHEN large_losses > 1 THEN concat(CAST(large_losses AS VARCHAR), ' large losses (>$100K) in loss history') END",
                   "CASE WHEN fleet_size >= 40 THEN concat('Large fleet (', CAST(fleet_size AS VARCHAR), ' units) — concentration risk') END",
                   "CASE WHEN safety IN ('CONDITIONAL', 'UNSATISFACTORY') THEN concat('FMCSA safety rating: ', safety) END",
                   "CASE WHEN COALESCE(dashcam_coverage_pct, 0) < 50 THEN concat('Dashcam coverage only ', CAST(CAST(dashcam_coverage_pct AS BIGINT) AS VARCHAR), '% of fleet') END",
               ])}, ''), 'No adverse indicators identified') AS risk_indicators,
               {_first(4, [
                   "CASE WHEN referral_required THEN 'Escalate to senior underwriter with referral memo' END",
                   "CASE WHEN ratio > 0.65 THEN 'Request 5-year loss runs and loss control report' END",
                   "CASE WHEN csa > 50 THEN 'Review FMCSA CSA profile and driver qualification files' END",
                   "'Verify MVR reports are on file for all drivers'",
                   "'Confirm safety programme documentation with insured'",
               ])} AS next_steps, 'account' AS basis
        FROM inputs""",
    "queue_rows": f"""SELECT *, {_RATIO} AS ratio FROM scored WHERE submission_id NOT IN (SELECT submission_id FROM full_assessment)""",
    "queue_assessment": f"""
        SELECT submission_id,
               CASE WHEN referral_required OR risk_level = 'High' THEN 'REFER TO SENIOR UNDERWRITER' WHEN risk_level = 'Medium' THEN 'REVIEW REQUIRED' ELSE 'WITHIN APPETITE' END AS assessment,
               round(least(CAST(0.97 AS DOUBLE), greatest(CAST(0.45 AS DOUBLE), COALESCE(ai_score, 0) / 100)), 2) AS confidence,
               COALESCE(NULLIF({_first(5, [
                   f"CASE WHEN ratio > 0.75 THEN concat('Loss ratio ', {_PCT}, ' exceeds 75% appetite threshold') WHEN ratio > 0.55 THEN concat('Loss ratio ', {_PCT}, ' approaching appetite limit') END",
                   "CASE WHEN fleet_size >= 40 THEN concat('Large fleet (', CAST(fleet_size AS VARCHAR), ' units) — elevated exposure') END",
                   "CASE WHEN risk_level = 'High' THEN 'AI risk model flagged as High — manual review required' END",
                   "CASE WHEN referral_required THEN 'Referral triggered — senior underwriter sign-off required' END",
               ])}, ''), 'No adverse indicators at this time') AS risk_indicators,
               {_first(4, [
                   "CASE WHEN ratio > 0.75 THEN 'Request 5-year loss runs and obtain loss control report' END",
                   "CASE WHEN referral_required THEN 'Escalate to senior underwriter with referral memo' END",
                   "CASE WHEN risk_level IN ('High', 'Medium') THEN 'Verify MVR reports for all listed drivers' END",
                   "CASE WHEN risk_level IN ('High', 'Medium') THEN 'Confirm fleet maintenance programme is documented' END",
                   "'Confirm coverage limits and deductible structure with broker'",
               ])} AS next_steps, 'queue' AS basis
        FROM queue_rows""",
}
_ASSESS = ("submissions", "insureds", "loss_runs")


@query("u05_assessment", _sql("SELECT * EXCLUDE (basis) FROM full_assessment", *_ASSESS, **_ASSESSED))
def u05(spark, sf):
    return uw.assess(_summary(spark, sf)).select(
        "submission_id", "assessment", "confidence", "risk_indicators", "next_steps"
    )


@query(
    "u06_assess_all",
    _sql(
        "SELECT * FROM full_assessment UNION ALL SELECT * FROM queue_assessment", *_ASSESS, **{**_SCORED, **_ASSESSED}
    ),
)
def u06(spark, sf):
    return uw.assess_all(
        table(spark, sf, "submissions"), table(spark, sf, "insureds"), table(spark, sf, "loss_runs")
    )


@query(
    "u07_short_verdicts",
    _sql(
        """SELECT CASE WHEN contains(upper(assessment), 'REFER') THEN 'REFER' WHEN contains(upper(assessment), 'APPROV') THEN 'APPROVE'
                       WHEN contains(upper(assessment), 'DECLIN') THEN 'DECLINE' ELSE 'REVIEW' END AS verdict, count(*) AS n_submissions
           FROM (SELECT * FROM full_assessment UNION ALL SELECT * FROM queue_assessment) GROUP BY 1""",
        *_ASSESS,
        **{**_SCORED, **_ASSESSED},
    ),
)
def u07(spark, sf):
    return u06(spark, sf).groupBy(uw.short_verdict(F.col("assessment")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("n_submissions")
    )


# ---- loss metrics ------------------------------------------------------------


# Premium by calendar year, claims by loss date: written from the definitions of the ratios.
_EXPERIENCE = {
    "earned_days": """
        SELECT insured_id, y AS year, written_premium, date_diff('day', effective_date, expiration_date) AS term_days,
               date_diff('day', greatest(effective_date, make_date(y, 1, 1)), least(expiration_date, make_date(y + 1, 1, 1))) AS year_days
        FROM policies, range(1980, 2030) AS years(y)
        WHERE y BETWEEN year(effective_date) AND year(expiration_date - INTERVAL 1 DAY)""",
    "earned_years": """
        SELECT insured_id, year, sum(CAST(written_premium * (CAST(year_days AS DOUBLE) / term_days) AS DECIMAL(24, 6))) AS earned FROM earned_days GROUP BY ALL""",
    "loss_years": """
        SELECT insured_id, year(loss_date) AS year, count(*) AS n, CAST(sum(CAST(total_incurred AS DECIMAL(18, 2))) AS DOUBLE) AS incurred FROM claims GROUP BY ALL""",
    "metrics": """
        SELECT coalesce(e.insured_id, l.insured_id) AS insured_id, coalesce(e.year, l.year) AS year, coalesce(n, 0) AS num_claims,
               coalesce(incurred, 0) AS total_incurred, CAST(earned AS DOUBLE) AS earned_premium
        FROM earned_years e FULL OUTER JOIN loss_years l ON e.insured_id IS NOT DISTINCT FROM l.insured_id AND e.year = l.year""",
}


@query(
    "u08_loss_metrics",
    _sql(
        """SELECT m.*, round(total_incurred * 100 / nullif(earned_premium, 0), 4) AS loss_ratio, round(CAST(num_claims AS DOUBLE) / fleet_size, 6) AS frequency,
                  CASE WHEN num_claims = 0 THEN 0 ELSE total_incurred / num_claims END AS severity
           FROM metrics m LEFT JOIN insureds i ON i.insured_id = m.insured_id""",
        "policies",
        "claims",
        "insureds",
        **_EXPERIENCE,
    ),
)
def u08(spark, sf):
    return experience.loss_metrics(table(spark, sf, "policies"), table(spark, sf, "claims"), table(spark, sf, "insureds"))


_EXPENSE_RATIO = 30.0


@query(
    "u08_year_results",
    _sql(
        f"""SELECT year, CAST(sum(num_claims) AS BIGINT) AS num_claims, CAST(sum(CAST(total_incurred AS DECIMAL(18, 2))) AS DOUBLE) AS total_incurred,
                   CAST(sum(CAST(earned_premium AS DECIMAL(24, 6))) AS DOUBLE) AS earned_premium,
                   round(CAST(sum(CAST(total_incurred AS DECIMAL(18, 2))) AS DOUBLE) * 100 / CAST(sum(CAST(earned_premium AS DECIMAL(24, 6))) AS DOUBLE), 4) AS loss_ratio,
                   round(CAST(sum(CAST(total_incurred AS DECIMAL(18, 2))) AS DOUBLE) * 100 / CAST(sum(CAST(earned_premium AS DECIMAL(24, 6))) AS DOUBLE) + {_EXPENSE_RATIO}, 4) AS combined_ratio
            FROM metrics GROUP BY year""",
        "policies",
        "claims",
        **_EXPERIENCE,
    ),
)
def u08_years(spark, sf):
    metrics = experience.loss_metrics(table(spark, sf, "policies"), table(spark, sf, "claims"), table(spark, sf, "insureds"))
    return experience.year_results(metrics, _EXPENSE_RATIO)


@query(
    "u08_term_losses",
    _sql(
        """SELECT p.policy_id, coalesce(p.insured_id, l.insured_id) AS insured_id, coalesce(n, 0) AS num_claims, coalesce(incurred, 0) AS total_incurred,
                  CAST(CAST(written_premium AS DECIMAL(18, 2)) AS DOUBLE) AS written_premium,
                  round(coalesce(incurred, 0) * 100 / nullif(CAST(CAST(written_premium AS DECIMAL(18, 2)) AS DOUBLE), 0), 4) AS loss_ratio
           FROM policies p FULL OUTER JOIN (
             SELECT term, CASE WHEN term IS NULL THEN insured_id END AS insured_id, count(*) AS n, CAST(sum(CAST(total_incurred AS DECIMAL(18, 2))) AS DOUBLE) AS incurred
             FROM in_force GROUP BY ALL) l ON l.term = p.policy_id""",
        "policies",
        "claims",
        in_force="""
            SELECT c.claim_id, c.insured_id, c.total_incurred, p.policy_id AS term
            FROM claims c LEFT JOIN policies p ON (p.policy_id = c.policy_id OR p.insured_id = c.insured_id)
              AND c.loss_date >= p.effective_date AND c.loss_date < p.expiration_date
            QUALIFY row_number() OVER (PARTITION BY c.claim_id ORDER BY p.policy_id = c.policy_id DESC NULLS LAST, p.effective_date DESC, p.policy_id DESC) = 1""",
    ),
)
def u08_terms(spark, sf):
    return experience.term_losses(table(spark, sf, "claims"), table(spark, sf, "policies"))


@query(
    "u09_bands",
    _sql(
        """SELECT i.insured_id,
                  CASE WHEN csa_unsafe_driving < 30 THEN 'Preferred' WHEN csa_unsafe_driving < 50 THEN 'Acceptable' WHEN csa_unsafe_driving < 65 THEN 'Borderline' ELSE 'Decline' END AS csa_grade,
                  CASE WHEN fleet_size <= 10 THEN '1-10' WHEN fleet_size <= 25 THEN '11-25' WHEN fleet_size <= 50 THEN '26-50' WHEN fleet_size <= 100 THEN '51-100' ELSE '100+' END AS fleet_band,
                  CASE WHEN years_in_business < 2 THEN '<2' WHEN years_in_business < 5 THEN '2-5' WHEN years_in_business < 10 THEN '5-10' ELSE '10+' END AS years_band,
                  r.policy_year,
                  CASE WHEN loss_ratio < 40 THEN 'AUTO_RENEW' WHEN loss_ratio < 55 THEN 'RENEW_AS_IS' WHEN loss_ratio < 70 THEN 'REVIEW_RATE'
                       WHEN loss_ratio < 90 THEN 'RATE_INCREASE_OR_NON_RENEW' ELSE 'DECLINE_OR_NON_RENEW' END AS ratio_action,
                  CASE WHEN loss_ratio < 50 THEN '<50%' WHEN loss_ratio < 75 THEN '50-75%' WHEN loss_ratio < 100 THEN '75-100%' ELSE '>100%' END AS ratio_band
           FROM insureds i JOIN loss_runs r ON i.insured_id = r.insured_id""",
        "insureds",
        "loss_runs",
    ),
)
def u09(spark, sf):
    both = table(spark, sf, "insureds").join(table(spark, sf, "loss_runs"), "insured_id")
    return both.select(
        "insured_id",
        uw.csa_grade(F.col("csa_unsafe_driving")).alias("csa_grade"),
        uw.fleet_band(F.col("fleet_size")).alias("fleet_band"),
        uw.years_band(F.col("years_in_business")).alias("years_band"),
        "policy_year",
        uw.loss_ratio_action(F.col("loss_ratio")).alias("ratio_action"),
        uw.loss_ratio_band(F.col("loss_ratio")).alias("ratio_band"),
    )


_TRIGGERS = {
    "trig": f"""SELECT s.submission_id, s.insured_id, {_RATIO} AS ratio, greatest(i.csa_unsafe_driving, i.csa_hos, i.csa_vehicle_maint, i.csa_driver_fitness) AS csa,
               s.primary_commodity, d.share, c.fatal, i.years_in_business, c.max_claim, p.dropped
        FROM submissions s JOIN insureds i ON s.insured_id = i.insured_id
        LEFT JOIN (SELECT insured_id, count(*) FILTER (WHERE driver_status = 'Excluded') / count(*) AS share FROM drivers GROUP BY insured_id) d ON d.insured_id = s.insured_id
        LEFT JOIN (SELECT insured_id, max(total_incurred) AS max_claim, bool_or(catastrophic_flag) AS fatal FROM claims GROUP BY insured_id) c ON c.insured_id = s.insured_id
        LEFT JOIN (SELECT insured_id, bool_or(renewal_status = 'Non-Renew') AS dropped FROM policies WHERE policy_status = 'Active' GROUP BY insured_id) p ON p.insured_id = s.insured_id""",
    "codes": """SELECT *, concat_ws('|', CASE WHEN ratio > 0.60 THEN 'LOSS_RATIO' END, CASE WHEN csa > 50 THEN 'CSA_SCORE' END,
               CASE WHEN contains(primary_commodity, 'Petroleum') THEN 'HAZMAT' END,
               CASE WHEN primary_commodity IN ('Automobiles', 'Electronics', 'Pharmaceuticals') THEN 'HIGH_VALUE_CARGO' END, CASE WHEN share > 0.10 THEN 'EXCLUDED_DRIVERS' END,
               CASE WHEN fatal THEN 'FATALITY' END, CASE WHEN years_in_business < 2 THEN 'NEW_VENTURE' END,
               CASE WHEN max_claim > 250000 THEN 'LARGE_CLAIM' END) AS triggers FROM trig""",
}


@query(
    "u10_referral_triggers",
    _sql(
        """SELECT submission_id, insured_id, triggers, CASE WHEN contains(triggers, 'FATALITY') OR max_claim >= 650000 OR dropped THEN 'Reserve Committee'
                  WHEN contains(triggers, 'HAZMAT') OR contains(triggers, 'HIGH_VALUE_CARGO') THEN 'CCO' WHEN contains(triggers, 'LOSS_RATIO') OR contains(triggers, 'CSA_SCORE') THEN 'VP UW'
                  WHEN triggers <> '' THEN 'Claims Director' ELSE 'NONE' END AS tier FROM codes""",
        "submissions",
        "insureds",
        "drivers",
        "claims",
        "policies",
        **_TRIGGERS,
    ),
)
def u10(spark, sf):
    return uw.referral_triggers(*[table(spark, sf, t) for t in ("submissions", "insureds", "drivers", "claims", "policies")])


_FLAGGED = {
    "flagged": """SELECT driver_id, insured_id, years_cdl_experience < 2 AS low_experience, mvr_points >= 4 AS high_mvr, accidents_3yr >= 2 AS many_accidents,
        violations_3yr >= 3 AS many_violations, COALESCE(telematics_score < 70, FALSE) AS low_telematics, disqualifying_offense AS disqualified FROM drivers""",
    "flag_counts": """SELECT *, CAST(low_experience AS BIGINT) + CAST(high_mvr AS BIGINT) + CAST(many_accidents AS BIGINT) + CAST(many_violations AS BIGINT)
        + CAST(low_telematics AS BIGINT) + CAST(disqualified AS BIGINT) AS n_flags FROM flagged""",
}


@query("u11_driver_flags", _sql("SELECT * FROM flag_counts", "drivers", **_FLAGGED))
def u11(spark, sf):
    return uw.driver_flags(table(spark, sf, "drivers")).select(
        "driver_id",
        "insured_id",
        "low_experience",
        "high_mvr",
        "many_accidents",
        "many_violations",
        "low_telematics",
        "disqualified",
        "n_flags",
    )


@query(
    "u11_worst_driver",
    _sql(
        """SELECT insured_id, driver_id, n_flags FROM (SELECT *, row_number() OVER (PARTITION BY insured_id ORDER BY n_flags DESC, driver_id) AS rn FROM flag_counts)
           WHERE rn = 1""",
        "drivers",
        **_FLAGGED,
    ),
)
def u11_worst(spark, sf):
    return uw.worst_driver(uw.driver_flags(table(spark, sf, "drivers")))


@query(
    "u12_renewal_outcome",
    _sql(
        """SELECT p.policy_id, p.insured_id, CASE WHEN COALESCE(c.cat, FALSE) OR l.loss_ratio > 90 THEN 'Non-Renew'
                  WHEN l.loss_ratio < 50 AND COALESCE(r.n, 0) = 0 THEN 'Auto-Renew' ELSE 'Review Required' END AS outcome
           FROM policies p
           LEFT JOIN (SELECT insured_id, loss_ratio FROM (SELECT *, row_number() OVER (PARTITION BY insured_id ORDER BY policy_year DESC) AS rn FROM loss_runs) WHERE rn = 1) l ON l.insured_id = p.insured_id
           LEFT JOIN (SELECT insured_id, bool_or(COALESCE(catastrophic_flag, FALSE) OR COALESCE(siu_referral, FALSE)) AS cat FROM claims GROUP BY insured_id) c ON c.insured_id = p.insured_id
           LEFT JOIN (SELECT insured_id, count(*) AS n FROM referrals GROUP BY insured_id) r ON r.insured_id = p.insured_id
           WHERE p.policy_status = 'Active'""",
        "policies",
        "loss_runs",
        "claims",
        "referrals",
    ),
)
def u12(spark, sf):
    return uw.renewal_outcome(*[table(spark, sf, t) for t in ("policies", "loss_runs", "claims", "referrals")])


_MEAN = "CAST(sum(CAST(loss_ratio AS DECIMAL(18, 4))) OVER w{0} AS DOUBLE) / count(loss_ratio) OVER w{0}"


@query(
    "u13_multi_year_ratio",
    _sql(
        f"""SELECT insured_id, policy_year, loss_ratio AS ytd_ratio, {_MEAN.format(3)} AS three_year_ratio, {_MEAN.format(5)} AS five_year_ratio,
                   CASE WHEN lag(loss_ratio) OVER w IS NULL THEN 'STABLE' WHEN loss_ratio < lag(loss_ratio) OVER w - 5 THEN 'IMPROVING'
                        WHEN loss_ratio > lag(loss_ratio) OVER w + 5 THEN 'DETERIORATING' ELSE 'STABLE' END AS trend
            FROM loss_runs WINDOW w AS (PARTITION BY insured_id ORDER BY policy_year),
                 w3 AS (PARTITION BY insured_id ORDER BY policy_year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
                 w5 AS (PARTITION BY insured_id ORDER BY policy_year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
        "loss_runs",
    ),
)
def u13(spark, sf):
    return uw.multi_year_ratio(table(spark, sf, "loss_runs"))


# ---- comparable accounts -----------------------------------------------------

_COHORTS = {
    "cohorts": """SELECT i.insured_id, i.state_domicile, i.naics_sector, i.fleet_size, i.primary_commodity, r.loss_ratio, b.premium, b.non_renewed,
               CASE WHEN years_in_business < 2 THEN '<2' WHEN years_in_business < 5 THEN '2-5' WHEN years_in_business < 10 THEN '5-10' ELSE '10+' END AS years_band,
               CASE WHEN loss_ratio < 50 THEN '<50%' WHEN loss_ratio < 75 THEN '50-75%' WHEN loss_ratio < 100 THEN '75-100%' ELSE '>100%' END AS ratio_band,
               CASE WHEN fleet_size <= 10 THEN 1 WHEN fleet_size <= 25 THEN 2 WHEN fleet_size <= 50 THEN 3 WHEN fleet_size <= 100 THEN 4 ELSE 5 END AS fband
        FROM insureds i
        JOIN (SELECT insured_id, CAST(sum(CAST(loss_ratio AS DECIMAL(18, 4))) AS DOUBLE) / count(loss_ratio) AS loss_ratio FROM loss_runs GROUP BY insured_id) r ON r.insured_id = i.insured_id
        JOIN (SELECT insured_id, CAST(sum(CAST(written_premium AS DECIMAL(18, 2))) AS DOUBLE) / count(written_premium) AS premium, bool_or(renewal_status = 'Non-Renew') AS non_renewed
              FROM policies GROUP BY insured_id) b ON b.insured_id = i.insured_id""",
    "comparable": """SELECT * FROM (SELECT a.insured_id, b.insured_id AS similar_id, b.fleet_size AS similar_fleet, b.loss_ratio AS similar_ratio, b.premium AS similar_premium, b.non_renewed AS similar_non_renewed,
               round((5 + CASE WHEN a.fband = b.fband THEN 3 ELSE 0 END + CASE WHEN a.primary_commodity = b.primary_commodity THEN 2 ELSE 0 END
                 + CASE WHEN a.years_band = b.years_band THEN 1 ELSE 0 END + CASE WHEN a.ratio_band = b.ratio_band THEN 3 ELSE 0 END) / 14.0e0, 4) AS similarity
        FROM cohorts a JOIN cohorts b ON a.state_domicile = b.state_domicile AND a.naics_sector = b.naics_sector AND a.insured_id <> b.insured_id
          AND b.fleet_size * 100 BETWEEN a.fleet_size * 70 AND a.fleet_size * 130) WHERE similarity >= 0.6""",
    "similar_rows": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY insured_id ORDER BY similarity DESC, similar_id) AS rank FROM comparable) WHERE rank <= 10""",
}
_BOOK = ("insureds", "loss_runs", "policies")


# A submission takes state, sector and years from its insured and everything else from itself.
_FOR_SUBMISSIONS = {
    "probes": """
        SELECT s.submission_id, s.insured_id AS own_id, i.state_domicile, i.naics_sector, s.fleet_size, s.primary_commodity,
               CASE WHEN s.fleet_size <= 10 THEN 1 WHEN s.fleet_size <= 25 THEN 2 WHEN s.fleet_size <= 50 THEN 3 WHEN s.fleet_size <= 100 THEN 4 ELSE 5 END AS fband,
               CASE WHEN years_in_business < 2 THEN '<2' WHEN years_in_business < 5 THEN '2-5' WHEN years_in_business < 10 THEN '5-10' ELSE '10+' END AS years_band,
               CASE WHEN ratio < 50 THEN '<50%' WHEN ratio < 75 THEN '50-75%' WHEN ratio < 100 THEN '75-100%' WHEN ratio >= 100 THEN '>100%' END AS ratio_band
        FROM (SELECT *, CASE WHEN loss_ratio_3yr > 1 THEN loss_ratio_3yr / 100 ELSE loss_ratio_3yr END * 100 AS ratio FROM submissions) s JOIN insureds i ON i.insured_id = s.insured_id""",
    **_COHORTS,
    "comparable": f"""SELECT * FROM (SELECT a.submission_id AS insured_id, b.insured_id AS similar_id, b.fleet_size AS similar_fleet, b.loss_ratio AS similar_ratio, b.premium AS similar_premium, b.non_renewed AS similar_non_renewed,
               round((5 + CASE WHEN a.fband = b.fband THEN 3 ELSE 0 END + CASE WHEN a.primary_commodity = b.primary_commodity THEN 2 ELSE 0 END
                 + CASE WHEN a.years_band = b.years_band THEN 1 ELSE 0 END + CASE WHEN a.ratio_band = b.ratio_band THEN 3 ELSE 0 END) / 14.0e0, 4) AS similarity
        FROM probes a JOIN cohorts b ON a.state_domicile = b.state_domicile AND a.naics_sector = b.naics_sector AND a.own_id <> b.insured_id
          AND b.fleet_size * 100 BETWEEN a.fleet_size * 70 AND a.fleet_size * 130) WHERE similarity >= {fv.SIMILARITY_THRESHOLD}""",
}
_STATISTICS = """SELECT insured_id{0}, count(*) AS n_accounts, CAST(sum(CAST(similar_ratio AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS avg_ratio,
                  round(count(*) FILTER (WHERE similar_ratio > 80 AND similar_non_renewed) * 100.0 / NULLIF(count(*) FILTER (WHERE similar_ratio > 80), 0), 4) AS non_renewal_pct
           FROM comparable GROUP BY insured_id"""
_BAND = """SELECT insured_id{0}, count(*) AS n_comparables, round(quantile_cont(similar_premium, 0.25), 4) AS low_premium, round(quantile_cont(similar_premium, 0.5), 4) AS median_premium,
                  round(quantile_cont(similar_premium, 0.75), 4) AS high_premium, round(avg(similarity) * least(count(*) / 10.0e0, 1), 4) AS confidence,
                  string_agg(concat(similar_id, ': ', similar_fleet, ' u., $', CAST(round(similar_premium, 0) AS BIGINT), ', ', CAST(round(similar_ratio, 0) AS BIGINT), '% LR, ',
                             CASE WHEN similar_non_renewed THEN 'Non-renewed' ELSE 'Renewed' END), '|' ORDER BY rank) AS evidence
           FROM similar_rows GROUP BY insured_id HAVING round(avg(similarity) * least(count(*) / 10.0e0, 1), 4) >= 0.6"""


def _cohorts(spark, sf):
    # The cohort table is a snapshot that is refreshed now and then, not a live view.
    return materialize(accounts.historical_cohorts(*[table(spark, sf, t) for t in _BOOK]), "cohorts")


def _similar(spark, sf, threshold=fv.SIMILARITY_THRESHOLD):
    cohorts = _cohorts(spark, sf)
    return accounts.similar(accounts.account_probes(cohorts), cohorts, threshold=threshold).withColumnRenamed("probe_id", "insured_id")


def _submission_probes(spark, sf):
    return accounts.submission_probes(table(spark, sf, "submissions"), table(spark, sf, "insureds"))


@query("u14_similar_accounts", _sql("SELECT * FROM similar_rows", *_BOOK, **_COHORTS))
def u14(spark, sf):
    return _similar(spark, sf, 0.6)


_CLOSE = {**_COHORTS, "comparable": _COHORTS["comparable"].replace("similarity >= 0.6", f"similarity >= {fv.SIMILARITY_THRESHOLD}")}


@query("u14_close_accounts", _sql("SELECT * FROM similar_rows", *_BOOK, **_CLOSE))
def u14_close(spark, sf):
    return _similar(spark, sf)


@query(
    "u14_similar_for_submissions",
    _sql("SELECT * RENAME (insured_id AS submission_id) FROM similar_rows", *_BOOK, "submissions", **_FOR_SUBMISSIONS),
)
def u14_submissions(spark, sf):
    return accounts.similar(_submission_probes(spark, sf), _cohorts(spark, sf)).withColumnRenamed("probe_id", "submission_id")


@query("u15_cohort_statistics", _sql(_STATISTICS.format(""), *_BOOK, **_COHORTS))
def u15(spark, sf):
    cohorts = _cohorts(spark, sf)
    return accounts.cohort_statistics(accounts.account_probes(cohorts), cohorts, 0.6).withColumnRenamed("probe_id", "insured_id")


@query("u15_submission_statistics", _sql(_STATISTICS.format(" AS submission_id"), *_BOOK, "submissions", **_FOR_SUBMISSIONS))
def u15_submissions(spark, sf):
    return accounts.cohort_statistics(_submission_probes(spark, sf), _cohorts(spark, sf)).withColumnRenamed("probe_id", "submission_id")


@query("u16_pricing_band", _sql(_BAND.format(""), *_BOOK, **_COHORTS))
def u16(spark, sf):
    found = _similar(spark, sf, 0.6).withColumnRenamed("insured_id", "probe_id")
    return accounts.pricing_band(found).withColumnRenamed("probe_id", "insured_id")


@query("u16_submission_band", _sql(_BAND.format(" AS submission_id"), *_BOOK, "submissions", **_FOR_SUBMISSIONS))
def u16_submissions(spark, sf):
    found = accounts.similar(_submission_probes(spark, sf), _cohorts(spark, sf))
    return accounts.pricing_band(found).withColumnRenamed("probe_id", "submission_id")


_TERRITORY = [("NATION_1", 1.25), ("NATION_2", 1.1), ("NATION_7", 0.9)]
_COMMODITY = [("Petroleum/Chemicals", 3.0), ("Automobiles", 1.5), ("Household Goods", 1.2)]
_values = lambda rows: ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in rows)


@query(
    "u17_premium_indication",
    _sql(
        """SELECT insured_id, round(m, 2) AS manual_premium, round(m * l, 2) AS loss_surcharge, round(m * s, 2) AS csa_surcharge, round(m * c, 2) AS credits, round(m * (1 + l + s - c) + 500.0e0, 2) AS indicated_premium
           FROM (SELECT i.insured_id, 7500.0e0 * fleet_size * COALESCE(t.f, 1.0e0) * COALESCE(k.f, 1.0e0) AS m,
                        CASE WHEN l.ratio > 90 THEN 0.50e0 WHEN l.ratio > 70 THEN 0.25e0 WHEN l.ratio > 55 THEN 0.10e0 ELSE 0.0e0 END AS l,
                        CASE WHEN greatest(csa_unsafe_driving, csa_hos, csa_vehicle_maint, csa_driver_fitness) > 80 THEN 0.25e0
                             WHEN greatest(csa_unsafe_driving, csa_hos, csa_vehicle_maint, csa_driver_fitness) > 65 THEN 0.20e0
                             WHEN greatest(csa_unsafe_driving, csa_hos, csa_vehicle_maint, csa_driver_fitness) > 50 THEN 0.15e0 ELSE 0.0e0 END AS s,
                        CASE WHEN p.deductible >= 5000 THEN 0.10e0 ELSE 0.0e0 END + CASE WHEN dashcam_coverage_pct >= 100 THEN 0.10e0 WHEN dashcam_coverage_pct >= 50 THEN 0.05e0 ELSE 0.0e0 END + CASE WHEN years_in_business >= 20 THEN 0.05e0 ELSE 0.0e0 END AS c
                 FROM insureds i LEFT JOIN (VALUES """
        + _values(_TERRITORY)
        + ") AS t(n, f) ON t.n = i.state_domicile LEFT JOIN (VALUES "
        + _values(_COMMODITY)
        + """) AS k(n, f) ON k.n = i.primary_commodity
             LEFT JOIN (SELECT insured_id, CAST(sum(CAST(loss_ratio AS DECIMAL(18, 4))) AS DOUBLE) / count(loss_ratio) AS ratio
                        FROM (SELECT *, row_number() OVER (PARTITION BY insured_id ORDER BY policy_year DESC) AS rn FROM loss_runs) WHERE rn <= 3 GROUP BY insured_id) l ON l.insured_id = i.insured_id
             LEFT JOIN (SELECT insured_id, min(deductible) AS deductible FROM policies WHERE policy_status = 'Active' GROUP BY insured_id) p ON p.insured_id = i.insured_id)""",
        "insureds",
        "loss_runs",
        "policies",
    ),
)
def u17(spark, sf):
    territory = spark.createDataFrame(_TERRITORY, "state_domicile string, territory_factor double")
    commodity = spark.createDataFrame(_COMMODITY, "primary_commodity string, commodity_factor double")
    accounts = uw.rating_accounts(*[table(spark, sf, t) for t in ("insureds", "loss_runs", "policies")])
    return uw.premium_indication(accounts, uw.Rates(base=7500.0, expense=500.0), territory, commodity)


_REQUIRED = "[" + ", ".join(f"'{d}'" for d in fv.REQUIRED_DOCUMENTS) + "]"


@query(
    "u18_completeness",
    _sql(
        f"""SELECT submission_id, submission_status, array_to_string([d FOR d IN {_REQUIRED} IF NOT list_contains(string_split(received_docs, '|'), d)], '|') AS missing_docs,
                   round(length([d FOR d IN {_REQUIRED} IF list_contains(string_split(received_docs, '|'), d)]) / 6.0e0, 4) AS completeness_pct
            FROM submissions WHERE submission_status IN ('New', 'In Review') AND length([d FOR d IN {_REQUIRED} IF list_contains(string_split(received_docs, '|'), d)]) < 6""",
        "submissions",
    ),
)
def u18(spark, sf):
    submissions = table(spark, sf, "submissions").withColumn("received_docs", F.split("received_docs", r"\|"))
    checked = uw.completeness(submissions).where(
        F.col("submission_status").isin("New", "In Review") & (F.col("completeness_pct") < 1)
    )
    return checked.select("submission_id", "submission_status", "missing_docs", "completeness_pct")


_CENTS = "CAST(sum(CAST({0} AS DECIMAL(18, 2))) AS DOUBLE)"


@query(
    "u19_claims_development",
    _sql(
        f"""SELECT loss_type, count(*) AS n_claims, count(*) FILTER (WHERE claim_status = 'Open') AS n_open, avg(report_date - loss_date) AS avg_report_lag,
                   {_CENTS.format('total_incurred')} AS incurred, {_CENTS.format('total_paid')} AS paid, {_CENTS.format('case_reserves')} AS reserves,
                   count(*) FILTER (WHERE attorney_involved) AS n_attorney, count(*) FILTER (WHERE litigation_status IN ('Pre-Suit', 'Suit Filed', 'Trial Set')) AS n_litigated,
                   count(*) FILTER (WHERE total_incurred >= 90000) AS n_large FROM claims GROUP BY loss_type""",
        "claims",
    ),
)
def u19(spark, sf):
    return uw.claims_development(table(spark, sf, "claims"), large_loss=90000)


@query(
    "u20_portfolio_mix",
    _sql(
        f"""SELECT primary_commodity, count(*) AS n_policies, {_CENTS.format('written_premium')} AS premium,
                   round({_CENTS.format('written_premium')} * 100 / (SELECT {_CENTS.format('written_premium')} FROM policies), 4) AS premium_pct
            FROM policies p JOIN insureds i ON p.insured_id = i.insured_id GROUP BY primary_commodity""",
        "policies",
        "insureds",
    ),
)
def u20(spark, sf):
    return uw.portfolio_mix(table(spark, sf, "policies"), table(spark, sf, "insureds"), "primary_commodity")


@query(
    "u20_segment_growth",
    _sql(
        """SELECT primary_commodity, year, premium, round((premium - before) * 100 / nullif(before, 0), 4) AS growth_pct,
                  round(coalesce(incurred, 0) * 100 / nullif(premium, 0), 4) AS loss_ratio,
                  coalesce((premium - before) * 100 / nullif(before, 0) > (all_premium - all_before) * 100 / nullif(all_before, 0)
                    AND coalesce(incurred, 0) * 100 / nullif(premium, 0) > coalesce(all_incurred, 0) * 100 / nullif(all_premium, 0), FALSE) AS outgrows_losses
           FROM grown""",
        "policies",
        "loss_runs",
        "insureds",
        seg="""SELECT i.primary_commodity, year, CAST(sum(p) AS DOUBLE) AS premium, CAST(sum(l) AS DOUBLE) AS incurred FROM (
                 SELECT insured_id, policy_year AS year, CAST(written_premium AS DECIMAL(18, 2)) AS p, NULL AS l FROM policies
                 UNION ALL SELECT insured_id, policy_year, NULL, CAST(total_incurred AS DECIMAL(18, 2)) FROM loss_runs) x LEFT JOIN insureds i ON i.insured_id = x.insured_id
               GROUP BY ALL""",
        book="""SELECT year, CAST(sum(CAST(premium AS DECIMAL(28, 2))) AS DOUBLE) AS all_premium, CAST(sum(CAST(incurred AS DECIMAL(28, 2))) AS DOUBLE) AS all_incurred FROM seg GROUP BY year""",
        grown="""SELECT s.*, b.all_premium, b.all_incurred, s2.premium AS before, b2.all_premium AS all_before FROM seg s JOIN book b ON b.year = s.year
                 LEFT JOIN seg s2 ON s2.primary_commodity IS NOT DISTINCT FROM s.primary_commodity AND s2.year = s.year - 1 LEFT JOIN book b2 ON b2.year = s.year - 1""",
    ),
)
def u20_growth(spark, sf):
    return uw.segment_growth(table(spark, sf, "policies"), table(spark, sf, "loss_runs"), table(spark, sf, "insureds"), "primary_commodity")


@query(
    "u21_latest_periods",
    _sql(
        """SELECT insured_id, policy_year, num_claims, total_incurred, loss_ratio, rank FROM
           (SELECT *, row_number() OVER (PARTITION BY insured_id ORDER BY policy_year DESC) AS rank FROM loss_runs) WHERE rank <= 3""",
        "loss_runs",
    ),
)
def u21(spark, sf):
    return qs.latest_periods(table(spark, sf, "loss_runs"))


@query(
    "u21_open_claims",
    _sql(
        """SELECT insured_id, claim_id, loss_type, total_incurred, rank FROM
           (SELECT *, row_number() OVER (PARTITION BY insured_id ORDER BY total_incurred DESC, claim_id) AS rank FROM claims WHERE claim_status = 'Open') WHERE rank <= 5""",
        "claims",
    ),
)
def u21_claims(spark, sf):
    return qs.largest_open_claims(table(spark, sf, "claims"), 5)


@query(
    "u24_appetite_fit",
    _sql(
        f"""SELECT submission_id, round((CASE WHEN ratio <= 0.75 THEN 3 ELSE 0 END + CASE WHEN csa <= 65 THEN 2 ELSE 0 END + CASE WHEN safety_rating = 'Satisfactory' THEN 2 ELSE 0 END
                   + CASE WHEN NOT contains(primary_commodity, 'Petroleum') THEN 1 ELSE 0 END + CASE WHEN telematics_provider IS NOT NULL THEN 1 ELSE 0 END) / 9.0e0, 4) AS fit_score,
                   concat_ws('|', CASE WHEN NOT ratio <= 0.75 THEN concat('LOSS_RATIO: 3-year loss ratio ', {_PCT}) END, CASE WHEN NOT csa <= 65 THEN concat('CSA: CSA ', CAST(csa_unsafe_driving AS VARCHAR)) END,
                     CASE WHEN safety_rating <> 'Satisfactory' THEN concat('SAFETY_RATING: Rating ', safety_rating) END,
                     CASE WHEN contains(primary_commodity, 'Petroleum') THEN concat('COMMODITY: Commodity ', primary_commodity) END,
                     CASE WHEN telematics_provider IS NULL THEN 'TELEMATICS: No provider' END) AS findings
            FROM inputs""",
        *_ASSESS,
        **{k: _ASSESSED[k] for k in ("summary", "inputs")},
    ),
)
def u24(spark, sf):
    fit = uw.appetite_fit(_summary(spark, sf))
    texts = F.transform("findings", lambda f: F.concat(f["finding"], F.lit(": "), f["evidence"]))
    return fit.select("submission_id", "fit_score", F.array_join(texts, "|").alias("findings"))


@query(
    "u25_loss_trend",
    _sql(
        """SELECT primary_commodity, CAST(max(x) + 1 AS BIGINT) AS projected_year,
                  round(regr_slope(ratio, x), 4) AS ratio_slope, round(regr_slope(frequency, x), 4) AS frequency_slope, round(regr_slope(severity, x), 4) AS severity_slope,
                  round(regr_intercept(ratio, x) + regr_slope(ratio, x) * (max(x) + 1), 2) AS ratio_next, round(regr_intercept(frequency, x) + regr_slope(frequency, x) * (max(x) + 1), 2) AS frequency_next,
                  round(regr_intercept(severity, x) + regr_slope(severity, x) * (max(x) + 1), 2) AS severity_next
           FROM (SELECT primary_commodity, CAST(policy_year AS DOUBLE) AS x, 100 * sum(total_incurred) / sum(earned_premium) AS ratio, CAST(sum(num_claims) AS DOUBLE) / count(*) AS frequency,
                        COALESCE(sum(total_incurred) / NULLIF(sum(num_claims), 0), 0) AS severity
                 FROM loss_runs r JOIN insureds i ON r.insured_id = i.insured_id GROUP BY primary_commodity, policy_year) GROUP BY primary_commodity""",
        "loss_runs",
        "insureds",
    ),
)
def u25(spark, sf):
    return uw.loss_trend(table(spark, sf, "loss_runs"), table(spark, sf, "insureds"), "primary_commodity")


@query(
    "u26_submission_funnel",
    _sql(
        """SELECT submission_status, count(*) AS n_submissions, round(count(*) * 100.0 / (SELECT count(*) FROM submissions), 4) AS share_pct,
                  round(avg((quoted_premium - expiring_premium) * 100 / expiring_premium), 4) AS avg_change_pct, round(avg(days_to_quote), 4) AS avg_days_to_quote
           FROM submissions GROUP BY submission_status""",
        "submissions",
    ),
)
def u26(spark, sf):
    return uw.submission_funnel(table(spark, sf, "submissions"))


@query(
    "u26_conversion",
    _sql(
        """SELECT broker_name, n_submissions, n_reviewed, n_quoted, n_bound, n_declined, round(100.0e0 * n_quoted / n_submissions, 4) AS quote_pct,
                  round(100.0e0 * n_bound / nullif(n_quoted, 0), 4) AS bind_pct, round(100.0e0 * n_bound / n_submissions, 4) AS conversion_pct,
                  round(100.0e0 * n_declined / n_submissions, 4) AS decline_pct
           FROM (SELECT broker_name, count(*) AS n_submissions, count(*) FILTER (submission_status NOT IN ('Received', 'New')) AS n_reviewed,
                        count(*) FILTER (submission_status IN ('Quoted', 'Bound', 'Lost')) AS n_quoted, count(*) FILTER (submission_status = 'Bound') AS n_bound,
                        count(*) FILTER (submission_status = 'Declined') AS n_declined FROM submissions GROUP BY broker_name)""",
        "submissions",
    ),
)
def u26_conversion(spark, sf):
    return uw.conversion(table(spark, sf, "submissions"), "broker_name")
