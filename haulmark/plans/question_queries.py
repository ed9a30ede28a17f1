"""The structured questions, answered for the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.operators import questions as qs
from haulmark.plans.models import table, with_models
from haulmark.plans.registry import query

_CENTS = "CAST(sum(CAST({0} AS DECIMAL(18, 2))) AS DOUBLE)"
_ACCOUNT = "insured_id, company_name, fleet_size, risk_tier, safety_rating FROM insureds"


def _ask(name: str, sql: str, *tables: str):
    """Register a question whose builder gets its tables as frames."""

    def add(answer):
        query(name, with_models(sql, *tables))(lambda spark, sf: answer(*[table(spark, sf, t) for t in tables]))
        return answer

    return add


@_ask("q001_q006_fleet_overview", "SELECT count(*) AS n_insureds, avg(fleet_size) AS avg_fleet FROM insureds", "insureds")
def fleet(insureds):
    return qs.fleet_overview(insureds)


@_ask("q002_large_fleets", f"SELECT {_ACCOUNT} WHERE fleet_size > 50", "insureds")
def large_fleets(insureds):
    return qs.accounts_where(insureds, F.col("fleet_size") > 50)


@_ask("q003_hazmat_carriers", f"SELECT {_ACCOUNT} WHERE primary_commodity ILIKE '%petroleum%' OR primary_commodity ILIKE '%hazmat%'", "insureds")
def hazmat(insureds):
    commodity = F.col("primary_commodity")
    return qs.accounts_where(insureds, commodity.ilike("%petroleum%") | commodity.ilike("%hazmat%"))


@_ask("q004_risk_tiers", f"SELECT {_ACCOUNT} WHERE company_name ILIKE '%customer%'", "insureds")
def tiers(insureds):
    return qs.accounts_where(qs.named(insureds, "customer"), F.lit(True))


@_ask("q005_unsatisfactory", f"SELECT {_ACCOUNT} WHERE safety_rating = 'Unsatisfactory'", "insureds")
def unsatisfactory(insureds):
    return qs.accounts_where(insureds, F.col("safety_rating") == "Unsatisfactory")


@_ask("q007_decline_tier", f"SELECT {_ACCOUNT} WHERE risk_tier = 'Decline'", "insureds")
def decline_tier(insureds):
    return qs.accounts_where(insureds, F.col("risk_tier") == "Decline")


@_ask(
    "q008_active_premium",
    f"SELECT count(*) AS n_policies, {_CENTS.format('written_premium')} AS premium FROM policies WHERE policy_status = 'Active'",
    "policies",
)
def active_premium(policies):
    return qs.premium_of(policies, F.col("policy_status") == "Active")


@_ask("q009_non_renew", "SELECT policy_id, insured_id, line_of_business FROM policies WHERE renewal_status = 'Non-Renew'", "policies")
def non_renew(policies):
    return policies.where("renewal_status = 'Non-Renew'").select("policy_id", "insured_id", "line_of_business")


@_ask(
    "q010_policies_of_accounts",
    "SELECT i.company_name, p.insured_id, p.policy_id, p.policy_status FROM policies p JOIN insureds i ON p.insured_id = i.insured_id",
    "policies",
    "insureds",
)
def policies_of(policies, insureds):
    return qs.of_account(policies.select("insured_id", "policy_id", "policy_status"), insureds)


@_ask("q011_ratio_above_100", "SELECT insured_id, policy_year, loss_ratio FROM loss_runs WHERE loss_ratio > 100", "loss_runs")
def ratio_above_100(loss_runs):
    return loss_runs.where("loss_ratio > 100").select("insured_id", "policy_year", "loss_ratio")


@_ask(
    "q012_premium_by_line",
    f"SELECT line_of_business, count(*) AS n_policies, {_CENTS.format('written_premium')} / count(*) AS avg_premium FROM policies GROUP BY 1",
    "policies",
)
def premium_by_line(policies):
    return qs.premium_by_line(policies)


def _drivers(name, where, condition):
    sql = (
        "SELECT d.insured_id, i.company_name, count(*) AS n_drivers FROM drivers d JOIN insureds i ON d.insured_id = i.insured_id "
        f"WHERE {where} GROUP BY ALL"
    )
    _ask(name, sql, "drivers", "insureds")(lambda drivers, insureds: qs.driver_counts(drivers, insureds, condition()))


_drivers("q013_high_mvr_drivers", "mvr_points >= 5", lambda: F.col("mvr_points") >= 5)
_drivers("q014_excluded_drivers", "driver_status = 'Excluded'", lambda: F.col("driver_status") == "Excluded")
_drivers(
    "q015_endorsed_drivers",
    "hazmat_endorsement AND tanker_endorsement",
    lambda: F.col("hazmat_endorsement") & F.col("tanker_endorsement"),
)
_drivers("q017_accident_drivers", "accidents_3yr >= 3", lambda: F.col("accidents_3yr") >= 3)
_drivers("q018_drivers_of_accounts", "TRUE", lambda: F.lit(True))


@_ask(
    "q016_active_telematics",
    """SELECT count(*) AS n_active, CAST(sum(CAST(telematics_score AS DECIMAL(18, 1))) AS DOUBLE) / count(telematics_score) AS avg_score
       FROM drivers WHERE driver_status = 'Active'""",
    "drivers",
)
def telematics(drivers):
    return qs.average_telematics(drivers)


def _claims(name, where, condition):
    sql = f"SELECT count(*) AS n_claims, {_CENTS.format('total_incurred')} AS incurred FROM claims WHERE {where}"
    _ask(name, sql, "claims")(lambda claims: qs.claim_totals(claims, condition()))


_claims("q019_q020_open_claims", "claim_status = 'Open'", lambda: F.col("claim_status") == "Open")
_claims("q021_attorney_claims", "attorney_involved", lambda: F.col("attorney_involved"))
_claims("q022_large_losses", "large_loss_flag", lambda: F.col("large_loss_flag"))


@_ask(
    "q023_claims_of_accounts",
    f"""SELECT c.insured_id, i.company_name, count(*) AS n_claims, count(*) FILTER (WHERE claim_status = 'Open') AS n_open,
               {_CENTS.format('total_incurred')} AS incurred FROM claims c JOIN insureds i ON c.insured_id = i.insured_id GROUP BY ALL""",
    "claims",
    "insureds",
)
def claims_of(claims, insureds):
    return qs.claims_by_account(claims, insureds)


def _submissions(name, where, condition):
    sql = f"SELECT submission_id, company_name, submission_status, referral_required, decline_reason FROM submissions WHERE {where}"
    _ask(name, sql, "submissions")(lambda submissions: qs.submissions_where(submissions, condition()))


_submissions("q024_in_review", "submission_status = 'In Review'", lambda: F.col("submission_status") == "In Review")
_submissions("q025_referral_required", "referral_required", lambda: F.col("referral_required"))
_submissions(
    "q027_declined_with_reason",
    "submission_status = 'Declined' AND decline_reason IS NOT NULL",
    lambda: (F.col("submission_status") == "Declined") & F.col("decline_reason").isNotNull(),
)


@_ask("q026_days_to_quote", "SELECT count(days_to_quote) AS n_quoted, avg(days_to_quote) AS avg_days FROM submissions", "submissions")
def days_to_quote(submissions):
    return qs.average_days_to_quote(submissions)


@_ask(
    "q028_ratio_by_period",
    "SELECT l.insured_id, i.company_name, policy_year, loss_ratio, num_claims FROM loss_runs l JOIN insureds i ON l.insured_id = i.insured_id",
    "loss_runs",
    "insureds",
)
def ratio_by_period(loss_runs, insureds):
    return qs.ratio_by_period(loss_runs, insureds)


@_ask(
    "q029_ratio_above_200",
    "SELECT l.insured_id, i.company_name, policy_year, loss_ratio, num_claims FROM loss_runs l JOIN insureds i ON l.insured_id = i.insured_id WHERE loss_ratio > 200",
    "loss_runs",
    "insureds",
)
def ratio_above_200(loss_runs, insureds):
    return qs.ratio_by_period(loss_runs, insureds).where("loss_ratio > 200")


@_ask("q030_earned_premium", f"SELECT {_CENTS.format('earned_premium')} AS earned_premium FROM loss_runs", "loss_runs")
def earned_premium(loss_runs):
    return qs.earned_premium(loss_runs)


_REFERRAL = "referral_id, insured_id, referral_reason, referral_tier, decision FROM referrals"


@_ask("q033_pending_referrals", f"SELECT {_REFERRAL} WHERE decision IS NULL", "referrals")
def pending(referrals):
    return qs.referral_decisions(referrals, F.col("decision").isNull())


@_ask("q034_conditional_approvals", f"SELECT {_REFERRAL} WHERE decision = 'Approved with Conditions'", "referrals")
def conditional(referrals):
    return qs.referral_decisions(referrals, F.col("decision") == "Approved with Conditions")


@_ask("q035_referral_reasons", "SELECT referral_reason, count(*) AS n_referrals FROM referrals GROUP BY 1", "referrals")
def reasons(referrals):
    return qs.referral_reasons(referrals)


@_ask(
    "q102_q105_account_overview",
    """SELECT l.insured_id, i.company_name, CAST(sum(CAST(l.loss_ratio AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS avg_ratio, COALESCE(max(d.n), 0) AS n_drivers
       FROM loss_runs l JOIN insureds i ON l.insured_id = i.insured_id LEFT JOIN (SELECT insured_id, count(*) AS n FROM drivers GROUP BY 1) d ON d.insured_id = l.insured_id
       GROUP BY l.insured_id, i.company_name""",
    "loss_runs",
    "drivers",
    "insureds",
)
def overview(loss_runs, drivers, insureds):
    return qs.account_overview(loss_runs, drivers, insureds)


@_ask(
    "q106_compare_accounts",
    """SELECT company_name, policy_year, loss_ratio, CAST(sum(CAST(loss_ratio AS DECIMAL(18, 4))) OVER y AS DOUBLE) / count(loss_ratio) OVER y AS year_ratio
       FROM (SELECT i.company_name, policy_year, max(loss_ratio) AS loss_ratio FROM loss_runs l JOIN insureds i ON l.insured_id = i.insured_id GROUP BY ALL)
       WINDOW y AS (PARTITION BY policy_year)""",
    "loss_runs",
    "insureds",
)
def compare(loss_runs, insureds):
    return qs.compare_accounts(loss_runs, insureds)


@_ask(
    "q108_claims_last_month",
    f"""SELECT loss_type, count(*) AS n_claims, {_CENTS.format('total_incurred')} AS incurred FROM claims
        WHERE loss_date >= DATE '1998-02-01' AND loss_date < DATE '1998-03-01' GROUP BY loss_type""",
    "claims",
)
def last_month(claims):
    return qs.claims_in_month(claims, F.lit("1998-03-17").cast("date"))


@_ask(
    "q110_premium_share",
    f"""SELECT p.insured_id, i.company_name, {_CENTS.format('written_premium')} AS premium,
               round({_CENTS.format('written_premium')} * 100 / (SELECT {_CENTS.format('written_premium')} FROM policies), 6) AS share_pct
        FROM policies p JOIN insureds i ON p.insured_id = i.insured_id GROUP BY p.insured_id, i.company_name""",
    "policies",
    "insureds",
)
def premium_share(policies, insureds):
    return qs.premium_share(policies, insureds)


# ---- questions that ask for the rows, or for a number ------------------------------


def _driver_list(name, where, condition):
    sql = (
        "SELECT d.insured_id, driver_id, first_name, driver_status, mvr_points, accidents_3yr, i.company_name FROM drivers d "
        f"JOIN insureds i ON d.insured_id = i.insured_id WHERE {where}"
    )
    _ask(name, sql, "drivers", "insureds")(lambda drivers, insureds: qs.driver_list(drivers, insureds, condition()))


_driver_list("q014_excluded_driver_list", "driver_status = 'Excluded'", lambda: F.col("driver_status") == "Excluded")
_driver_list("q015_hazmat_driver_list", "hazmat_endorsement", lambda: F.col("hazmat_endorsement"))
_driver_list("q017_accident_driver_list", "accidents_3yr >= 3", lambda: F.col("accidents_3yr") >= 3)


def _claim_list(name, where, condition):
    sql = (
        "SELECT c.insured_id, claim_id, policy_id, loss_date, loss_type, claim_status, total_incurred, i.company_name FROM claims c "
        f"LEFT JOIN insureds i ON c.insured_id = i.insured_id WHERE {where}"
    )
    _ask(name, sql, "claims", "insureds")(lambda claims, insureds: qs.claim_list(claims, insureds, condition()))


_claim_list("q021_attorney_claim_list", "attorney_involved", lambda: F.col("attorney_involved"))
_claim_list("q022_large_loss_list", "large_loss_flag", lambda: F.col("large_loss_flag"))
_claim_list("q023_claim_list_of_accounts", "TRUE", lambda: F.lit(True))


@_ask(
    "q011_policies_above_100",
    """SELECT p.policy_id, p.insured_id, p.policy_year, p.line_of_business, l.loss_ratio FROM policies p
       JOIN loss_runs l ON l.insured_id = p.insured_id AND l.policy_year = p.policy_year WHERE l.loss_ratio > 100""",
    "policies",
    "loss_runs",
)
def policies_above_100(policies, loss_runs):
    return qs.policies_above_ratio(policies, loss_runs)


@_ask("q024_in_review_count", "SELECT count(*) AS n_submissions FROM submissions WHERE submission_status = 'In Review'", "submissions")
def in_review_count(submissions):
    return submissions.where("submission_status = 'In Review'").agg(F.count(F.lit(1)).alias("n_submissions"))


@_ask("q033_pending_count", "SELECT count(*) AS n_referrals FROM referrals WHERE decision IS NULL", "referrals")
def pending_count(referrals):
    return referrals.where("decision IS NULL").agg(F.count(F.lit(1)).alias("n_referrals"))


@_ask("q027_declined_all", "SELECT submission_id, company_name, submission_status, referral_required, decline_reason FROM submissions WHERE submission_status = 'Declined'", "submissions")
def declined_all(submissions):
    return qs.submissions_where(submissions, F.col("submission_status") == "Declined")


@_ask(
    "q106_compare_safety",
    """SELECT i.insured_id, company_name, safety_rating, csa_unsafe_driving, csa_hos, csa_vehicle_maint, dashcam_coverage_pct, fleet_size,
              coalesce(n_drivers, 0) AS n_drivers, avg_mvr, coalesce(accidents, 0) AS accidents, coalesce(violations, 0) AS violations,
              coalesce(n_claims, 0) AS n_claims, round(CAST(coalesce(n_claims, 0) AS DOUBLE) / fleet_size, 6) AS claims_per_unit
       FROM insureds i LEFT JOIN (SELECT insured_id, count(*) AS n_drivers, avg(mvr_points) AS avg_mvr, CAST(sum(accidents_3yr) AS BIGINT) AS accidents,
                                         CAST(sum(violations_3yr) AS BIGINT) AS violations FROM drivers GROUP BY 1) d ON d.insured_id = i.insured_id
       LEFT JOIN (SELECT insured_id, count(*) AS n_claims FROM claims GROUP BY 1) c ON c.insured_id = i.insured_id""",
    "insureds",
    "drivers",
    "claims",
)
def compare_safety(insureds, drivers, claims):
    return qs.safety_profile(insureds, drivers, claims)
