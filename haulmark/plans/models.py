"""Model tables derived from the given tables.

Each model table is one SELECT in the SQL that Spark and an ANSI engine share, so the same
text builds the Spark input and the input of the independent check.  Names in braces are
tables; ``@name@`` marks the few functions that are spelt differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from haulmark import fixed_values as fv
from haulmark.sources.sizing import spread

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Tables of long texts: per-row work is heavy enough to be worth spreading a single file.
TEXT_TABLES = ("documents",)

_SPARK = {"micros": "timestamp_micros", "hash": "sha", "codes": "length"}
_ANSI = {"micros": "make_timestamp", "hash": "sha256", "codes": "length"}

NL = "chr(10)"


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


_IDS = list(fv.CATEGORY_LABELS)
_SOURCE_NO = "CAST(regexp_extract(d.source, '[0-9]+', 0) AS BIGINT) % 16"
_LABEL = "CASE " + " ".join(
    f"WHEN category_id = '{k}' THEN '{v}'" for k, v in fv.CATEGORY_LABELS.items()
) + " ELSE category_id END"

MODELS: dict[str, str] = {
    # ---- documents ----------------------------------------------------------
    # Section headers, reference ids and a leading blank part are added, since the
    # generated prose has none of them.
    "doc_files": f"""
        SELECT d.doc_id AS doc_key, CAST(d.doc_id AS STRING) AS doc_id, d.lang, d.source,
               {_case(_SOURCE_NO, _IDS)} AS category_id,
               CASE d.doc_id % 6
                 WHEN 1 THEN concat('# Overview', {NL}, d.text, {NL}, 'Section 2 Coverage', {NL}, 'Limits apply.')
                 WHEN 2 THEN concat(d.text, {NL}, 'LOSS HISTORY', {NL}, 'Claim CLM-24-', CAST(d.doc_id AS STRING),
                      ' for INS-', CAST(1000 + d.doc_id AS STRING), '.', {NL}, '3.1 Referral Rules', {NL}, 'See SUB-26-11065.')
                 WHEN 3 THEN concat(d.text, {NL}, 'Required documents for review:', {NL}, 'MVR reports.', {NL}, {NL},
                      '   ARTICLE 4 limits', {NL}, 'End.')
                 WHEN 4 THEN concat({NL}, ' ', {NL}, '## Summary', {NL}, d.text)
                 ELSE d.text END AS parsed_text,
               concat(CASE d.doc_id % 4 WHEN 0 THEN 'Gulf_Carrier-' WHEN 1 THEN 'north-line_' WHEN 2 THEN 'TriState_' ELSE 'Acme_Freight_' END,
                      CAST(d.doc_id AS STRING),
                      CASE d.doc_id % 5 WHEN 0 THEN '_LR_2024' WHEN 1 THEN '_Loss_Run' WHEN 2 THEN '_policy_2025' WHEN 3 THEN '_2026' ELSE '' END) AS stem
        FROM {{documents}} d""",
    "parsed_documents": f"""
        SELECT doc_id, concat('/vol/', category_id, '/', stem, '.pdf') AS source_path,
               concat(stem, '.pdf') AS file_name, {_LABEL} AS category, category_id, parsed_text
        FROM {{doc_files}}""",
    # ---- questions ----------------------------------------------------------
    "questions": """
        SELECT item_id AS query_id,
               CASE item_id % 4
                 WHEN 0 THEN text
                 WHEN 1 THEN concat('Status of clm-24-', CAST(item_id AS STRING), ' and INS-', CAST(1000 + item_id AS STRING))
                 WHEN 2 THEN text
                 ELSE concat('How many trucks? ', text) END AS question,
               CASE item_id % 8 WHEN 0 THEN 'underwriter' WHEN 1 THEN 'claims_adjuster' WHEN 2 THEN 'broker'
                 WHEN 3 THEN 'loss_control' WHEN 4 THEN 'compliance_officer' WHEN 5 THEN 'executive'
                 WHEN 6 THEN 'claims_director' ELSE 'senior_underwriter' END AS role
        FROM {benchmark}""",
    # ---- answers under guardrails -------------------------------------------
    "answers": f"""
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS answer_id,
               CASE (conv_id + turn) % 9
                 WHEN 1 THEN concat('Driver SSN 123-45-6789 and phone 555-123-4567. ', text)
                 WHEN 2 THEN concat('I APPROVE THIS risk. ', text)
                 WHEN 3 THEN concat('License B1234567 born 04/15/1980. ', text)
                 WHEN 4 THEN concat('On coverage interpretation: ', text)
                 WHEN 5 THEN concat(text, ' [Carrier Manual, 3.4]')
                 WHEN 6 THEN concat('According to the manual, exclusion analysis applies. ', text)
                 WHEN 7 THEN concat('Competitor pricing is lower. ', text)
                 WHEN 8 THEN concat('Per the guide call (555) 123-4567. ', text)
                 ELSE text END AS answer
        FROM {{conversations}} WHERE role = 'assistant'""",
    # ---- generated statements -----------------------------------------------
    "statements": f"""
        SELECT event_id AS statement_id,
               CASE event_id % 8
                 WHEN 0 THEN concat('```sql', {NL}, 'SELECT count(*) FROM claims', {NL}, '```')
                 WHEN 1 THEN concat('  select ', CAST(user_id AS STRING), ' from policies  ')
                 WHEN 2 THEN 'DROP TABLE claims'
                 WHEN 3 THEN 'WITH x AS (SELECT 1) SELECT * FROM x'
                 WHEN 4 THEN '-- no answer'
                 WHEN 5 THEN 'SELECT created_at, updates FROM claims'
                 WHEN 6 THEN 'SELECT 1; delete from claims; drop table x'
                 ELSE '```SELECT 2```' END AS statement
        FROM {{events}}""",
    # ---- conversations ------------------------------------------------------
    "sessions": """
        SELECT CAST(conv_id AS STRING) AS session_id, role, text AS content,
               concat('user', CAST(conv_id % 17 AS STRING)) AS user_id,
               @micros@(CAST(1704067200000000 AS BIGINT) + conv_id * 3600000000 + turn * 60000000) AS created_at
        FROM {conversations}""",
    # ---- feedback -----------------------------------------------------------
    "feedback": """
        SELECT concat('FB-', CAST(event_id AS STRING)) AS feedback_id,
               concat('S-', CAST(user_id AS STRING)) AS session_id,
               concat('user', CAST(user_id AS STRING)) AS user_id,
               concat('Question ', props) AS question, concat('Answer ', event_type, ' ', CAST(event_id AS STRING)) AS answer,
               CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS rating,
               CASE WHEN event_id % 3 = 0 THEN concat('Too vague ', CAST(event_id AS STRING)) END AS comment,
               ts AS created_at,
               CASE user_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'keyword' ELSE 'sql' END AS intent_classification,
               value < 5 AS promoted_to_eval
        FROM {events} WHERE event_type IN ('purchase', 'signup', 'error')""",
    "ratings": """
        SELECT event_id, CASE event_type WHEN 'purchase' THEN 'thumbs_up' WHEN 'signup' THEN 'thumbs_up'
               WHEN 'error' THEN 'thumbs_down' ELSE event_type END AS rating FROM {events}""",
    "overrides": """
        SELECT concat('OV-', CAST(event_id AS STRING)) AS override_id, concat('S-', CAST(user_id AS STRING)) AS session_id,
               concat('user', CAST(user_id AS STRING)) AS user_id,
               concat('SUB-', CAST(event_id AS STRING)) AS submission_id,
               CASE event_id % 4 WHEN 0 THEN 'Refer' WHEN 1 THEN 'Decline' WHEN 2 THEN 'Approve' ELSE 'Refer' END AS ai_recommendation,
               CASE event_id % 3 WHEN 0 THEN 'Approve' WHEN 1 THEN 'Refer' ELSE 'Decline' END AS uw_decision,
               CASE user_id % 4 WHEN 0 THEN 'Established Relationship' WHEN 1 THEN 'Risk Not Documented'
                    WHEN 2 THEN 'Loss Control Plan' ELSE 'Pricing Adjustment' END AS override_reason,
               ts AS created_at
        FROM {events} WHERE event_type = 'click'""",
    # ---- evaluation ---------------------------------------------------------
    "eval_questions": """
        SELECT concat(CASE d.doc_id % 7 WHEN 0 THEN 'RBAC' WHEN 1 THEN 'SQL' WHEN 2 THEN 'EDGE' ELSE 'DOC' END, '-', CAST(d.doc_id AS STRING)) AS question_id,
               d.doc_id AS doc_key,
               concat('What does ', d.source, ' say?') AS question,
               CASE d.doc_id % 7 WHEN 0 THEN 'claims' WHEN 2 THEN 'edge' WHEN 3 THEN 'guardrail' WHEN 4 THEN 'out_of_scope' WHEN 5 THEN 'mixed' ELSE 'underwriting' END AS category,
               CASE d.doc_id % 7 WHEN 1 THEN 'sql' ELSE 'hybrid' END AS intent,
               'underwriter' AS role,
               CASE d.doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
               CASE d.lang WHEN 'en' THEN 'the|OF' WHEN 'de' THEN 'der' ELSE 'la' END AS keywords,
               CASE WHEN d.doc_id % 4 = 0 THEN 'lorem|http' ELSE '' END AS forbidden
        FROM {documents} d""",
    "eval_responses": """
        SELECT concat(CASE d.doc_id % 7 WHEN 0 THEN 'RBAC' WHEN 1 THEN 'SQL' WHEN 2 THEN 'EDGE' ELSE 'DOC' END, '-', CAST(d.doc_id AS STRING)) AS question_id,
               concat('run', CAST(d.doc_id % 14 AS STRING)) AS run_id,
               COALESCE(l.toxic, 0) = 0 AS success,
               d.text AS response, CAST(d.n_chars AS DOUBLE) / 1000 AS elapsed,
               CASE WHEN COALESCE(l.toxic, 0) = 0 THEN 200 ELSE 500 END AS status
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # ---- operational tables -------------------------------------------------
    "insureds": """
        SELECT concat('INS-', CAST(1000 + c.c_custkey AS STRING)) AS insured_id, c.c_name AS company_name,
               n.n_name AS state_domicile, CAST(c.c_custkey % 31 AS INT) AS years_in_business,
               CAST(5 + c.c_custkey % 120 AS INT) AS fleet_size, CAST(6 + c.c_custkey % 150 AS INT) AS driver_count,
               CASE c.c_custkey % 4 WHEN 0 THEN 'Regional' WHEN 1 THEN 'Long Haul' WHEN 2 THEN 'Local' ELSE 'Dedicated' END AS primary_operation,
               CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'Petroleum/Chemicals' WHEN 'AUTOMOBILE' THEN 'Automobiles'
                    WHEN 'HOUSEHOLD' THEN 'Household Goods' WHEN 'BUILDING' THEN 'Construction Materials' ELSE 'General Freight' END AS primary_commodity,
               CASE c.c_custkey % 9 WHEN 0 THEN 'Conditional' WHEN 1 THEN 'Unsatisfactory' ELSE 'Satisfactory' END AS safety_rating,
               CAST(CAST(round(abs(c.c_acctbal) * 10) AS BIGINT) % 1000 AS DOUBLE) / 10 AS csa_unsafe_driving,
               CAST(CAST(round(abs(c.c_acctbal) * 7) AS BIGINT) % 1000 AS DOUBLE) / 10 AS csa_hos,
               CAST(CAST(round(abs(c.c_acctbal) * 3) AS BIGINT) % 1000 AS DOUBLE) / 10 AS csa_vehicle_maint,
               CAST(CAST(round(abs(c.c_acctbal) * 13) AS BIGINT) % 1000 AS DOUBLE) / 10 AS csa_driver_fitness,
               CAST(c.c_custkey * 37 % 101 AS DOUBLE) AS dashcam_coverage_pct,
               CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE 'Samsara' END AS telematics_provider,
               CASE c.c_custkey % 6 WHEN 0 THEN 'Non-standard' WHEN 1 THEN 'Decline' WHEN 2 THEN 'Preferred' ELSE 'Acceptable' END AS risk_tier,
               concat('Sector', CAST(c.c_custkey % 3 AS STRING)) AS naics_sector
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "policies": """
        SELECT concat('POL-', CAST(o_orderkey AS STRING)) AS policy_id, concat('INS-', CAST(1000 + o_custkey AS STRING)) AS insured_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Auto Liability' WHEN '2-HIGH' THEN 'Physical Damage'
                    WHEN '3-MEDIUM' THEN 'Motor Truck Cargo' ELSE 'General Liability' END AS line_of_business,
               CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Expired' ELSE 'Cancelled' END AS policy_status,
               CAST(o_orderdate AS DATE) AS effective_date, CAST(CAST(o_orderdate AS DATE) + INTERVAL '1' YEAR AS DATE) AS expiration_date,
               o_totalprice AS written_premium,
               CASE o_orderkey % 4 WHEN 0 THEN 1000.0e0 WHEN 1 THEN 2500.0e0 WHEN 2 THEN 5000.0e0 ELSE 10000.0e0 END AS deductible,
               CASE o_orderkey % 5 WHEN 0 THEN 'Non-Renew' WHEN 1 THEN 'Review Required' ELSE 'Auto-Renew' END AS renewal_status,
               CAST(year(o_orderdate) AS INT) AS policy_year
        FROM {orders}""",
    "claims": """
        SELECT concat('CLM-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS claim_id,
               concat('POL-', CAST(l.l_orderkey AS STRING)) AS policy_id, concat('INS-', CAST(1000 + o.o_custkey AS STRING)) AS insured_id,
               CAST(l_shipdate AS DATE) AS loss_date, CAST(CAST(l_shipdate AS DATE) + INTERVAL '12' DAY AS DATE) AS report_date,
               CASE WHEN l_linestatus = 'O' THEN 'Open' ELSE 'Closed' END AS claim_status,
               CASE l_partkey % 4 WHEN 0 THEN 'Collision' WHEN 1 THEN 'Cargo' WHEN 2 THEN 'Bodily Injury' ELSE 'Property' END AS loss_type,
               l_suppkey % 6 = 0 AS attorney_involved,
               CASE l_suppkey % 5 WHEN 0 THEN 'Suit Filed' WHEN 1 THEN 'Pre-Suit' WHEN 2 THEN 'Settled' ELSE 'None' END AS litigation_status,
               l_extendedprice AS total_incurred, round(l_extendedprice * l_quantity / 50, 0) AS total_paid,
               l_extendedprice - round(l_extendedprice * l_quantity / 50, 0) AS case_reserves,
               l_partkey % 97 = 0 AS catastrophic_flag, l_partkey % 89 = 0 AS siu_referral, l_extendedprice >= 80000 AS large_loss_flag,
               CAST(year(l_shipdate) AS INT) AS loss_year, CAST(l_linenumber AS INT) AS line_no
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l_returnflag = 'R'""",
    "loss_runs": """
        SELECT concat('LR-', substr(p.insured_id, 5), '-', CAST(p.policy_year AS STRING)) AS loss_run_id, p.insured_id,
               p.policy_year, p.earned_premium,
               COALESCE(c.num_claims, 0) AS num_claims, COALESCE(c.total_incurred, 0) AS total_incurred, COALESCE(c.total_paid, 0) AS total_paid,
               COALESCE(c.large_losses, 0) AS large_losses,
               round(100 * COALESCE(c.total_incurred, 0) / p.earned_premium, 4) AS loss_ratio,
               round(CAST(COALESCE(c.num_claims, 0) AS DOUBLE) / i.fleet_size, 6) AS frequency
        FROM (SELECT insured_id, policy_year, CAST(sum(CAST(written_premium AS DECIMAL(18, 2))) AS DOUBLE) AS earned_premium FROM {policies} GROUP BY insured_id, policy_year) p
        JOIN {insureds} i ON p.insured_id = i.insured_id
        LEFT JOIN (SELECT insured_id, loss_year, CAST(count(*) AS BIGINT) AS num_claims,
                          CAST(sum(CAST(total_incurred AS DECIMAL(18, 2))) AS DOUBLE) AS total_incurred,
                          CAST(sum(CAST(total_paid AS DECIMAL(18, 2))) AS DOUBLE) AS total_paid,
                          CAST(sum(CASE WHEN large_loss_flag THEN 1 ELSE 0 END) AS BIGINT) AS large_losses
                   FROM {claims} GROUP BY insured_id, loss_year) c
          ON p.insured_id = c.insured_id AND p.policy_year = c.loss_year""",
    "submissions": """
        SELECT concat('SUB-', CAST(o.o_orderkey AS STRING)) AS submission_id,
               CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE concat('INS-', CAST(1000 + o.o_custkey AS STRING)) END AS insured_id,
               c.c_name AS company_name, concat('Broker ', CAST(o.o_orderkey % 23 AS STRING)) AS broker_name,
               CAST(o.o_orderdate AS DATE) AS submission_date,
               CASE o.o_orderkey % 6 WHEN 0 THEN 'Received' WHEN 1 THEN 'In Review' WHEN 2 THEN 'Quoted' WHEN 3 THEN 'Bound' WHEN 4 THEN 'Declined' ELSE 'New' END AS submission_status,
               CAST(5 + o.o_custkey % 120 AS INT) AS fleet_size, CAST(6 + o.o_custkey % 150 AS INT) AS driver_count,
               CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'Petroleum/Chemicals' WHEN 'AUTOMOBILE' THEN 'Automobiles'
                    WHEN 'HOUSEHOLD' THEN 'Household Goods' WHEN 'BUILDING' THEN 'Construction Materials' ELSE 'General Freight' END AS primary_commodity,
               o.o_totalprice AS expiring_premium,
               CASE WHEN o.o_orderkey % 6 IN (2, 3) THEN o.o_totalprice + 5000 END AS quoted_premium,
               CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
                    WHEN o.o_orderkey % 2 = 0 THEN CAST(o.o_orderkey * 7 % 101 AS DOUBLE) / 100
                    ELSE CAST(o.o_orderkey * 11 % 1400 AS DOUBLE) / 10 END AS loss_ratio_3yr,
               o.o_orderkey % 8 = 0 AS referral_required,
               CASE WHEN o.o_orderkey % 6 = 4 THEN CASE o.o_orderkey % 4 WHEN 0 THEN 'Loss history' ELSE 'CSA scores' END END AS decline_reason,
               CASE WHEN o.o_orderkey % 6 IN (2, 3) THEN CAST(o.o_orderkey % 15 AS INT) END AS days_to_quote,
               concat(CASE WHEN o.o_orderkey % 2 = 0 THEN 'ACORD 125|' ELSE '' END, CASE WHEN o.o_orderkey % 3 = 0 THEN 'Loss runs|' ELSE '' END,
                      CASE WHEN o.o_orderkey % 5 < 3 THEN 'MVR reports|' ELSE '' END, 'Driver schedule') AS received_docs
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P'""",
    "drivers": """
        SELECT concat('DRV-', CAST(p.p_partkey AS STRING)) AS driver_id,
               c.insured_id, concat('First', CAST(p.p_partkey AS STRING)) AS first_name,
               concat('B', lpad(CAST(1000000 + p.p_partkey AS STRING), 7, '0')) AS cdl_number,
               CAST(concat('19', CAST(60 + p.p_partkey % 39 AS STRING), '-0', CAST(1 + p.p_partkey % 9 AS STRING), '-15') AS DATE) AS date_of_birth,
               CAST(p.p_size % 25 AS INT) AS years_cdl_experience, CAST(p.p_partkey % 8 AS INT) AS mvr_points,
               CASE p.p_partkey % 11 WHEN 0 THEN 'Excluded' WHEN 1 THEN 'Terminated' ELSE 'Active' END AS driver_status,
               p.p_partkey % 29 = 0 AS disqualifying_offense, p.p_partkey % 4 = 0 AS hazmat_endorsement, p.p_partkey % 6 = 0 AS tanker_endorsement,
               CAST(p.p_partkey % 5 AS INT) AS accidents_3yr, CAST(p.p_partkey % 7 AS INT) AS violations_3yr,
               CASE WHEN p.p_partkey % 10 = 3 THEN NULL ELSE CAST(40 + p.p_partkey % 60 AS DOUBLE) END AS telematics_score
        FROM {part} p JOIN (SELECT c_custkey, concat('INS-', CAST(1000 + c_custkey AS STRING)) AS insured_id FROM {customer}) c
          ON p.p_partkey % 150 = c.c_custkey""",
    "vehicles": """
        SELECT concat('VEH-', CAST(p_partkey AS STRING)) AS vehicle_id, concat('POL-', CAST(p_partkey AS STRING)) AS policy_id,
               CAST(2000 + p_size % 25 AS INT) AS year, p_brand AS make, p_type AS vehicle_type, p_retailprice AS stated_value,
               p_partkey % 3 = 0 AS has_dashcam, p_partkey % 8 <> 0 AS has_eld
        FROM {part}""",
    "referrals": """
        SELECT concat('REF-', CAST(o_orderkey AS STRING)) AS referral_id, concat('SUB-', CAST(o_orderkey AS STRING)) AS submission_id,
               concat('INS-', CAST(1000 + o_custkey AS STRING)) AS insured_id, CAST(o_orderdate AS DATE) AS referral_date,
               CASE o_orderkey % 3 WHEN 0 THEN 'Loss History' WHEN 1 THEN 'CSA Scores' ELSE 'Risk Appetite' END AS referral_reason,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Reserve Committee' WHEN '2-HIGH' THEN 'CCO' ELSE 'VP UW' END AS referral_tier,
               CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Approved with Conditions' WHEN 2 THEN 'Declined' ELSE 'Approved' END AS decision
        FROM {orders} WHERE o_orderstatus = 'P'""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _spelling(text: str, names: dict[str, str]) -> str:
    return re.sub(r"@(\w+)@", lambda m: names[m.group(1)], text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a model table built on Spark from the given ones."""
    if name in BASE_TABLES:
        given = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(given) if name in TEXT_TABLES else given
    text = _spelling(MODELS[name], _SPARK)
    inputs = {n: table(spark, sf_dir, n) for n in sorted(set(_NAME.findall(text)))}
    return spark.sql(text, **inputs)


def _collect(name: str, seen: dict[str, str]) -> None:
    if name in BASE_TABLES or name in seen:
        return
    text = _spelling(MODELS[name], _ANSI)
    for other in sorted(set(_NAME.findall(text))):
        _collect(other, seen)
    seen[name] = _NAME.sub(r"\1", text)


def with_models(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the common table expressions it needs, for the check engine."""
    seen: dict[str, str] = {}
    for name in names:
        _collect(name, seen)
    for name, text in (extra or {}).items():
        seen[name] = text
    if not seen:
        return body
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in seen.items())
    return f"WITH {ctes}\n{body}"
