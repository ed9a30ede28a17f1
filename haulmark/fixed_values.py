"""Values that decide results and therefore must not drift.

Everything here is a FIXED VALUE: word lists, patterns, lookup tables, texts and
thresholds that the data contract prescribes.  Operators take them as defaults and
accept other values as parameters.
"""

# --- fixed values: character classes -----------------------------------------
# Whitespace as the text contract understands it (Unicode spaces included),
# written for a Java character class; INLINE_SPACE is the same without newline.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE_SPACE = r"\x09\x0b-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# The same set written out, for trimming.
SPACE_CHARACTERS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f "
    "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: chunk sizes in characters ---------------------------------
PARENT_SIZE = 2500
CHILD_SIZE = 600
OVERLAP = 100

# --- fixed values: document categories (folder id -> label) ------------------
CATEGORY_LABELS = {
    "00_reference": "Reference Materials",
    "01_underwriting": "Underwriting Guidelines",
    "02_claims": "Claims Procedures",
    "03_loss_control": "Loss Control",
    "04_authority": "Authority & Limits",
    "05_product_guides": "Product Guides",
    "06_policies": "Policy Documents",
    "07_submissions": "Submissions",
    "08_loss_runs": "Loss Runs",
    "09_claim_files": "Claim Files",
    "10_fleet_inspections": "Fleet Inspections",
    "11_loss_control_reports": "Loss Control Reports",
    "12_emails": "Email Correspondence",
    "13_underwriter_notes": "Underwriter Notes",
    "14_meeting_minutes": "Meeting Minutes",
    "15_regulatory": "Regulatory & Compliance",
}

# --- fixed values: role -> visible category labels ("all" = unrestricted) ----
ROLE_CATEGORIES = {
    "underwriter": ["all"],
    "senior_underwriter": ["all"],
    "executive": ["all"],
    "claims_adjuster": [
        "Claims Procedures",
        "Claim Files",
        "Loss Runs",
        "Regulatory & Compliance",
        "Product Guides",
    ],
    "claims_director": [
        "Claims Procedures",
        "Claim Files",
        "Loss Runs",
        "Regulatory & Compliance",
        "Meeting Minutes",
    ],
    "broker": ["Product Guides", "Underwriting Guidelines", "Policy Documents"],
    "loss_control": [
        "Fleet Inspections",
        "Loss Control",
        "Loss Control Reports",
        "Reference Materials",
    ],
    "compliance_officer": [
        "Regulatory & Compliance",
        "Policy Documents",
        "Claims Procedures",
    ],
}

# --- fixed values: question routing ------------------------------------------
REFERENCE_ID = r"(?i)\b(?:ACI|CLM|SUB|INS|DRV|POL|LR)-[\w-]+\b"
SQL_KEYWORDS = [
    "loss ratio",
    "premium",
    "claims count",
    "how many",
    "total loss",
    "average",
    "sum of",
    "fleet size",
    "number of drivers",
    "written premium",
    "earned premium",
    "incurred loss",
    "ytd",
    "year to date",
]
BLOCKED_STATEMENTS = [
    "DROP",
    "DELETE",
    "INSERT",
    "UPDATE",
    "ALTER",
    "CREATE",
    "TRUNCATE",
    "MERGE",
]
FILE_STEM_SUFFIXES = [
    "_lr_",
    "_loss_run",
    "_submission",
    "_application",
    "_policy",
    "_acord",
    "_mvr",
    "_claims",
    "_2020",
    "_2021",
    "_2022",
    "_2023",
    "_2024",
    "_2025",
    "_2026",
]

# --- fixed values: retrieval --------------------------------------------------
SIMILARITY_THRESHOLD = 0.75
CONTEXT_MIN = 3
CONTEXT_MAX = 6
SEARCH_RESULTS = 8
SIMILAR_ACCOUNTS = 10
BM25_K1 = 1.2
BM25_B = 0.75
RRF_CONSTANT = 60

# --- fixed values: guardrail rules -------------------------------------------
CITATION_PATTERNS = [
    r"(?i)\[.{3,80}\]",
    r"(?i)§\s*\d",
    r"(?i)\bsource\s*\d",
    r"(?i)\bper\s+the\b",
    r"(?i)\baccording\s+to\b",
]
GUARDRAIL_RULES = [
    {
        "name": "binding_opinion_blocker",
        "priority": 1,
        "action": "BLOCK",
        "trigger_phrases": [
            "I approve this",
            "coverage is bound",
            "you are approved",
            "policy is bound",
            "I decline this",
            "coverage is declined",
            "I can bind",
            "risk is accepted",
        ],
        "blocked_message": (
            "I cannot approve, decline, bind, or quote coverage. All underwriting\n"
            "decisions require human authority. Please review the relevant guidelines\n"
            "and consult your underwriting team.\n"
        ),
    },
    {
        "name": "prohibited_topic_filter",
        "priority": 2,
        "action": "BLOCK",
        "prohibited_topics": [
            "competitor_pricing",
            "legal_advice",
            "employment_advice",
            "discriminatory_risk_criteria",
            "regulatory_violations",
        ],
        "blocked_message": (
            "I cannot assist with that topic. For legal questions, please consult\n"
            "legal counsel. For regulatory guidance, refer to your compliance team.\n"
        ),
    },
    {
        "name": "pii_redactor",
        "priority": 3,
        "action": "REDACT",
        "patterns": [
            {"name": "SSN", "regex": r"\b\d{3}-\d{2}-\d{4}\b", "replacement": "[SSN REDACTED]"},
            {"name": "CDL_NUMBER", "regex": r"\b[A-Z]{1,2}\d{6,9}\b", "replacement": "[CDL REDACTED]"},
            {
                "name": "DATE_OF_BIRTH",
                "regex": r"\b(0[1-9]|1[0-2])/(0[1-9]|[12]\d|3[01])/(19|20)\d{2}\b",
                "replacement": "[DOB REDACTED]",
            },
            {
                "name": "PHONE_NUMBER",
                "regex": r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
                "replacement": "[PHONE REDACTED]",
            },
        ],
    },
    {
        "name": "coverage_disclaimer",
        "priority": 4,
        "action": "APPEND",
        "trigger_topics": [
            "coverage_interpretation",
            "policy_terms_explanation",
            "exclusion_analysis",
        ],
        "disclaimer": (
            "---\n"
            "*This response is for informational purposes only and does not constitute\n"
            "a legal interpretation of policy language. Coverage determinations require\n"
            "review of the actual policy form, endorsements, and applicable jurisdiction\n"
            "law by a qualified professional.*"
        ),
    },
    {
        "name": "citation_enforcer",
        "priority": 5,
        "action": "APPEND_IF_NO_CITATION",
        "reminder": (
            "*Please verify this information against the source documents in your\n"
            "document management system.*"
        ),
    },
]

# --- fixed values: conversations, feedback, evaluation -----------------------
HISTORY_MESSAGES = 10
COMPACTION_THRESHOLD = 20
PROMPT_HISTORY = 8
PROMOTION_MINIMUM = 5
PROMOTION_LIMIT = 100
PASS_RATE_GATE = 80.0
METRIC_GATES = {"relevance": 0.80, "safety": 0.95, "faithfulness": 0.75}
DRIFT_TOLERANCE_PCT = 5.0
# metric -> (target, alert threshold, direction in which the alert fires)
OPERATION_TARGETS = {
    "response_p95_s": (5.0, 8.0, "above"),
    "citation_coverage_pct": (95.0, 90.0, "below"),
    "satisfaction_pct": (90.0, 80.0, "below"),
    "guardrail_trigger_pct": (10.0, 20.0, "above"),
    "binding_block_pct": (1.0, 3.0, "above"),
    "vector_hit_pct": (80.0, 70.0, "below"),
}

# --- fixed values: underwriting ----------------------------------------------
LARGE_LOSS = 250000
RESERVE_COMMITTEE_CLAIM = 650000
# The source names no cargo of high value: a parameter of the referral rules.
HIGH_VALUE_CARGO = ["Automobiles", "Electronics", "Pharmaceuticals"]
CSA_SCORES = ["csa_unsafe_driving", "csa_hos", "csa_vehicle_maint", "csa_driver_fitness"]
REQUIRED_DOCUMENTS = [
    "ACORD 125",
    "Loss runs",
    "Driver schedule",
    "MVR reports",
    "Vehicle schedule",
    "Financials",
]
