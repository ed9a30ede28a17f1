"""Guardrails, routing, role filters, statement audit."""

import pytest
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions import text as tx
from haulmark.operators import access, guardrails, search

CITE = " [Manual, 3.4]"


def guard(spark, answer, rules=None):
    df = spark.createDataFrame([(answer,)], "answer string")
    return guardrails.apply_guardrails(df, rules).first().guarded


def test_clean_answer_passes(spark):
    g = guard(spark, "All fine." + CITE)
    assert (g.answer, g.blocked, g.applied_rules, g.redacted_items, g.action) == ("All fine." + CITE, False, [], [], "PASS")


@pytest.mark.parametrize("text", ["I approve this risk", "COVERAGE IS BOUND today", "here is competitor pricing"])
def test_block_ends_the_rules(spark, text):
    g = guard(spark, text + " SSN 123-45-6789")
    assert g.blocked and g.action == "BLOCK" and len(g.applied_rules) == 1 and g.redacted_items == []
    assert "123" not in g.answer


def test_redacts_two_kinds(spark):
    g = guard(spark, "SSN 123-45-6789, call 555-123-4567." + CITE)
    assert g.answer == "SSN [SSN REDACTED], call [PHONE REDACTED]." + CITE
    assert g.redacted_items == ["SSN", "PHONE_NUMBER"]
    assert g.applied_rules == ["REDACTED by pii_redactor: ['SSN', 'PHONE_NUMBER']"]


def test_redaction_tag_counts_as_citation(spark):
    assert guard(spark, "SSN 123-45-6789").action == "REDACT"


def test_disclaimer_once(spark):
    disclaimer = fv.GUARDRAIL_RULES[3]["disclaimer"]
    once = guard(spark, "About coverage interpretation." + CITE)
    assert once.answer.endswith("\n\n" + disclaimer) and once.action == "APPEND"
    assert guard(spark, once.answer).answer == once.answer


@pytest.mark.parametrize("text", ["see § 4", "Source 2 says", "per the manual", "According to x", "[Guide]"])
def test_citation_forms(spark, text):
    assert guard(spark, text).action == "PASS"


def test_reminder(spark):
    g = guard(spark, "No reference")
    assert g.applied_rules == ["CITATION REMINDER by citation_enforcer"]


def test_priority_order(spark):
    rules = [
        {"name": "late", "action": "BLOCK", "trigger_phrases": ["x"], "blocked_message": "late"},
        {"name": "early", "priority": 1, "action": "BLOCK", "trigger_phrases": ["X"], "blocked_message": "early"},
    ]
    assert guard(spark, "an x", rules).answer == "early"


def test_empty_rules(spark):
    assert guard(spark, "text", []).answer == "text"


@pytest.mark.parametrize(
    "question, intent",
    [
        ("What is clm-24-1001 about", "keyword"),
        ("How many open claims does INS-1002 have?", "keyword"),
        ("How many trucks", "sql"),
        ("Show the LOSS RATIO", "sql"),
        ("Referral triggers for hazmat", "hybrid"),
        ("INSURE-1 things", "hybrid"),
    ],
)
def test_intent(spark, question, intent):
    assert spark.range(1).select(tx.detect_intent(F.lit(question)).alias("i")).first().i == intent


@pytest.mark.parametrize(
    "sql, verdict",
    [
        ("select 1", "ALLOWED"),
        ("SELECT updated FROM t", "ALLOWED"),
        ("select 1; drop table t", "BLOCKED_DROP"),
        ("insert into t delete", "BLOCKED_DELETE"),
        ("with a as (select 1) select * from a", "NOT_SELECT"),
        ("-- none", "NO_ANSWER"),
        ("```sql\nselect 1\n```", "ALLOWED"),
        ("```select 2```", "ALLOWED"),
    ],
)
def test_statement_audit(spark, sql, verdict):
    assert spark.range(1).select(tx.sql_verdict(tx.strip_fences(F.lit(sql))).alias("v")).first().v == verdict


@pytest.mark.parametrize(
    "stem, name",
    [("Gulf_Coast_Haulers_LR_2024", "Gulf Coast Haulers"), ("acme-line_2024_policy", "Acme Line 2024"), ("_2024", "2024"), ("plain", "Plain")],
)
def test_display_name(spark, stem, name):
    assert spark.range(1).select(tx.display_name(F.lit(stem)).alias("n")).first().n == name


def test_roles(spark):
    policy = access.role_policy(spark)
    known = {r.role: r.allowed for r in policy.collect()}
    assert known["underwriter"] is None and known["broker"] == fv.ROLE_CATEGORIES["broker"]
    asked = spark.createDataFrame([(1, "broker"), (2, "nobody")], "query_id long, role string")
    assert access.with_allowed(asked.where("query_id = 1"), policy).first().allowed == fv.ROLE_CATEGORIES["broker"]
    with pytest.raises(Exception, match="unknown role"):
        access.with_allowed(asked, policy).collect()


def context(spark, scores):
    rows = [(1, f"c{i}", i + 1, s) for i, s in enumerate(scores)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, score double")
    return [r.chunk_id for r in search.select_context(hits).orderBy("source_no").collect()]


def test_context_selection(spark):
    assert context(spark, [0.9, 0.8, 0.7]) == ["c0", "c1"]
    assert context(spark, [0.5, 0.4, 0.3, 0.2]) == ["c0", "c1", "c2"]
    assert len(context(spark, [0.9] * 8)) == 6


def test_context_text(spark):
    row = [(1, 1, "body", "Loss Runs", "/a/b.pdf"), (1, 2, "more", "Emails", "")]
    df = spark.createDataFrame(row, "query_id long, source_no int, chunk_text string, category string, source_path string")
    text = search.context_text(df).first().context
    assert text == "## Retrieved Context\n\n\n### Source 1: b.pdf (Loss Runs)\nbody\n\n### Source 2: unknown (Emails)\nmore"
