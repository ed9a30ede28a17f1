"""Queries over conversations, feedback and evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.operators import evaluation as ev
from haulmark.operators import feedback as fb
from haulmark.operators import guardrails, operations, sessions
from haulmark.plans import check_sql as cs
from haulmark.plans.models import table, with_models
from haulmark.plans.registry import query
from haulmark.sources.sizing import materialize

# ---- conversations -----------------------------------------------------------

_RECENT = "row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, content DESC)"
_OLDEST = "row_number() OVER (PARTITION BY session_id ORDER BY created_at, content)"


@query(
    "c01_history_last",
    with_models(
        f"""SELECT session_id, {_OLDEST} AS position, role, content FROM
            (SELECT *, {_RECENT} AS back FROM sessions) WHERE back <= 4""",
        "sessions",
    ),
)
def c01(spark, sf):
    return sessions.history(table(spark, sf, "sessions"), 4).select("session_id", "position", "role", "content")


@query(
    "c01_history_oldest",
    with_models(
        f"SELECT * FROM (SELECT session_id, {_OLDEST} AS position, role, content FROM sessions) WHERE position <= 4", "sessions"
    ),
)
def c01_oldest(spark, sf):
    oldest = sessions.history(table(spark, sf, "sessions"), 4, "oldest")
    return oldest.select("session_id", "position", "role", "content")


@query("c02_message_counts", with_models("SELECT session_id, count(*) AS n_messages FROM sessions GROUP BY session_id", "sessions"))
def c02(spark, sf):
    return sessions.message_counts(table(spark, sf, "sessions"))


@query(
    "c03_compaction",
    with_models(
        """SELECT session_id, role, content, user_id FROM numbered WHERE NOT (total >= 6 AND rn <= total // 2)
           UNION ALL
           SELECT session_id, 'system', concat('Earlier conversation summary: ', string_agg(concat('[', role, '] ', left(content, 100)), '; ' ORDER BY rn)), 'system'
           FROM numbered WHERE total >= 6 AND rn <= total // 2 GROUP BY session_id""",
        "sessions",
        extra={"numbered": f"SELECT *, {_OLDEST} AS rn, count(*) OVER (PARTITION BY session_id) AS total FROM sessions"},
    ),
)
def c03(spark, sf):
    return sessions.compact(table(spark, sf, "sessions"), threshold=6).drop("created_at")


@query(
    "c04_clear_sessions",
    with_models(
        "SELECT session_id, role, content FROM sessions WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE role = 'system')",
        "sessions",
    ),
)
def c04(spark, sf):
    messages = table(spark, sf, "sessions").select("session_id", "role", "content")
    return sessions.clear(messages, messages.where("role = 'system'"))


@query(
    "c05_last_user_message",
    with_models(
        f"SELECT session_id, content FROM (SELECT *, {_RECENT} AS back FROM sessions WHERE role = 'user' AND content <> '') WHERE back = 1",
        "sessions",
    ),
)
def c05(spark, sf):
    return sessions.last_user_message(table(spark, sf, "sessions"))


@query(
    "c05_prompt_history",
    with_models(f"SELECT session_id, role, content FROM (SELECT *, {_RECENT} AS back FROM sessions) WHERE back <= 8", "sessions"),
)
def c05_history(spark, sf):
    return sessions.history(table(spark, sf, "sessions"), fv.PROMPT_HISTORY).select("session_id", "role", "content")


# ---- feedback ----------------------------------------------------------------


@query(
    "f01_encode_rating",
    with_models("SELECT event_id, CASE WHEN rating = 'thumbs_up' THEN 1 ELSE -1 END AS rating FROM ratings", "ratings"),
)
def f01(spark, sf):
    return table(spark, sf, "ratings").select("event_id", fb.encode_rating(F.col("rating")).alias("rating"))


_UP = "count(*) FILTER (WHERE rating = 1)"


@query(
    "f02_feedback_stats",
    with_models(
        f"""SELECT count(*) AS total_feedback, {_UP} AS thumbs_up, count(*) FILTER (WHERE rating = -1) AS thumbs_down,
                   round({_UP} * 100.0 / count(*), 1) AS satisfaction_pct, count(*) FILTER (WHERE promoted_to_eval) AS promoted_count FROM feedback""",
        "feedback",
    ),
)
def f02(spark, sf):
    return fb.feedback_stats(table(spark, sf, "feedback"))


_NEGATIVE = """SELECT feedback_id, created_at, user_id, question, left(answer, 200) AS response_preview, comment, intent_classification
    FROM feedback WHERE rating = -1 AND NOT promoted_to_eval ORDER BY created_at DESC, feedback_id LIMIT {n}"""


@query(
    "f03_negative_feedback",
    with_models(
        "SELECT feedback_id, user_id, question, response_preview, comment, intent_classification FROM negative",
        "feedback",
        extra={"negative": _NEGATIVE.format(n=20)},
    ),
)
def f03(spark, sf):
    return fb.negative_feedback(table(spark, sf, "feedback")).drop("created_at")


_PROMOTED = """SELECT question AS query, 'user_feedback' AS source, feedback_id,
    COALESCE(NULLIF(comment, ''), concat('Previous response was rated negatively: ', left(response_preview, 100))) AS expected_facts
    FROM negative WHERE (SELECT count(*) FROM negative) >= 5"""


@query(
    "f04_promote_to_eval",
    with_models(_PROMOTED, "feedback", extra={"negative": _NEGATIVE.format(n=100)}),
)
def f04(spark, sf):
    return fb.promote_to_eval(table(spark, sf, "feedback"))


@query(
    "f04_mark_promoted",
    with_models(
        "SELECT feedback_id, promoted_to_eval OR feedback_id IN (SELECT feedback_id FROM entries) AS promoted_to_eval FROM feedback",
        "feedback",
        extra={"negative": _NEGATIVE.format(n=100), "entries": _PROMOTED},
    ),
)
def f04_mark(spark, sf):
    feedback = table(spark, sf, "feedback")
    return fb.mark_promoted(feedback, fb.promote_to_eval(feedback)).select("feedback_id", "promoted_to_eval")


_TREND = f"count(*) AS total, {_UP} AS positive, round({_UP} * 100.0 / count(*), 1) AS satisfaction_pct FROM feedback"


@query(
    "f05_trends_by_intent",
    with_models(
        f"SELECT CAST(created_at AS DATE) AS feedback_date, intent_classification, {_TREND} GROUP BY 1, 2", "feedback"
    ),
)
def f05(spark, sf):
    return fb.quality_trends(table(spark, sf, "feedback"))


@query("f05_trends_by_day", with_models(f"SELECT CAST(created_at AS DATE) AS feedback_date, {_TREND} GROUP BY 1", "feedback"))
def f05_day(spark, sf):
    return fb.quality_trends(table(spark, sf, "feedback"), by_intent=False)


@query(
    "f06_override_matrix",
    with_models(
        "SELECT ai_recommendation, "
        + ", ".join(f"count(*) FILTER (WHERE uw_decision = '{d}') AS {d}" for d in ("Approve", "Refer", "Decline"))
        + " FROM overrides GROUP BY ai_recommendation",
        "overrides",
    ),
)
def f06(spark, sf):
    return fb.override_matrix(table(spark, sf, "overrides"), ["Approve", "Refer", "Decline"])


@query(
    "f06_override_rate",
    with_models(
        """SELECT override_reason, count(*) AS n_decisions, count(*) FILTER (WHERE ai_recommendation <> uw_decision) AS n_overrides,
                  round(count(*) FILTER (WHERE ai_recommendation <> uw_decision) * 100.0 / count(*), 4) AS override_pct
           FROM overrides GROUP BY override_reason""",
        "overrides",
    ),
)
def f06_rate(spark, sf):
    return fb.override_rate(table(spark, sf, "overrides"))


@query(
    "f07_eval_export",
    with_models(
        """SELECT feedback_id AS source_id, 'feedback' AS source, question AS subject, CAST(1 AS DOUBLE) AS weight FROM feedback WHERE rating = -1
           UNION ALL SELECT override_id, 'override', submission_id, CAST(2 AS DOUBLE) FROM overrides""",
        "feedback",
        "overrides",
    ),
)
def f07(spark, sf):
    return fb.eval_export(table(spark, sf, "feedback"), table(spark, sf, "overrides"))


# ---- evaluation --------------------------------------------------------------


def _words(column):
    return F.when(F.length(column) > 0, F.split(column, r"\|")).otherwise(F.array().cast("array<string>"))


def questions(spark, sf):
    return table(spark, sf, "eval_questions").select(
        "*", _words("keywords").alias("expected_keywords"), _words("forbidden").alias("should_not_contain")
    )


def checked(spark, sf):
    return ev.check_responses(questions(spark, sf), table(spark, sf, "eval_responses"))


_SPLIT = lambda c: f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, '|') END"
_FULL = f"length({cs.strip('r.response')}) >= 10"
_CHECKED = {
    "checked": f"""
        SELECT r.*, q.question, q.category, q.intent, q.role, q.difficulty, names,
               length(names) = 0 AS passed
        FROM eval_responses r JOIN eval_questions q ON r.question_id = q.question_id
        JOIN LATERAL (SELECT CASE WHEN NOT r.success THEN ['endpoint_success'] ELSE
            list_concat(CASE WHEN {_FULL} THEN [] ELSE ['non_empty'] END,
              list_concat([concat('has_keyword:', k) FOR k IN {_SPLIT('q.keywords')} IF NOT contains(lower(r.response), lower(k))],
                          [concat('not_contains:', p) FOR p IN {_SPLIT('q.forbidden')} IF contains(lower(r.response), lower(p))])) END AS names) ON TRUE"""
}


def _checked_sql(body: str, **extra: str) -> str:
    return with_models(body, "eval_questions", "eval_responses", extra={**_CHECKED, **extra})


@query(
    "e01_check_responses",
    _checked_sql(
        f"""SELECT c.question_id, passed, array_to_string(names, ', ') AS failed,
                   CASE WHEN success THEN 1 + len({_SPLIT('q.keywords')}) + len({_SPLIT('q.forbidden')}) ELSE 1 END AS n_checks,
                   CASE WHEN success THEN concat(length(response), ' chars') ELSE concat('HTTP ', status, ': ', left(response, 100)) END AS first_detail
            FROM (SELECT * FROM checked WHERE NOT success OR length({cs.strip('response')}) >= 10) c JOIN eval_questions q ON q.question_id = c.question_id
            UNION ALL
            SELECT c.question_id, passed, array_to_string(names, ', '), 1 + len({_SPLIT('q.keywords')}) + len({_SPLIT('q.forbidden')}),
                   concat('Response too short (', length(response), ' chars)')
            FROM (SELECT * FROM checked WHERE success AND length({cs.strip('response')}) < 10) c JOIN eval_questions q ON q.question_id = c.question_id"""
    ),
)
def e01(spark, sf):
    return checked(spark, sf).select(
        "question_id",
        "passed",
        ev.failed_names(F.col("checks")).alias("failed"),
        F.size("checks").alias("n_checks"),
        F.col("checks")[0]["detail"].alias("first_detail"),
    )


_SECTION = """CASE WHEN intent = 'sql' THEN 'sql' WHEN category = 'guardrail' THEN 'guardrail'
    WHEN category IN ('out_of_scope', 'edge', 'mixed') THEN 'edge' WHEN starts_with(question_id, 'RBAC') THEN 'rbac' ELSE 'document' END"""


@query("e02_section_labels", with_models(f"SELECT question_id, {_SECTION} AS section FROM eval_questions", "eval_questions"))
def e02(spark, sf):
    label = ev.section_label(F.col("question_id"), F.col("category"), F.col("intent"))
    return table(spark, sf, "eval_questions").select("question_id", label.alias("section"))


@query(
    "e03_summary",
    _checked_sql(
        """SELECT breakdown, label, count(*) AS n_questions, count(*) FILTER (WHERE passed) AS n_passed,
                  round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 4) AS pass_pct,
                  round(avg(elapsed) FILTER (WHERE elapsed > 0), 4) AS avg_s, min(elapsed) FILTER (WHERE elapsed > 0) AS min_s,
                  max(elapsed) FILTER (WHERE elapsed > 0) AS max_s,
                  list_sort(list(elapsed) FILTER (WHERE elapsed > 0))[CAST(floor(count(*) FILTER (WHERE elapsed > 0) * 0.95) AS BIGINT) + 1] AS p95_s
           FROM cells GROUP BY breakdown, label""",
        cells=f"""SELECT 'all' AS breakdown, 'all' AS label, passed, elapsed FROM checked
            UNION ALL SELECT 'section', {_SECTION}, passed, elapsed FROM checked UNION ALL SELECT 'difficulty', difficulty, passed, elapsed FROM checked""",
    ),
)
def e03(spark, sf):
    return ev.summarize(checked(spark, sf))


_RUNS = """SELECT run_id, count(*) AS total_questions, count(*) FILTER (WHERE passed) AS n_passed, round(avg(elapsed), 4) AS avg_response_s,
    round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 1) AS pass_rate_pct FROM checked GROUP BY run_id"""


@query("e04_run_history", _checked_sql(f"{_RUNS} ORDER BY run_id DESC LIMIT 10"))
def e04(spark, sf):
    return ev.run_history(checked(spark, sf))


@query(
    "e05_failures",
    _checked_sql(
        """SELECT question_id, question, category, intent, role, difficulty, left(response, 300) AS response_preview,
                  array_to_string(names, ', ') AS failed_checks FROM checked WHERE NOT passed"""
    ),
)
def e05(spark, sf):
    return ev.failures(checked(spark, sf))


@query(
    "e06_gates",
    with_models(
        """SELECT m.metric, m.value, t.threshold, CASE WHEN m.value >= t.threshold THEN 'PASS' ELSE 'FAIL' END AS verdict
           FROM (SELECT 'relevance' AS metric, round(avg(CAST(quality AS DOUBLE)), 4) AS value FROM labels
                 UNION ALL SELECT 'safety', round(avg(1 - CAST(toxic AS DOUBLE)), 4) FROM labels
                 UNION ALL SELECT 'faithfulness', round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) FROM labels) m
           JOIN (VALUES ('relevance', CAST(0.8 AS DOUBLE)), ('safety', CAST(0.95 AS DOUBLE)), ('faithfulness', CAST(0.75 AS DOUBLE))) AS t(metric, threshold)
             ON m.metric = t.metric"""
    ),
)
def e06(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    metrics = table(spark, sf, "labels").agg(
        share(F.col("quality")).alias("relevance"),
        share(1 - F.col("toxic")).alias("safety"),
        share(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("faithfulness"),
    ).unpivot([], list(fv.METRIC_GATES), "metric", "value")
    gates = spark.createDataFrame(list(fv.METRIC_GATES.items()), "metric string, threshold double")
    return ev.gate(metrics, gates)


@query(
    "e06_pass_rate_gate",
    _checked_sql(
        """SELECT run_id, pass_rate_pct, CASE WHEN pass_rate_pct >= 80 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM runs""",
        runs=_RUNS,
    ),
)
def e06_rate(spark, sf):
    runs = ev.run_rates(checked(spark, sf))
    verdict = F.when(F.col("pass_rate_pct") >= fv.PASS_RATE_GATE, "PASS").otherwise("FAIL")
    return runs.select("run_id", "pass_rate_pct", verdict.alias("verdict"))


@query(
    "e07_sample_run",
    with_models(
        "SELECT question_id, category FROM eval_questions ORDER BY sha256(concat('7:', question_id)), question_id LIMIT 20", "eval_questions"
    ),
)
def e07(spark, sf):
    return ev.select_run(table(spark, sf, "eval_questions"), "sample", seed=7).select("question_id", "category")


@query(
    "e07_section_run",
    with_models(
        "SELECT question_id, category FROM eval_questions WHERE category = 'edge' OR intent = 'edge' OR lower(split_part(question_id, '-', 1)) = 'edge'",
        "eval_questions",
    ),
)
def e07_section(spark, sf):
    return ev.select_run(table(spark, sf, "eval_questions"), "section", "Edge").select("question_id", "category")


@query(
    "e08_drift",
    _checked_sql(
        """SELECT run_id, pass_rate_pct, round((pass_rate_pct - b.v) * 100 / b.v, 4) AS change_pct,
                  COALESCE(round((pass_rate_pct - b.v) * 100 / b.v, 4) < -5, FALSE) AS alert
           FROM runs, (SELECT NULLIF(max(pass_rate_pct), 0) AS v FROM runs WHERE run_id = 'run0') b""",
        runs=_RUNS,
    ),
)
def e08(spark, sf):
    return ev.drift(ev.run_rates(checked(spark, sf)), "pass_rate_pct", "run0")


@query(
    "e09_operation_alerts",
    with_models(
        """SELECT m.metric, m.value, t.target, t.alert, t.direction,
                  CASE WHEN (t.direction = 'above' AND m.value > t.alert) OR (t.direction = 'below' AND m.value < t.alert) THEN 'ALERT'
                       WHEN (t.direction = 'above' AND m.value > t.target) OR (t.direction = 'below' AND m.value < t.target) THEN 'WARN' ELSE 'OK' END AS state
           FROM (SELECT 'satisfaction_pct' AS metric, round(count(*) FILTER (WHERE rating = 1) * 100.0 / count(*), 4) AS value FROM feedback
                 UNION ALL SELECT 'guardrail_trigger_pct', round(count(*) FILTER (WHERE applied_rules <> '') * 100.0 / count(*), 4) FROM guarded
                 UNION ALL SELECT 'binding_block_pct', round(count(*) FILTER (WHERE contains(applied_rules, 'binding_opinion')) * 100.0 / count(*), 4) FROM guarded
                 UNION ALL SELECT 'response_p95_s', list_sort(list(elapsed))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] FROM eval_responses) m
           JOIN (VALUES """
        + ", ".join(f"('{k}', CAST({t} AS DOUBLE), CAST({a} AS DOUBLE), '{d}')" for k, (t, a, d) in fv.OPERATION_TARGETS.items())
        + ") AS t(metric, target, alert, direction) ON m.metric = t.metric",
        "feedback",
        "answers",
        "eval_responses",
        extra=cs.guardrails(),
    ),
)
def e09(spark, sf):
    from haulmark.functions.ranking import nearest_rank

    n = F.count(F.lit(1))
    rate = lambda c: F.round(F.count_if(c) * 100 / n, 4).alias("value")
    guarded = guardrails.apply_guardrails(table(spark, sf, "answers"))
    applied = F.col("guarded.applied_rules")
    rows = [
        ("satisfaction_pct", table(spark, sf, "feedback").agg(rate(F.col("rating") == 1))),
        ("guardrail_trigger_pct", guarded.agg(rate(F.size(applied) > 0))),
        ("binding_block_pct", guarded.agg(rate(F.exists(applied, lambda r: r.contains("binding_opinion"))))),
        ("response_p95_s", nearest_rank(table(spark, sf, "eval_responses"), [], "elapsed", 0.95, "value")),
    ]
    metrics = None
    for name, df in rows:
        part = df.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        metrics = part if metrics is None else metrics.unionByName(part)
    targets = spark.createDataFrame(
        [(k, *v) for k, v in fv.OPERATION_TARGETS.items()], "metric string, target double, alert double, direction string"
    )
    return ev.operation_alerts(metrics, targets)


# A document is a file that arrived with the event of its number; the index takes files in every
# half hour and commits some seconds later.  The last three half hours aren't committed yet.
_FRESH = {
    "arrivals": """SELECT d.source AS category, e.ts AS arrived_at, epoch_us(e.ts) // 1800000000 AS batch_id
        FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "commits": """SELECT batch_id, batch_id * 1800 + 1800 + batch_id % 240 AS committed_s FROM (SELECT DISTINCT batch_id FROM arrivals)
        WHERE batch_id < (SELECT max(batch_id) FROM arrivals) - 2""",
    "lags": """SELECT a.category, epoch_us(a.arrived_at) // 1000000 AS arrived_s, committed_s FROM arrivals a LEFT JOIN commits c ON c.batch_id = a.batch_id""",
}


@query(
    "e09_freshness",
    with_models(
        """SELECT category, count(committed_s) AS n_indexed, count(*) - count(committed_s) AS n_open,
                  list_sort(list(committed_s - arrived_s) FILTER (committed_s IS NOT NULL))[CAST(floor(count(committed_s) * 0.95) AS BIGINT) + 1] AS p95_lag_s,
                  max((SELECT max(arrived_s) FROM lags) - arrived_s) FILTER (committed_s IS NULL) AS oldest_open_s
           FROM lags GROUP BY category""",
        extra=_FRESH,
    ),
)
def e09_freshness(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("arrived_at"))
    batch = F.floor(F.unix_micros("arrived_at") / 1800000000)
    files = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category")).join(events, "doc_id").withColumn("batch_id", batch)
    last = files.agg(F.max("batch_id").alias("b"), F.max("arrived_at").alias("t")).first()
    commits = files.select("batch_id").distinct().where(F.col("batch_id") < F.lit(last.b) - 2)
    commits = commits.withColumn("committed_at", F.timestamp_seconds(F.col("batch_id") * 1800 + 1800 + F.col("batch_id") % 240))
    return operations.freshness(files, commits, F.lit(last.t))


# Answers, ratings and searches carry the time of their turn or event.
_TURN = "make_timestamp(CAST(1704067200000000 AS BIGINT) + CAST(split_part(answer_id, '-', 1) AS BIGINT) * 3600000000 + CAST(split_part(answer_id, '-', 2) AS BIGINT) * 60000000)"
_SERIES = {
    **cs.guardrails(),
    "told": f"""SELECT CAST({_TURN} AS DATE) AS day, applied_rules, NOT contains(applied_rules, 'CITATION REMINDER') AS cited FROM guarded""",
    "looked": """SELECT CAST(ts AS DATE) AS day, value >= 20 AS hit FROM events WHERE event_type = 'view'""",
    "waited": """SELECT CAST(ts AS DATE) AS day, CAST(round(value / 10 * 1000) AS BIGINT) AS ms FROM events WHERE event_type IN ('view', 'click')""",
}


def _period(unit: str) -> str:
    at = "day" if unit == "day" else f"CAST(date_trunc('{unit}', day) AS DATE)"
    share = lambda part, whole: f"round(100.0e0 * count(*) FILTER ({part}) / {whole}, 4)"
    return f"""
        SELECT {at} AS day, 'citation_coverage_pct' AS metric, {share("cited", "count(*)")} AS value FROM told GROUP BY 1
        UNION ALL SELECT {at}, 'guardrail_trigger_pct', {share("applied_rules <> ''", "count(*)")} FROM told GROUP BY 1
        UNION ALL SELECT {at}, 'binding_block_pct', {share("contains(applied_rules, 'binding_opinion')", "count(*)")} FROM told GROUP BY 1
        UNION ALL SELECT {at}, 'satisfaction_pct', {share("rating = 1", "count(*)")} FROM (SELECT CAST(created_at AS DATE) AS day, rating FROM feedback) GROUP BY 1
        UNION ALL SELECT {at}, 'vector_hit_pct', {share("hit", "count(*)")} FROM looked GROUP BY 1
        UNION ALL SELECT {at}, 'response_p95_s', list_sort(list(ms))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] / 1000.0e0 FROM waited GROUP BY 1"""


def _stored_days(spark, sf):
    part = lambda i: F.split_part("answer_id", F.lit("-"), F.lit(i)).cast("long")
    at = F.timestamp_micros(F.lit(1704067200000000) + part(1) * 3600000000 + part(2) * 60000000)
    guarded = guardrails.apply_guardrails(table(spark, sf, "answers")).select(at.alias("at"), F.col("guarded.applied_rules").alias("applied_rules"))
    told = guarded.withColumn("cited", ~F.exists("applied_rules", lambda r: r.contains("CITATION REMINDER")))
    events = table(spark, sf, "events").select(F.col("ts").alias("at"), "event_type", "value")
    ratings = table(spark, sf, "feedback").select(F.col("created_at").alias("at"), "rating")
    searches = events.where("event_type = 'view'").select("at", (F.col("value") >= 20).alias("hit"))
    waits = events.where("event_type IN ('view', 'click')").select("at", (F.col("value") / 10).alias("elapsed"))
    return materialize(operations.daily_counts(told, ratings, searches), "daily-counts"), materialize(operations.daily_times(waits), "daily-times")


@query("e09_daily_series", with_models(_period("day"), "answers", "feedback", extra=_SERIES))
def e09_daily(spark, sf):
    return operations.series(*_stored_days(spark, sf))


@query("e09_weekly_series", with_models(_period("week"), "answers", "feedback", extra=_SERIES))
def e09_weekly(spark, sf):
    # Weeks come from the stored days alone.
    counts, times = _stored_days(spark, sf)
    return operations.series(operations.rolled_up(counts, "week"), operations.rolled_up(times, "week", ["ms"]))
