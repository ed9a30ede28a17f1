"""Checks of responses against expectations, summaries, gates and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.ranking import nearest_rank
from haulmark.functions.text import strip


def check_responses(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Add ``checks`` (array of check, passed, detail) and ``passed`` to every response.

    Questions carry ``expected_keywords`` and ``should_not_contain`` arrays.
    """
    both = responses.join(questions, "question_id")
    size = F.length("response")
    lowered = F.lower("response")

    def check(name, passed, detail):
        return F.struct(name.alias("check"), passed.alias("passed"), detail.alias("detail"))

    failed = check(
        F.lit("endpoint_success"),
        F.lit(False),
        F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(": "), F.substring("response", 1, 100)),
    )
    full = F.length(strip(F.col("response"))) >= 10
    filled = check(
        F.lit("non_empty"),
        full,
        F.when(full, F.concat(size.cast("string"), F.lit(" chars"))).otherwise(
            F.concat(F.lit("Response too short ("), size.cast("string"), F.lit(" chars)"))
        ),
    )
    both = both.withColumn("_lower", lowered)
    words = F.transform(
        "expected_keywords",
        lambda k: check(
            F.concat(F.lit("has_keyword:"), k),
            F.col("_lower").contains(F.lower(k)),
            F.when(F.col("_lower").contains(F.lower(k)), F.lit("found")).otherwise(F.lit("MISSING")),
        ),
    )
    phrases = F.transform(
        "should_not_contain",
        lambda p: check(
            F.concat(F.lit("not_contains:"), p),
            ~F.col("_lower").contains(F.lower(p)),
            F.when(F.col("_lower").contains(F.lower(p)), F.lit("FOUND (bad)")).otherwise(F.lit("absent (good)")),
        ),
    )
    checks = F.when(F.col("success"), F.concat(F.array(filled), words, phrases)).otherwise(F.array(failed))
    return (
        both.withColumn("checks", checks)
        .withColumn("passed", F.forall("checks", lambda c: c["passed"]))
        .drop("_lower")
    )


def section_label(question_id: Column, category: Column, intent: Column) -> Column:
    return (
        F.when(intent == "sql", "sql")
        .when(category == "guardrail", "guardrail")
        .when(category.isin("out_of_scope", "edge", "mixed"), "edge")
        .when(question_id.startswith("RBAC"), "rbac")
        .otherwise("document")
    )


def failed_names(checks: Column) -> Column:
    return F.array_join(F.transform(F.filter(checks, lambda c: ~c["passed"]), lambda c: c["check"]), ", ")


def summarize(checked: DataFrame) -> DataFrame:
    """Pass rate and response times in total, by section and by difficulty."""
    section = section_label(F.col("question_id"), F.col("category"), F.col("intent"))
    cells = checked.select(
        "passed",
        "elapsed",
        F.explode(
            F.array(
                F.struct(F.lit("all").alias("breakdown"), F.lit("all").alias("label")),
                F.struct(F.lit("section").alias("breakdown"), section.alias("label")),
                F.struct(F.lit("difficulty").alias("breakdown"), F.coalesce("difficulty", F.lit("unknown")).alias("label")),
            )
        ).alias("_c"),
    ).select("passed", "elapsed", "_c.breakdown", "_c.label")
    keys = ["breakdown", "label"]
    timed = F.when(F.col("elapsed") > 0, F.col("elapsed"))
    n = F.count(F.lit(1))
    totals = cells.groupBy(*keys).agg(
        n.alias("n_questions"),
        F.count_if("passed").alias("n_passed"),
        F.round(F.count_if("passed") * 100 / n, 4).alias("pass_pct"),
        F.round(F.avg(timed), 4).alias("avg_s"),
        F.min(timed).alias("min_s"),
        F.max(timed).alias("max_s"),
    )
    p95 = nearest_rank(cells.where(F.col("elapsed") > 0), keys, "elapsed", 0.95, "p95_s")
    return totals.join(p95, keys, "left")


def run_rates(checked: DataFrame) -> DataFrame:
    """Pass rate and mean response time of every run."""
    n = F.count(F.lit(1))
    return checked.groupBy("run_id").agg(
        n.alias("total_questions"),
        F.count_if("passed").alias("n_passed"),
        F.round(F.avg("elapsed"), 4).alias("avg_response_s"),
        F.round(F.count_if("passed") * 100 / n, 1).alias("pass_rate_pct"),
    )


def run_history(checked: DataFrame, limit: int = 10) -> DataFrame:
    """Newest runs with their pass rate."""
    return run_rates(checked).orderBy(F.desc("run_id")).limit(limit)


def failures(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("passed")).select(
        "question_id",
        "question",
        "category",
        "intent",
        "role",
        "difficulty",
        F.substring("response", 1, 300).alias("response_preview"),
        failed_names(F.col("checks")).alias("failed_checks"),
    )


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """PASS or FAIL for every metric against its threshold row."""
    return metrics.join(thresholds, "metric").select(
        "metric",
        "value",
        "threshold",
        F.when(F.col("value") >= F.col("threshold"), "PASS").otherwise("FAIL").alias("verdict"),
    )


def select_run(questions: DataFrame, mode: str = "all", section: str = "", size: int = 20, seed: int = 0) -> DataFrame:
    """All questions, a seeded sample, or the questions of one section."""
    if mode == "sample":
        draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), "question_id"), 256)
        return questions.orderBy(draw, "question_id").limit(size)
    if mode == "section":
        wanted = section.lower()
        prefix = F.lower(F.split_part("question_id", F.lit("-"), F.lit(1)))
        return questions.where(
            (F.lower("category") == wanted) | (F.lower("intent") == wanted) | (prefix == wanted)
        )
    if mode != "all":
        raise ValueError("mode must be 'all', 'sample' or 'section'")
    return questions


def drift(runs: DataFrame, metric: str, baseline_run: str, tolerance_pct: float = fv.DRIFT_TOLERANCE_PCT) -> DataFrame:
    """Runs whose metric fell more than the tolerance below the baseline run."""
    base = runs.where(F.col("run_id") == baseline_run).agg(F.max(metric).alias("v")).scalar()
    change = F.round((F.col(metric) - base) * 100 / F.nullif(base, F.lit(0.0)), 4)
    return runs.select("run_id", metric, change.alias("change_pct")).withColumn(
        "alert", F.coalesce(F.col("change_pct") < -tolerance_pct, F.lit(False))
    )


def operation_alerts(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """OK, WARN (target missed) or ALERT (threshold crossed) for every metric row."""
    above = F.col("direction") == "above"
    crossed = F.when(above, F.col("value") > F.col("alert")).otherwise(F.col("value") < F.col("alert"))
    missed = F.when(above, F.col("value") > F.col("target")).otherwise(F.col("value") < F.col("target"))
    return metrics.join(targets, "metric").withColumn(
        "state", F.when(crossed, "ALERT").when(missed, "WARN").otherwise("OK")
    )
