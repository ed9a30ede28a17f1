"""Rules applied to a table of answers, compiled into column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.text import contains_any


def _topics(names: list[str]) -> list[str]:
    return [n.lower().replace("_", " ") for n in names]


def apply_guardrails(
    df: DataFrame, rules: list[dict] | None = None, answer: str = "answer"
) -> DataFrame:
    """Add ``guarded``: answer, blocked, applied_rules, redacted_items and action.

    Rules run in order of priority (99 when none is given, ties in list order).  Every rule
    is one projection that reads the text left by the rule before it.
    """
    rules = sorted(fv.GUARDRAIL_RULES if rules is None else rules, key=lambda r: r.get("priority", 99))
    keys = df.columns
    state = df.withColumns({"_text": F.col(answer), "_blocked": F.lit(False)})
    notes, redacted = [], []
    for i, rule in enumerate(rules):
        name, action, hit = rule.get("name", "unknown"), rule.get("action", "").upper(), f"_hit{i}"
        text, open_ = F.col("_text"), ~F.col("_blocked")
        if action == "BLOCK":
            needles = [p.lower() for p in rule.get("trigger_phrases", [])]
            needles += _topics(rule.get("prohibited_topics", []))
            state = state.withColumn(hit, open_ & contains_any(F.lower(text), needles))
            message = rule.get("blocked_message", "I cannot assist with that.")
            state = state.withColumns(
                {
                    "_text": F.when(F.col(hit), F.lit(message)).otherwise(text),
                    "_blocked": F.col("_blocked") | F.col(hit),
                }
            )
            notes.append(F.when(F.col(hit), F.lit(f"BLOCKED by {name}")))
        elif action == "REDACT":
            found = []
            for j, pattern in enumerate(rule.get("patterns", [])):
                flag = f"{hit}_{j}"
                regex = pattern.get("regex", "")
                state = state.withColumn(flag, open_ & text.rlike(regex))
                state = state.withColumn(
                    "_text",
                    F.when(
                        F.col(flag),
                        F.regexp_replace("_text", regex, pattern.get("replacement", "[REDACTED]")),
                    ).otherwise(F.col("_text")),
                )
                found.append(F.when(F.col(flag), F.lit(pattern.get("name", "PII"))))
            if found:
                items = F.array_compact(F.array(*found))
                redacted.append(items)
                listed = F.concat(
                    F.lit(f"REDACTED by {name}: ['"), F.array_join(items, "', '"), F.lit("']")
                )
                notes.append(F.when(F.size(items) > 0, listed))
        elif action == "APPEND":
            topics = _topics(rule.get("trigger_topics", []))
            wanted = contains_any(F.lower(text), topics) if topics else F.lit(True)
            disclaimer = rule.get("disclaimer", "").strip()
            fire = open_ & wanted & ~text.contains(disclaimer) if disclaimer else F.lit(False)
            state = state.withColumn(hit, fire)
            state = state.withColumn(
                "_text",
                F.when(F.col(hit), F.concat("_text", F.lit("\n\n" + disclaimer))).otherwise(F.col("_text")),
            )
            notes.append(F.when(F.col(hit), F.lit(f"APPENDED by {name}")))
        elif action == "APPEND_IF_NO_CITATION":
            reminder = rule.get("reminder", "").strip()
            cited = F.lit(False)
            for regex in fv.CITATION_PATTERNS:
                cited = cited | text.rlike(regex)
            state = state.withColumn(hit, open_ & ~cited if reminder else F.lit(False))
            state = state.withColumn(
                "_text",
                F.when(F.col(hit), F.concat("_text", F.lit("\n\n" + reminder))).otherwise(F.col("_text")),
            )
            notes.append(F.when(F.col(hit), F.lit(f"CITATION REMINDER by {name}")))
    no_strings = F.array().cast("array<string>")
    applied = F.array_compact(F.array(*notes)) if notes else no_strings
    items = F.concat(*redacted) if redacted else no_strings
    result = state.select(
        *keys,
        F.col("_text").alias("_answer"),
        "_blocked",
        applied.alias("_applied"),
        items.alias("_items"),
    )
    action = (
        F.when(F.col("_blocked"), "BLOCK")
        .when(F.size("_items") > 0, "REDACT")
        .when(F.size("_applied") > 0, "APPEND")
        .otherwise("PASS")
    )
    outcome = F.struct(
        F.col("_answer").alias("answer"),
        F.col("_blocked").alias("blocked"),
        F.col("_applied").alias("applied_rules"),
        F.col("_items").alias("redacted_items"),
        action.alias("action"),
    )
    # A filter on the outcome must not be pushed through the stages: every stage reads its
    # text several times, so the pushed condition would grow with the power of the stages.
    # The optimizer does not push filters on generated columns below the generator.
    return result.select(*keys, F.explode_outer(F.array(outcome)).alias("guarded"))


def rule_metrics(guarded: DataFrame) -> DataFrame:
    """How often every rule fired, and its share of all answers."""
    total = guarded.agg(F.count(F.lit(1)).alias("n"))
    fired = guarded.select(F.explode("guarded.applied_rules").alias("note")).select(
        F.regexp_extract("note", r"by (\w+)", 1).alias("rule")
    )
    return (
        fired.groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n_fired"))
        .withColumn("fired_pct", F.round(F.col("n_fired") * 100 / total.scalar(), 4))
    )


def answer_metrics(guarded: DataFrame) -> DataFrame:
    """Trigger, block and citation rates over all answers."""
    applied = F.col("guarded.applied_rules")
    reminded = F.exists(applied, lambda r: r.startswith("CITATION REMINDER"))
    n = F.count(F.lit(1))
    rate = lambda c: F.round(F.count_if(c) * 100 / F.nullif(n, F.lit(0)), 4)
    return guarded.agg(
        n.alias("n_answers"),
        rate(F.size(applied) > 0).alias("trigger_pct"),
        rate(F.col("guarded.blocked")).alias("block_pct"),
        rate(~F.col("guarded.blocked") & ~reminded).alias("citation_pct"),
    )


def mask_driver(drivers: DataFrame, role_has_access: Column) -> DataFrame:
    """Driver rows with birth date and licence number hidden from roles without access."""
    return drivers.withColumns(
        {
            "date_of_birth": F.when(role_has_access, F.col("date_of_birth")),
            "cdl_number": F.when(role_has_access, F.col("cdl_number")).otherwise(F.mask("cdl_number")),
        }
    )


def mask_pii(text: Column, role_has_access: Column) -> Column:
    """Text as a role without PII access sees it."""
    ssn = fv.GUARDRAIL_RULES[2]["patterns"][0]
    return F.when(role_has_access, text).otherwise(
        F.regexp_replace(text, ssn["regex"], ssn["replacement"])
    )
