"""Queries over table maintenance and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.operators import access, tables
from haulmark.plans.models import table, with_models
from haulmark.plans.registry import query
from haulmark.sources import files, schemas
from haulmark.sources.sizing import fresh_path

# The older snapshot holds the documents that are already labelled; of those, the toxic
# ones have another text in it.  The newer snapshot is the whole document table.
_OLD = """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN concat(d.text, ' (old)') ELSE d.text END AS body, d.lang
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
_NEW = "SELECT doc_id, text AS body, lang FROM documents"
_BOTH = {
    "old_docs": f"SELECT *, sha256(body) AS content_hash FROM ({_OLD})",
    "new_docs": f"SELECT *, sha256(body) AS content_hash FROM ({_NEW})",
}


def _old(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    body = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    old = d.join(l, "doc_id").select("doc_id", body.alias("body"), "lang")
    return old.withColumn("content_hash", F.sha2("body", 256))


def _new(spark, sf):
    new = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"), "lang")
    return new.withColumn("content_hash", F.sha2("body", 256))


_LABELLED = "SELECT d.doc_id, d.text AS body, d.lang, sha256(d.text) AS content_hash FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@query(
    "s06_upsert_changed",
    with_models(
        """SELECT n.doc_id, n.body, n.lang, n.content_hash FROM new_docs n LEFT JOIN old_docs o ON n.doc_id = o.doc_id
             WHERE o.doc_id IS NULL OR o.content_hash <> n.content_hash
           UNION ALL
           SELECT o.doc_id, o.body, o.lang, o.content_hash FROM old_docs o LEFT JOIN new_docs n ON n.doc_id = o.doc_id
             WHERE n.doc_id IS NULL OR NOT o.content_hash <> n.content_hash""",
        extra=_BOTH,
    ),
)
def s06(spark, sf):
    return tables.upsert(_old(spark, sf), _new(spark, sf), "doc_id", "content_hash")


@query(
    "s07_insert_new",
    with_models("SELECT * FROM new_docs WHERE doc_id NOT IN (SELECT doc_id FROM old_docs)", extra=_BOTH),
)
def s07(spark, sf):
    return tables.insert_new(_old(spark, sf), _new(spark, sf), "doc_id")


# Messages of the conversations that open with a system turn are delivered again, shortened.
_REDELIVERED = """SELECT session_id, role, left(content, 20) AS content FROM sessions
    WHERE session_id IN (SELECT session_id FROM sessions WHERE role = 'system')"""


@query(
    "s08_replace_groups",
    with_models(
        f"""SELECT session_id, role, content FROM sessions WHERE session_id NOT IN (SELECT session_id FROM redelivered)
            UNION ALL SELECT * FROM redelivered""",
        "sessions",
        extra={"redelivered": _REDELIVERED},
    ),
)
def s08(spark, sf):
    messages = table(spark, sf, "sessions").select("session_id", "role", "content")
    opened = messages.where("role = 'system'").select("session_id").distinct()
    again = messages.join(opened, "session_id", "left_semi").withColumn("content", F.left("content", F.lit(20)))
    return tables.replace_groups(messages, again.select(*messages.columns), "session_id")


@query(
    "s09_append_evolving",
    """SELECT doc_id, quality, CAST(NULL AS BIGINT) AS n_chars FROM labels
       UNION ALL SELECT doc_id, NULL AS quality, n_chars FROM documents""",
)
def s09(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return tables.append_evolving(labels, table(spark, sf, "documents").select("doc_id", "n_chars"))


@query(
    "s12_delete_where",
    with_models("SELECT claim_id, loss_type FROM claims WHERE NOT (total_incurred > 50000 AND attorney_involved)", "claims"),
)
def s12(spark, sf):
    claims = table(spark, sf, "claims")
    gone = (F.col("total_incurred") > 50000) & F.col("attorney_involved")
    return tables.delete_where(claims, gone).select("claim_id", "loss_type")


@query(
    "s12_update_keys",
    with_models(
        """SELECT feedback_id, promoted_to_eval OR feedback_id IN (SELECT feedback_id FROM feedback WHERE comment IS NOT NULL) AS promoted_to_eval
           FROM feedback""",
        "feedback",
    ),
)
def s12_update(spark, sf):
    feedback = table(spark, sf, "feedback")
    listed = feedback.where(F.col("comment").isNotNull())
    done = tables.update_keys(feedback, listed, "feedback_id", {"promoted_to_eval": F.lit(True)})
    return done.select("feedback_id", "promoted_to_eval")


@query(
    "s13_unique_violations",
    with_models(
        "SELECT claim_id, count(*) AS n_rows FROM claims GROUP BY claim_id HAVING count(*) > 1 UNION ALL "
        "SELECT content_hash, count(*) FROM (SELECT sha256(text) AS content_hash FROM documents) GROUP BY content_hash HAVING count(*) > 1",
        "claims",
    ),
)
def s13_unique(spark, sf):
    claims = tables.unique_violations(table(spark, sf, "claims"), ["claim_id"])
    copies = table(spark, sf, "documents").select(F.sha2("text", 256).alias("claim_id"))
    return claims.unionByName(tables.unique_violations(copies, ["claim_id"]))


@query(
    "s13_null_counts",
    with_models(
        """SELECT 'submission_id' AS column_name, count(*) FILTER (WHERE submission_id IS NULL) AS n_nulls FROM submissions
           UNION ALL SELECT 'insured_id', count(*) FILTER (WHERE insured_id IS NULL) FROM submissions
           UNION ALL SELECT 'loss_ratio_3yr', count(*) FILTER (WHERE loss_ratio_3yr IS NULL) FROM submissions""",
        "submissions",
    ),
)
def s13_nulls(spark, sf):
    return tables.null_counts(table(spark, sf, "submissions"), ["submission_id", "insured_id", "loss_ratio_3yr"])


@query(
    "s13_orphans",
    with_models(
        """SELECT count(*) AS n_rows, count(DISTINCT policy_id) AS n_keys FROM claims
           WHERE policy_id NOT IN (SELECT policy_id FROM policies WHERE policy_status = 'Active')""",
        "claims",
        "policies",
    ),
)
def s13_orphans(spark, sf):
    active = table(spark, sf, "policies").where("policy_status = 'Active'")
    return tables.orphan_counts(table(spark, sf, "claims"), active, "policy_id")


@query(
    "s14_change_feed",
    with_models(
        """SELECT COALESCE(o.doc_id, n.doc_id) AS doc_id,
                  CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change
           FROM old_docs o FULL OUTER JOIN new_docs n ON o.doc_id = n.doc_id
           WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.body <> n.body OR o.lang <> n.lang""",
        extra=_BOTH,
    ),
)
def s14(spark, sf):
    return tables.snapshot_changes(_old(spark, sf), _new(spark, sf), "doc_id")


_COUNTED = ["insureds", "policies", "drivers", "vehicles", "claims", "submissions", "loss_runs", "referrals"]


@query(
    "s15_row_counts",
    with_models(
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _COUNTED), *_COUNTED
    ),
)
def s15(spark, sf):
    return tables.row_counts({n: table(spark, sf, n) for n in _COUNTED})


@query("s17_inline_rows", with_models("SELECT question_id, keywords FROM eval_questions WHERE keywords <> ''", "eval_questions"))
def s17(spark, sf):
    rows = spark.createDataFrame([("en", "the|OF"), ("de", "der")], "lang string, keywords string")
    questions = table(spark, sf, "eval_questions").select("question_id", "doc_key")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"), "lang")
    both = questions.join(docs, "doc_key").join(F.broadcast(rows), "lang", "left")
    return both.select("question_id", F.coalesce("keywords", F.lit("la")).alias("keywords"))


@query(
    "s18_purge_sessions",
    """SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL '90' DAY""",
)
def s18(spark, sf):
    events = table(spark, sf, "events")
    kept = tables.purge_before(events, "ts", F.lit("2024-04-10 00:00:00").cast("timestamp_ntz"), 90)
    return kept.select("event_id", F.to_date("ts").alias("day"))


@query(
    "u23_broker_rows",
    with_models(
        """SELECT concat('user ', right(broker_name, 1)) AS user_id, broker_name, submission_id, submission_status FROM submissions""",
        "submissions",
    ),
)
def u23(spark, sf):
    submissions = table(spark, sf, "submissions").select("broker_name", "submission_id", "submission_status")
    entitled = submissions.select(
        F.concat(F.lit("user "), F.right("broker_name", F.lit(1))).alias("user_id"), "broker_name"
    ).distinct()
    return access.entitled_rows(submissions, entitled)


@query(
    "u23_rows_of_user",
    with_models(
        """SELECT broker_name, submission_id, submission_status FROM submissions WHERE right(broker_name, 1) = '7'""",
        "submissions",
    ),
)
def u23_one(spark, sf):
    submissions = table(spark, sf, "submissions").select("broker_name", "submission_id", "submission_status")
    user = F.concat(F.lit("user "), F.right("broker_name", F.lit(1))).alias("user_id")
    return access.rows_of_user(submissions, submissions.select(user, "broker_name").distinct(), "user 7")


@query(
    "s10_overwrite_partitions",
    """SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'en'
       UNION ALL SELECT doc_id, lang, n_chars + 1 FROM documents WHERE lang = 'en'""",
)
def s10(spark, sf):
    # The whole table is stored by language, then one language is replaced.
    path = fresh_path(spark, "by-language")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    files.overwrite(docs, path, ["lang"])
    files.overwrite(docs.where("lang = 'en'").withColumn("n_chars", F.col("n_chars") + 1), path, ["lang"])
    return spark.read.parquet(path).select("doc_id", "lang", "n_chars")


@query(
    "s11_append_turns",
    with_models("SELECT session_id, role, content, user_id FROM sessions", "sessions"),
)
def s11(spark, sf):
    # Turns are appended as one frame per role, never row by row.
    path = fresh_path(spark, "turns")
    turns = table(spark, sf, "sessions")
    for role in ("user", "assistant", "system"):
        files.append(turns.where(F.col("role") == role), path)
    return spark.read.schema(schemas.CONVERSATIONS).parquet(path).drop("created_at")
