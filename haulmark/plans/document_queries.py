"""Queries over documents, chunks, texts and guardrails."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions import text as tx
from haulmark.operators import chunking, documents, guardrails, tables
from haulmark.plans import check_sql as cs
from haulmark.plans.models import table, with_models
from haulmark.plans.registry import query
from haulmark.sources.sizing import materialize


# ---- documents ---------------------------------------------------------------

_URL_PATH = "regexp_replace(url, '[?#].*$', '')"


@query(
    "s03_path_metadata",
    f"""SELECT page_id, sha256(path) AS doc_id, parts[-1] AS file_name, parts[-2] AS category_id, parts[-2] AS category
        FROM (SELECT page_id, {_URL_PATH} AS path, string_split({_URL_PATH}, '/') AS parts FROM pages)""",
)
def s03(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.expr(_URL_PATH).alias("path"))
    return documents.path_metadata(pages).drop("path")


@query(
    "s04_category_labels",
    with_models("SELECT doc_id, category_id, category FROM parsed_documents", "parsed_documents"),
)
def s04(spark, sf):
    docs = table(spark, sf, "parsed_documents")
    return docs.select("doc_id", "category_id", documents.category_label(F.col("category_id")).alias("category"))


@query(
    "s05_flatten_elements",
    "SELECT doc_id, text AS parsed_text, length(string_split(text, chr(10))) AS page_count FROM documents",
)
def s05(spark, sf):
    lines = F.split("text", "\n", -1)
    parsed = F.to_json(
        F.struct(
            F.struct(
                F.transform(lines, lambda l: F.struct(l.alias("content"))).alias("elements"),
                F.transform(lines, lambda l, i: F.struct(i.alias("id"))).alias("pages"),
            ).alias("document")
        )
    )
    return documents.flatten_elements(table(spark, sf, "documents").select("doc_id", parsed.alias("parsed")))


@query(
    "s03_content_hash",
    with_models("SELECT doc_id, sha256(parsed_text) AS content_hash FROM parsed_documents", "parsed_documents"),
)
def s03_hash(spark, sf):
    return documents.with_content_hash(table(spark, sf, "parsed_documents")).select("doc_id", "content_hash")


# ---- chunks ------------------------------------------------------------------


@query(
    "t01_section_headers",
    with_models(
        f"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {cs.is_header('bare')}) AS n_headers
            FROM (SELECT doc_id, {cs.strip('line')} AS bare FROM doc_lines) GROUP BY doc_id""",
        "parsed_documents",
        extra=cs.SECTIONS,
    ),
)
def t01(spark, sf):
    docs = table(spark, sf, "parsed_documents").where(tx.has_text(F.col("parsed_text")))
    lines = docs.select("doc_id", F.explode(F.split("parsed_text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(tx.is_section_header(F.col("line"))).alias("n_headers")
    )


@query(
    "t02_section_split",
    with_models("SELECT doc_id, section_no, section_text FROM doc_sections", "parsed_documents", extra=cs.SECTIONS),
)
def t02(spark, sf):
    docs = table(spark, sf, "parsed_documents").select("doc_id", "parsed_text")
    return chunking.split_sections(docs).select("doc_id", "section_no", "section_text")


@query(
    "t03_sliding_windows",
    f"""SELECT doc_id, unnest(w) AS piece, generate_subscripts(w, 1) - 1 AS window_no
        FROM (SELECT doc_id, {cs.windows('text', 600, 100)} AS w FROM documents)""",
)
def t03(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", F.posexplode_outer(tx.slide(F.col("text"), fv.CHILD_SIZE, fv.OVERLAP)).alias("window_no", "piece")
    )


def chunks(spark, sf):
    return chunking.chunk_documents(table(spark, sf, "parsed_documents"))


_CHUNK = "chunk_id, chunk_text, doc_id, category, source_path, char_start, char_end"


@query(
    "t04_parent_chunks",
    with_models(f"SELECT {_CHUNK} FROM chunks WHERE chunk_type = 'parent'", "parsed_documents", extra=cs.CHUNKS),
)
def t04(spark, sf):
    return chunks(spark, sf).where("chunk_type = 'parent'").drop("chunk_type", "parent_id", "true_start")


@query(
    "t05_child_chunks",
    with_models(f"SELECT parent_id, {_CHUNK} FROM chunks WHERE chunk_type = 'child'", "parsed_documents", extra=cs.CHUNKS),
)
def t05(spark, sf):
    return chunks(spark, sf).where("chunk_type = 'child'").drop("chunk_type", "true_start")


@query(
    "t06_chunk_documents",
    with_models(f"SELECT parent_id, chunk_type, {_CHUNK} FROM chunks", "parsed_documents", extra=cs.CHUNKS),
)
def t06(spark, sf):
    return chunks(spark, sf).drop("true_start")


@query(
    "t07_chunk_statistics",
    with_models(
        """SELECT chunk_type, category, count(*) AS n_chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS n_chars,
                  avg(length(chunk_text)) AS avg_chars FROM chunks GROUP BY chunk_type, category""",
        "parsed_documents",
        extra=cs.CHUNKS,
    ),
)
def t07(spark, sf):
    return chunking.chunk_statistics(chunks(spark, sf))


@query(
    "t07_document_statistics",
    with_models(
        """SELECT category, count(*) AS n_documents, avg(length(parsed_text)) AS avg_chars,
                  count(*) FILTER (WHERE parsed_text IS NULL OR parsed_text = '') AS n_empty
           FROM parsed_documents GROUP BY category""",
        "parsed_documents",
    ),
)
def t07_documents(spark, sf):
    return chunking.document_statistics(table(spark, sf, "parsed_documents"))


# ---- texts -------------------------------------------------------------------


@query("t08_intent", with_models(f"SELECT query_id, {cs.intent('question')} AS intent FROM questions", "questions"))
def t08(spark, sf):
    return table(spark, sf, "questions").select("query_id", tx.detect_intent(F.col("question")).alias("intent"))


@query(
    "t09_reference_ids",
    with_models(
        f"""SELECT DISTINCT d.doc_id, r.ref, i.company_name, i.risk_tier
            FROM (SELECT doc_id, upper(unnest(regexp_extract_all(parsed_text, {cs.text(fv.REFERENCE_ID)}))) AS ref FROM parsed_documents) r
            JOIN parsed_documents d ON d.doc_id = r.doc_id LEFT JOIN insureds i ON i.insured_id = r.ref""",
        "parsed_documents",
        "insureds",
    ),
)
def t09(spark, sf):
    refs = (
        table(spark, sf, "parsed_documents")
        .select("doc_id", F.explode(tx.reference_ids(F.col("parsed_text"))).alias("ref"))
        .select("doc_id", F.upper("ref").alias("ref"))
        .distinct()
    )
    insureds = table(spark, sf, "insureds").select(F.col("insured_id").alias("ref"), "company_name", "risk_tier")
    return refs.join(insureds, "ref", "left")


def _display_name_sql() -> str:
    arms = " ".join(
        f"WHEN strpos(lower(stem), '{s}') > 1 THEN substring(stem, 1, strpos(lower(stem), '{s}') - 1)"
        for s in fv.FILE_STEM_SUFFIXES
    )
    words = f"string_split(lower(replace(replace(CASE {arms} ELSE stem END, '_', ' '), '-', ' ')), ' ')"
    title = f"array_to_string([upper(w[1:1]) || w[2:] FOR w IN {words}], ' ')"
    return with_models(f"SELECT doc_id, trim({title}) AS display_name FROM doc_files", "doc_files")


@query("t10_display_names", _display_name_sql())
def t10(spark, sf):
    return table(spark, sf, "doc_files").select("doc_id", tx.display_name(F.col("stem")).alias("display_name"))


_FENCED = (
    f"CASE WHEN starts_with({cs.strip('statement')}, '```') THEN CASE WHEN contains({cs.strip('statement')}, chr(10)) "
    f"THEN substring({cs.strip('statement')}, strpos({cs.strip('statement')}, chr(10)) + 1) "
    f"ELSE substring({cs.strip('statement')}, 4) END ELSE {cs.strip('statement')} END"
)
_UNFENCED = (
    f"SELECT statement_id, {cs.strip('CASE WHEN ends_with(o, ' + chr(39) + '```' + chr(39) + ') THEN left(o, length(o) - 3) ELSE o END')} AS sql_text "
    f"FROM (SELECT statement_id, {_FENCED} AS o FROM statements)"
)


@query("t12_strip_fences", with_models(_UNFENCED, "statements"))
def t12(spark, sf):
    return table(spark, sf, "statements").select("statement_id", tx.strip_fences(F.col("statement")).alias("sql_text"))


@query(
    "t11_sql_audit",
    with_models(
        "SELECT verdict, count(*) AS n_statements FROM (SELECT CASE WHEN sql_text = '' OR starts_with(sql_text, '--') THEN 'NO_ANSWER' "
        + " ".join(rf"WHEN regexp_matches(upper(sql_text), '\b{w}\b') THEN 'BLOCKED_{w}'" for w in fv.BLOCKED_STATEMENTS)
        + " WHEN NOT starts_with(upper(sql_text), 'SELECT') THEN 'NOT_SELECT' ELSE 'ALLOWED' END AS verdict FROM unfenced) GROUP BY verdict",
        "statements",
        extra={"unfenced": _UNFENCED},
    ),
)
def t11(spark, sf):
    verdict = tx.sql_verdict(tx.strip_fences(F.col("statement"))).alias("verdict")
    return table(spark, sf, "statements").select(verdict).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_statements"))


# ---- guardrails --------------------------------------------------------------


def guarded(spark, sf):
    return guardrails.apply_guardrails(table(spark, sf, "answers"))


def _guarded_sql(body: str) -> str:
    return with_models(body, "answers", extra=cs.guardrails())


@query("g01_guardrail_rules", _guarded_sql("SELECT answer_id, answer, blocked, redacted_items, applied_rules, action FROM guarded"))
def g01(spark, sf):
    return guarded(spark, sf).select("answer_id", "guarded.*")


@query("g02_blocked_answers", _guarded_sql("SELECT answer_id, answer, applied_rules FROM guarded WHERE blocked"))
def g02(spark, sf):
    return guarded(spark, sf).where("guarded.blocked").select("answer_id", "guarded.answer", "guarded.applied_rules")


@query(
    "g03_redactions",
    _guarded_sql(
        """SELECT item, count(*) AS n_answers FROM (SELECT unnest(string_split(redacted_items, '|')) AS item FROM guarded WHERE redacted_items <> '')
           GROUP BY item"""
    ),
)
def g03(spark, sf):
    items = guarded(spark, sf).select(F.explode("guarded.redacted_items").alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n_answers"))


@query(
    "g04_disclaimers",
    _guarded_sql("SELECT answer_id, answer FROM guarded WHERE contains(applied_rules, 'APPENDED by coverage_disclaimer')"),
)
def g04(spark, sf):
    fired = F.array_contains("guarded.applied_rules", "APPENDED by coverage_disclaimer")
    return guarded(spark, sf).where(fired).select("answer_id", "guarded.answer")


@query(
    "g05_citation_reminders",
    _guarded_sql("SELECT answer_id, answer FROM guarded WHERE contains(applied_rules, 'CITATION REMINDER')"),
)
def g05(spark, sf):
    fired = F.array_contains("guarded.applied_rules", "CITATION REMINDER by citation_enforcer")
    return guarded(spark, sf).where(fired).select("answer_id", "guarded.answer")


@query("g06_actions", _guarded_sql("SELECT action, count(*) AS n_answers FROM guarded GROUP BY action"))
def g06(spark, sf):
    return guarded(spark, sf).groupBy(F.col("guarded.action").alias("action")).agg(F.count(F.lit(1)).alias("n_answers"))


@query(
    "g07_rule_metrics",
    _guarded_sql(
        """SELECT rule, count(*) AS n_fired, round(count(*) * 100.0 / (SELECT count(*) FROM guarded), 4) AS fired_pct
           FROM (SELECT regexp_extract(unnest(string_split(applied_rules, '|')), 'by (\\w+)', 1) AS rule FROM guarded WHERE applied_rules <> '')
           GROUP BY rule"""
    ),
)
def g07(spark, sf):
    return guardrails.rule_metrics(guarded(spark, sf))


@query(
    "g07_answer_metrics",
    _guarded_sql(
        """SELECT count(*) AS n_answers, round(count(*) FILTER (WHERE applied_rules <> '') * 100.0 / count(*), 4) AS trigger_pct,
                  round(count(*) FILTER (WHERE blocked) * 100.0 / count(*), 4) AS block_pct,
                  round(count(*) FILTER (WHERE NOT blocked AND NOT contains(applied_rules, 'CITATION')) * 100.0 / count(*), 4) AS citation_pct
           FROM guarded"""
    ),
)
def g07_answers(spark, sf):
    return guardrails.answer_metrics(guarded(spark, sf))


@query(
    "u22_pii_mask",
    with_models(
        r"""SELECT answer_id, r.role, CASE WHEN r.sees THEN answer ELSE regexp_replace(answer, '\b\d{3}-\d{2}-\d{4}\b', '[SSN REDACTED]', 'g') END AS answer
            FROM answers JOIN (VALUES ('claims_adjuster', TRUE), ('broker', FALSE)) AS r(role, sees) ON TRUE""",
        "answers",
    ),
)
def u22(spark, sf):
    answers = table(spark, sf, "answers")
    roles = F.explode(
        F.array(
            F.struct(F.lit("claims_adjuster").alias("role"), F.lit(True).alias("sees")),
            F.struct(F.lit("broker").alias("role"), F.lit(False).alias("sees")),
        )
    ).alias("_r")
    return answers.select("answer_id", "answer", roles).select(
        "answer_id", "_r.role", guardrails.mask_pii(F.col("answer"), F.col("_r.sees")).alias("answer")
    )


@query(
    "u22_masked_drivers",
    with_models(
        """SELECT driver_id, CASE WHEN driver_status = 'Active' THEN date_of_birth END AS date_of_birth,
                  CASE WHEN driver_status = 'Active' THEN cdl_number ELSE regexp_replace(regexp_replace(cdl_number, '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') END AS cdl_number
           FROM drivers""",
        "drivers",
    ),
)
def u22_drivers(spark, sf):
    masked = guardrails.mask_driver(table(spark, sf, "drivers"), F.col("driver_status") == "Active")
    return masked.select("driver_id", "date_of_birth", "cdl_number")


# Labelled documents are indexed already; the toxic ones among them have another text now.
@query(
    "r01_incremental_sync",
    with_models("SELECT parent_id, chunk_type, chunk_id, chunk_text, doc_id, category, source_path, char_start, char_end FROM chunks", "parsed_documents", extra=cs.CHUNKS),
)
def r01_sync(spark, sf):
    docs = table(spark, sf, "parsed_documents").select("doc_id", "category", "source_path", "parsed_text")
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    before = docs.join(labels, "doc_id").withColumn(
        "parsed_text", F.when(F.col("toxic") == 1, F.concat("parsed_text", F.lit(" (old)"))).otherwise(F.col("parsed_text"))
    ).drop("toxic")
    stored = materialize(chunking.chunk_documents(before), "chunks")
    changes = tables.snapshot_changes(before, docs, "doc_id")
    return chunking.sync_chunks(stored, docs, changes).drop("true_start")
