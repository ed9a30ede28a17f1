"""Queries over keyword, vector and fused retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions import text as tx
from haulmark.operators import access, chunking, postings, retrieval, search, tables, vector_index, vectors
from haulmark.plans import check_sql as cs
from haulmark.plans.document_queries import chunks
from haulmark.plans.models import table, with_models
from haulmark.plans.registry import query
from haulmark.sources.sizing import materialize

N = fv.SEARCH_RESULTS


def _stored_chunks(spark, sf):
    """The chunk table as a search finds it: written once, then read by every step."""
    return materialize(chunks(spark, sf).drop("true_start"), "chunks")


def _max_hits(spark, sf, n=N):
    return table(spark, sf, "questions").count() * n


def child_index(spark, sf, by_role=False, stored=None):
    """Keyword index of all child chunks."""
    source = _stored_chunks(spark, sf) if stored is None else stored
    corpus = source.where("chunk_type = 'child'").select("chunk_id", "chunk_text", "category")
    return postings.build(corpus, category="category" if by_role else None)


def _child_hits(spark, sf, n=N, by_role=False, stored=None):
    index = child_index(spark, sf, by_role, stored)
    asked = table(spark, sf, "questions")
    if by_role:
        asked = access.with_allowed(asked, access.role_policy(spark))
    return postings.search(index, asked, n, allowed="allowed" if by_role else None)


_CHILD_RANK = {**cs.CHUNKS, **cs.ROLE_POLICY, **cs.bm25("child_corpus", "questions", N)}
_ROLE_RANK = {**cs.CHUNKS, **cs.ROLE_POLICY, **cs.bm25("child_corpus", "questions", N, allowed=True)}


def _sql(body: str, ctes: dict[str, str], *models: str) -> str:
    return with_models(body, "parsed_documents", "questions", *models, extra=ctes)


@query(
    "r01_index_terms",
    with_models(
        """SELECT term, count(*) AS n_chunks, CAST(sum(tf) AS BIGINT) AS n_uses, max(tf) AS max_tf
           FROM (SELECT ckey, term, count(*) AS tf FROM (SELECT ckey, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_-]+')) AS term FROM child_corpus) GROUP BY ckey, term)
           GROUP BY term""",
        "parsed_documents",
        extra=cs.CHUNKS,
    ),
)
def r01(spark, sf):
    index = search.build_index(chunks(spark, sf).where("chunk_type = 'child'"))
    return search.postings(index).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("n_uses"), F.max("tf").alias("max_tf")
    )


def _old_and_new_chunks(spark, sf):
    """Chunks before and after a change of documents: some new, some changed, some deleted."""
    docs = table(spark, sf, "parsed_documents").select("doc_id", "category", "source_path", "parsed_text")
    number = F.col("doc_id").cast("long") % 10
    before = docs.where(number != 0).withColumn("parsed_text", F.when(number == 7, F.concat("parsed_text", F.lit(" was another"))).otherwise(F.col("parsed_text")))
    gone = docs.where(number == 3).withColumn("doc_id", F.concat(F.lit("old-"), "doc_id"))
    child = lambda df: chunking.chunk_documents(df).where("chunk_type = 'child'").select("chunk_id", "chunk_text", "category")
    return materialize(child(before.unionByName(gone)), "chunks"), materialize(child(docs), "chunks")


def _refreshed(spark, sf):
    old, new = _old_and_new_chunks(spark, sf)
    index = postings.build(old, category="category")
    changes = materialize(tables.snapshot_changes(old, new, "chunk_id"), "changes")
    removed = old.join(changes.where("change <> 'insert'"), "chunk_id", "left_semi")
    added = new.join(changes.where("change <> 'delete'"), "chunk_id", "left_semi")
    return postings.refresh(index, removed, added, category="category")


@query(
    "r01_refreshed_index",
    with_models(
        """SELECT term, count(*) AS df, count(*) AS n_chunks, CAST(sum(tf) AS BIGINT) AS n_uses, (SELECT count(*) FROM child_corpus) AS index_chunks
           FROM (SELECT ckey, term, count(*) AS tf FROM (SELECT ckey, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_-]+')) AS term FROM child_corpus) GROUP BY ckey, term)
           GROUP BY term""",
        "parsed_documents",
        extra=cs.CHUNKS,
    ),
)
def r01_refreshed(spark, sf):
    index = _refreshed(spark, sf)
    used = postings.live_postings(index).groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("n_uses"))
    return postings.frequencies(index).join(used, "term", "full_outer").withColumn("index_chunks", F.lit(postings.sizes(index)[0]))


@query("r02_refreshed_search", _sql("SELECT query_id, ckey AS chunk_id, score, rank FROM ranked", _ROLE_RANK))
def r02_refreshed(spark, sf):
    asked = access.with_allowed(table(spark, sf, "questions"), access.role_policy(spark))
    return postings.search(_refreshed(spark, sf), asked, N, allowed="allowed")


@query("r02_bm25_topk", _sql("SELECT query_id, ckey AS chunk_id, score, rank FROM ranked", _CHILD_RANK))
def r02(spark, sf):
    return _child_hits(spark, sf)


@query("r05_role_filtered_search", _sql("SELECT query_id, ckey AS chunk_id, score, rank FROM ranked", _ROLE_RANK))
def r05(spark, sf):
    return _child_hits(spark, sf, by_role=True)


# ---- vectors -----------------------------------------------------------------
# The vector with the id of a question stands for the question, the vector with the id of a
# document for the document.

_VECTORS = {
    "qv": "SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id",
    "vscore": """SELECT q.query_id, e.vec_id, round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 4) AS score
        FROM qv q CROSS JOIN embeddings e""",
    "vranked": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vscore) WHERE rank <= {N}""",
}


def _query_vectors(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items.join(vecs, "query_id")


def _vector_hits(spark, sf, n=N, asked=None):
    wanted = _query_vectors(spark, sf)
    if asked is not None:
        wanted = wanted.join(asked.select("query_id"), "query_id", "left_semi")
    return vectors.cosine_top_n(wanted, table(spark, sf, "embeddings"), n)


@query("r03_vector_topk", with_models("SELECT query_id, vec_id, score, rank FROM vranked", extra=_VECTORS))
def r03(spark, sf):
    return _vector_hits(spark, sf)


@query("r03_vector_index", with_models("SELECT query_id, vec_id, score, rank FROM vranked", extra=_VECTORS))
def r03_index(spark, sf):
    # As many probes as cells give the exact result.
    index = vector_index.build(table(spark, sf, "embeddings"))
    return vector_index.search(index, _query_vectors(spark, sf), N, probes=index.cells)


_RECALL = 0.9


@query(
    "r03_index_recall",
    with_models("SELECT count(*) AS n_queries, TRUE AS enough FROM (SELECT DISTINCT query_id FROM vranked)", extra=_VECTORS),
)
def r03_recall(spark, sf):
    index = vector_index.build(table(spark, sf, "embeddings"))
    shares = vector_index.recall(vector_index.search(index, _query_vectors(spark, sf), N), _vector_hits(spark, sf), "vec_id")
    return shares.agg(F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= _RECALL).alias("enough"))


_DOC_RANK = {
    "doc_corpus": "SELECT doc_id AS ckey, text AS body, source AS category FROM documents",
    **cs.bm25("doc_corpus", "questions", N, "dranked"),
}
_HYBRID = {
    **_DOC_RANK,
    **_VECTORS,
    "votes": "SELECT query_id, ckey AS doc_id, 1.0e0 / (60 + rank) AS vote FROM dranked UNION ALL SELECT query_id, vec_id, 1.0e0 / (60 + rank) FROM vranked",
    "fscore": "SELECT query_id, doc_id, round(sum(vote), 6) AS score FROM votes GROUP BY query_id, doc_id",
    "fused": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fscore) WHERE rank <= {N}",
}


def _document_hits(spark, sf, n=N, asked=None):
    index = postings.build(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return postings.search(index, asked if asked is not None else table(spark, sf, "questions"), n)


def _fused(spark, sf, asked=None):
    near = _vector_hits(spark, sf).withColumnRenamed("vec_id", "doc_id")
    return search.fuse([_document_hits(spark, sf, asked=asked), near], "doc_id")


@query("r04_hybrid_fusion", with_models("SELECT query_id, doc_id, score, rank FROM fused", "questions", extra=_HYBRID))
def r04(spark, sf):
    return _fused(spark, sf)


@query(
    "r06_routed_search",
    with_models(
        f"""SELECT q.query_id, q.intent, f.doc_id, f.rank FROM routed q JOIN fused f ON f.query_id = q.query_id WHERE q.intent = 'hybrid'
            UNION ALL
            SELECT q.query_id, q.intent, d.ckey, d.rank FROM routed q JOIN dranked d ON d.query_id = q.query_id WHERE q.intent = 'keyword'""",
        "questions",
        extra={**_HYBRID, "routed": f"SELECT query_id, {cs.intent('question')} AS intent FROM questions"},
    ),
)
def r06(spark, sf):
    routed = table(spark, sf, "questions").withColumn("intent", tx.detect_intent(F.col("question")))
    intents = routed.select("query_id", "intent")
    # Questions for the structured path are dropped before anything is scored.
    searched = routed.where("intent <> 'sql'")
    words = _document_hits(spark, sf, asked=searched)
    hybrid = intents.where("intent = 'hybrid'")
    near = _vector_hits(spark, sf, asked=hybrid).withColumnRenamed("vec_id", "doc_id")
    fused = search.fuse([words.join(hybrid, "query_id", "left_semi"), near], "doc_id")
    keyword = words.join(intents.where("intent = 'keyword'"), "query_id", "left_semi")
    found = fused.select("query_id", "doc_id", "rank").unionByName(keyword.select("query_id", "doc_id", "rank"))
    return found.join(intents, "query_id")


# ---- context -----------------------------------------------------------------

_THRESHOLD = 12.0
_SELECTED = {
    **_CHILD_RANK,
    "best": "SELECT query_id, max(score) AS best FROM ranked GROUP BY query_id",
    "selected": f"""SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS source_no
        FROM ranked r JOIN best b ON b.query_id = r.query_id
        WHERE CASE WHEN best >= {_THRESHOLD} THEN score >= {_THRESHOLD} ELSE rank <= 3 END) WHERE source_no <= 6""",
}


def _selected(spark, sf, stored=None):
    return search.select_context(_child_hits(spark, sf, stored=stored), threshold=_THRESHOLD)


@query("r07_context_selection", _sql("SELECT query_id, ckey AS chunk_id, score, rank, source_no FROM selected", _SELECTED))
def r07(spark, sf):
    return _selected(spark, sf)


@query(
    "r08_context_text",
    _sql(
        """SELECT query_id, concat('## Retrieved Context', chr(10), chr(10), chr(10), string_agg(concat('### Source ', source_no, ': ',
                  string_split(source_path, '/')[-1], ' (', category, ')', chr(10), chunk_text), chr(10) || chr(10) ORDER BY source_no)) AS context
           FROM selected s JOIN chunks c ON c.chunk_id = s.ckey GROUP BY query_id""",
        _SELECTED,
    ),
)
def r08(spark, sf):
    stored = _stored_chunks(spark, sf)
    chosen = _selected(spark, sf, stored)
    return search.context_text(search.with_details(chosen, stored, _max_hits(spark, sf)))


# ---- one flow: role, route, search by words and vectors, context ----------------
# A chunk has the vector with the id of its document; chunks of a document share it.

_FLOW = {
    **_ROLE_RANK,
    "qv": _VECTORS["qv"],
    "sees": """SELECT q.query_id, q.question, c.category FROM questions q JOIN (SELECT DISTINCT category FROM chunks) c
        ON EXISTS (SELECT 1 FROM role_policy p WHERE p.role = q.role AND p.category IN ('all', c.category))""",
    "nscore": """SELECT q.query_id, c.chunk_id AS ckey, round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 4) AS score
        FROM qv q JOIN sees s ON s.query_id = q.query_id JOIN chunks c ON c.category = s.category AND c.chunk_type = 'child'
        JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = c.doc_id""",
    "nranked": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ckey) AS rank FROM nscore) WHERE rank <= {N}""",
    "routes": f"SELECT query_id, {cs.intent('question')} AS intent FROM questions",
    "nvotes": """SELECT v.query_id, ckey, round(sum(1.0e0 / (60 + rank)), 6) AS score FROM (SELECT query_id, ckey, rank FROM ranked UNION ALL SELECT query_id, ckey, rank FROM nranked) v
        JOIN routes r ON r.query_id = v.query_id AND r.intent = 'hybrid' GROUP BY v.query_id, ckey""",
    "flow": f"""
        SELECT query_id, 'hybrid' AS intent, ckey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ckey) AS rank FROM nvotes) WHERE rank <= {N}
        UNION ALL SELECT k.query_id, 'keyword', ckey, score, rank FROM ranked k JOIN routes r ON r.query_id = k.query_id AND r.intent = 'keyword'""",
}


def _flow(spark, sf, stored):
    child = stored.where("chunk_type = 'child'").select("chunk_id", "chunk_text", "category", "doc_id")
    words = postings.build(child, category="category")
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")
    near = vector_index.build(child.join(vecs, "doc_id"), "chunk_id", category="category")
    asked = retrieval.routed(table(spark, sf, "questions"), access.role_policy(spark))
    return retrieval.retrieve(asked, words, near, _query_vectors(spark, sf), N, probes=near.cells)


@query("r05_retrieval_flow", _sql("SELECT query_id, intent, ckey AS chunk_id, score, rank FROM flow", _FLOW))
def r05_flow(spark, sf):
    return _flow(spark, sf, _stored_chunks(spark, sf))


@query(
    "r05_role_vectors",
    _sql("SELECT query_id, ckey AS chunk_id, score, rank FROM nranked", _FLOW),
)
def r05_vectors(spark, sf):
    child = _stored_chunks(spark, sf).where("chunk_type = 'child'").select("chunk_id", "category", "doc_id")
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")
    index = vector_index.build(child.join(vecs, "doc_id"), "chunk_id", category="category")
    asked = access.with_allowed(table(spark, sf, "questions"), access.role_policy(spark)).select("query_id", "allowed")
    return vector_index.search(index, asked.join(_query_vectors(spark, sf), "query_id"), N, allowed="allowed", probes=index.cells)


@query(
    "r08_flow_context",
    _sql(
        f"""SELECT query_id, concat('## Retrieved Context', chr(10), chr(10), chr(10), string_agg(concat('### Source ', source_no, ': ',
                  string_split(source_path, '/')[-1], ' (', category, ')', chr(10), chunk_text), chr(10) || chr(10) ORDER BY source_no)) AS context
           FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_no
                 FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM flow)
                 WHERE CASE WHEN best >= {fv.SIMILARITY_THRESHOLD} THEN score >= {fv.SIMILARITY_THRESHOLD} ELSE rank <= 3 END) s
           JOIN chunks c ON c.chunk_id = s.ckey WHERE source_no <= 6 GROUP BY query_id""",
        _FLOW,
    ),
)
def r08_flow(spark, sf):
    stored = _stored_chunks(spark, sf)
    return retrieval.context(_flow(spark, sf, stored), stored, max_hits=_max_hits(spark, sf))


@query(
    "r09_parent_expansion",
    _sql(
        """SELECT r.query_id, c.parent_id, max(r.score) AS score, count(*) AS n_children, p.chunk_text AS parent_text, p.category, p.source_path
           FROM ranked r JOIN chunks c ON c.chunk_id = r.ckey JOIN chunks p ON p.chunk_id = c.parent_id
           GROUP BY r.query_id, c.parent_id, p.chunk_text, p.category, p.source_path""",
        _CHILD_RANK,
    ),
)
def r09(spark, sf):
    stored = _stored_chunks(spark, sf)
    return search.expand_to_parents(_child_hits(spark, sf, stored=stored), stored, _max_hits(spark, sf))


_EXCLUDED = ["Underwriting Guidelines", "Regulatory & Compliance", "Reference Materials"]
_WIDE = {**cs.CHUNKS, **cs.bm25("child_corpus", "questions", 20)}


@query(
    "r10_similar_documents",
    _sql(
        """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stem) AS rank, stem, source, category,
                  CASE WHEN chunk_text = '' THEN '' ELSE concat(rtrim("""
        + cs.strip("left(chunk_text, 100)")
        + """, '.'), '…') END AS snippet, CAST(least(floor(score / 64 * 100), 99) AS BIGINT) AS similarity
           FROM (SELECT *, row_number() OVER (PARTITION BY query_id, stem ORDER BY score DESC, ckey) AS one FROM (
                 SELECT r.query_id, r.ckey, r.score, c.chunk_text, c.category, string_split(c.source_path, '/')[-1] AS source,
                        regexp_replace(string_split(c.source_path, '/')[-1], '\\.[^.]*$', '') AS stem
                 FROM ranked r JOIN chunks c ON c.chunk_id = r.ckey
                 WHERE c.category NOT IN ('Underwriting Guidelines', 'Regulatory & Compliance', 'Reference Materials')))
           WHERE one = 1 QUALIFY rank <= 3""",
        _WIDE,
    ),
)
def r10(spark, sf):
    stored = _stored_chunks(spark, sf)
    hits = _child_hits(spark, sf, 20, stored=stored).withColumn("score", F.col("score") / 64)
    found = search.similar_documents(search.with_details(hits, stored, _max_hits(spark, sf, 20)), _EXCLUDED)
    return found.withColumn("stem", F.regexp_replace("source", r"\.[^.]*\z", "")).drop("company")


@query(
    "r11_role_visibility",
    with_models(
        """SELECT p.role, count(*) AS n_chunks, count(DISTINCT c.category) AS n_categories,
                  round(count(*) * 100.0 / (SELECT count(*) FROM chunks), 4) AS visible_pct
           FROM chunks c JOIN role_policy p ON p.category = 'all' OR p.category = c.category GROUP BY p.role""",
        "parsed_documents",
        extra={**cs.CHUNKS, **cs.ROLE_POLICY},
    ),
)
def r11(spark, sf):
    return access.visible_counts(chunks(spark, sf), access.role_policy(spark))


@query(
    "r11_unexpected_categories",
    _sql(
        """SELECT p.role, coalesce(string_agg(DISTINCT h.category, '|' ORDER BY h.category), '') AS categories,
                  coalesce(string_agg(DISTINCT h.category, '|' ORDER BY h.category) FILTER (NOT EXISTS (
                    SELECT 1 FROM role_policy a WHERE a.role = p.role AND a.category IN ('all', h.category))), '') AS unexpected
           FROM (SELECT DISTINCT role FROM role_policy) p
           LEFT JOIN (SELECT q.role, c.category FROM ranked r JOIN questions q ON q.query_id = r.query_id JOIN chunks c ON c.chunk_id = r.ckey) h ON h.role = p.role
           GROUP BY p.role""",
        _CHILD_RANK,
    ),
)
def r11_unexpected(spark, sf):
    # What the roles would see if searches did not filter.
    stored = _stored_chunks(spark, sf)
    hits = search.with_details(_child_hits(spark, sf, stored=stored), stored, _max_hits(spark, sf))
    roles = table(spark, sf, "questions").select("query_id", "role")
    return access.seen_categories(hits.join(roles, "query_id"), access.role_policy(spark))


@query(
    "r12_precision",
    with_models(
        """SELECT query_id, round(count(l.doc_id) * 1.0 / count(*), 4) AS precision, count(l.doc_id) > 0 AS any_hit
           FROM dranked d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.ckey WHERE rank <= 5 GROUP BY query_id""",
        "questions",
        extra=_DOC_RANK,
    ),
)
def r12(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1")
    return search.precision_at_k(_document_hits(spark, sf), good, "doc_id", 5)
