"""One retrieval flow for a table of questions: role, route, search, context.

The role decides which categories a question may see, in every branch and before anything is
ranked; an unknown role stops the job.  Questions about the tables (intent ``sql``) are not
searched; those with a reference id (``keyword``) are searched by words, all others (``hybrid``)
by words and by vectors, fused by rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.text import detect_intent
from haulmark.operators import access, postings, search, vector_index


def routed(questions: DataFrame, policy: DataFrame) -> DataFrame:
    """``questions`` (query_id, question, role) with allowed categories and intent."""
    return access.with_allowed(questions, policy).withColumn("intent", detect_intent(F.col("question")))


def retrieve(
    asked: DataFrame,
    words: postings.Postings,
    vectors: vector_index.VectorIndex,
    query_vectors: DataFrame,
    n: int = fv.SEARCH_RESULTS,
    probes: int | None = None,
) -> DataFrame:
    """Best ``n`` chunks per routed question: query_id, intent, key, score, rank.

    Both indexes share the key.  A question without a vector is searched by words alone.
    """
    key = words.key
    searched = asked.where("intent <> 'sql'")
    hybrid = searched.where("intent = 'hybrid'")
    by_words = postings.search(words, searched, n, allowed="allowed")
    near = vector_index.search(vectors, hybrid.select("query_id", "allowed").join(query_vectors, "query_id"), n, allowed="allowed", probes=probes)
    ids = hybrid.select("query_id")
    fused = search.fuse([by_words.join(ids, "query_id", "left_semi"), near], key, n)
    keyword = by_words.join(ids, "query_id", "left_anti")
    found = fused.withColumn("intent", F.lit("hybrid")).unionByName(keyword.withColumn("intent", F.lit("keyword")))
    return found.select("query_id", "intent", key, "score", "rank")


def context(hits: DataFrame, chunks: DataFrame, threshold: float = fv.SIMILARITY_THRESHOLD, max_hits: int | None = None) -> DataFrame:
    """The context block of every question that has hits: query_id, context."""
    chosen = search.select_context(hits, threshold)
    return search.context_text(search.with_details(chosen, chunks, max_hits))
