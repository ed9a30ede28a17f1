"""Role, route, search and context in one flow."""

import pytest

from haulmark import fixed_values as fv
from haulmark.operators import access, postings, retrieval, vector_index

CHUNK = "chunk_id string, chunk_text string, category string, source_path string, embedding array<float>"


@pytest.fixture(scope="module")
def flow(spark):
    labels = sorted({c for cs in fv.ROLE_CATEGORIES.values() for c in cs if c != "all"})[:4]
    rows = [(f"c{i}", f"cargo policy {i} CLM-24-{i}", labels[i % 4], f"/vol/{i}.pdf", [1.0, float(i), 0.5]) for i in range(40)]
    chunks = spark.createDataFrame(rows, CHUNK)
    words = postings.build(chunks, category="category", parts=4)
    near = vector_index.build(chunks, "chunk_id", category="category")
    return chunks, words, near


def asked(spark, rows):
    return retrieval.routed(spark.createDataFrame(rows, "query_id long, question string, role string"), access.role_policy(spark))


def test_every_branch_obeys_the_role(spark, flow):
    chunks, words, near = flow
    roles = list(fv.ROLE_CATEGORIES)
    rows = [(i, ["cargo policy wording", "status of CLM-24-7", "how many trucks"][i % 3], roles[i % len(roles)]) for i in range(48)]
    routed = asked(spark, rows)
    queries = spark.createDataFrame([(i, [1.0, float(i), 0.0]) for i in range(48)], "query_id long, embedding array<float>")
    hits = retrieval.retrieve(routed, words, near, queries, 5, probes=near.cells).collect()
    label = {r.chunk_id: r.category for r in chunks.collect()}
    allowed = {r.query_id: r.allowed for r in routed.collect()}
    intents = {r.query_id: r.intent for r in routed.collect()}
    assert {r.intent for r in hits} == {"hybrid", "keyword"}
    assert all(intents[r.query_id] == r.intent != "sql" for r in hits)
    assert all(allowed[r.query_id] is None or label[r.chunk_id] in allowed[r.query_id] for r in hits)


def test_an_unknown_role_stops_the_job(spark):
    with pytest.raises(Exception, match="unknown role"):
        asked(spark, [(1, "cargo", "nobody")]).collect()


def test_context_of_hits_below_the_threshold_has_three_sources(spark, flow):
    chunks, words, near = flow
    routed = asked(spark, [(1, "cargo policy", "executive"), (2, "nothing of this", "executive")])
    queries = spark.createDataFrame([(1, [1.0, 3.0, 0.0])], "query_id long, embedding array<float>")
    text = {r.query_id: r.context for r in retrieval.context(retrieval.retrieve(routed, words, near, queries), chunks).collect()}
    assert set(text) == {1} and text[1].count("### Source ") == 3
