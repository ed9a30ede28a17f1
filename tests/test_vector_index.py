"""The candidate index against all cosines: recall, copies, ties, categories, several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulmark.operators import vector_index, vectors

ROWS = "vec_id long, embedding array<float>, category string"


def sample(seed, count=600, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    points = centres[rng.integers(12, size=count)] + 0.4 * rng.normal(size=(count, dim))
    rows = [(i, [float(np.float32(x)) for x in p], "abc"[i % 3]) for i, p in enumerate(points)]
    # Many copies of one vector, a scaled copy, and rows that take no part.
    rows += [(1000 + i, rows[7][1], "abc"[i % 3]) for i in range(80)]
    rows += [(2000, [2 * x for x in rows[7][1]], "a"), (2001, None, "a"), (2002, [], "a"), (2003, [float("nan")] * dim, "b"), (2004, [None] * dim, "c"), (2005, rows[3][1], None)]
    return rows


def exact(rows, queries, n, allowed=None):
    held = [(k, np.array(v, dtype=float), c or "") for k, v, c in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for q, v in queries:
        v = np.array(v, dtype=float)
        scored = []
        for k, w, c in held:
            if allowed is None or allowed[q] is None or c in allowed[q]:
                scored.append((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 4), k))
        found += [(q, k, -s, r + 1) for r, (s, k) in enumerate(sorted(scored)[:n])]
    return sorted(found)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "vec_id", "score", "rank").collect())


def close(a, b):
    """Equal rows; cosines that fall on the edge of a rounding step may differ in the last place."""
    assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b]
    assert np.allclose([r[2] for r in a], [r[2] for r in b], atol=1.1e-4)


@pytest.fixture(scope="module")
def rows():
    return sample(1)


@pytest.fixture(scope="module")
def asked(spark, rows):
    queries = [(i, rows[i * 5][1]) for i in range(40)] + [(90, rows[7][1])]
    return queries, spark.createDataFrame(queries, "query_id long, embedding array<float>")


@pytest.mark.parametrize("block", [vectors.VECTOR_BLOCK, 50])
def test_all_cells_give_the_exact_rows(spark, rows, asked, block, monkeypatch):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", block)
    monkeypatch.setattr(vector_index, "VECTOR_BLOCK", block)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 4096 if block > 50 else 15)
    frame = spark.createDataFrame(rows, ROWS)
    index = vector_index.build(frame)
    want = exact(rows, asked[0], 10)
    close(got(vector_index.search(index, asked[1], 10, probes=index.cells)), want)
    close(got(vectors.cosine_top_n(asked[1], frame, 10, query_block=7)), want)


def test_recall_and_work_with_the_usual_probes(spark, asked):
    rows = sample(2, 4000)
    frame = spark.createDataFrame(rows, ROWS)
    index = vector_index.build(frame)
    assert 0 < index.probes < index.cells
    shares = vector_index.recall(vector_index.search(index, asked[1], 10), vectors.cosine_top_n(asked[1], frame, 10), "vec_id")
    assert shares.agg(F.avg("recall")).first()[0] >= 0.9
    # Equal vectors are stored once a category, their keys once each.
    assert index.read("vectors").count() < 4010 and index.read("members").count() == 4082
    again = vector_index.open_index(spark, index.path, "vec_id")
    assert np.array_equal(again.centres, index.centres) and again.key_type == "bigint"


def test_roles_see_their_categories_only(spark, rows, asked):
    lists = [None, ["a"], ["b", "c"], []]
    allowed = {q: lists[q % 4] for q, _ in asked[0]}
    queries = asked[1].join(spark.createDataFrame(list(allowed.items()), "query_id long, allowed array<string>"), "query_id")
    index = vector_index.build(spark.createDataFrame(rows, ROWS), category="category")
    found = got(vector_index.search(index, queries, 10, allowed="allowed", probes=index.cells))
    close(found, exact(rows, asked[0], 10, allowed))
    label = {k: c or "" for k, _, c in rows}
    some = got(vector_index.search(index, queries, 10, allowed="allowed"))
    assert all(allowed[q] is None or label[k] in allowed[q] for q, k, _, _ in some)


def test_empty_corpus_and_no_queries(spark, rows, asked):
    index = vector_index.build(spark.createDataFrame([], ROWS))
    assert vector_index.search(index, asked[1]).count() == 0
    index = vector_index.build(spark.createDataFrame(rows[:5], ROWS))
    assert vector_index.search(index, asked[1].limit(0)).count() == 0
    assert vectors.cosine_top_n(asked[1].limit(0), spark.createDataFrame(rows[:5], ROWS)).count() == 0
