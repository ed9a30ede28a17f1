"""Exact cosine search of a table of query vectors over a table of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.ranking import top_n
from haulmark.sources.sizing import BROADCAST_ROWS

QUERY_BLOCK = 4096
VECTOR_BLOCK = 8192
_SCORED = 256


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(scores: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n by score downwards, then key upwards; ties are exact."""
    if len(scores) > n:
        cut = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((keys[near], -scores[near]))[:n]]


def unit_vectors(column: pa.Array) -> np.ndarray:
    return _unit(_matrix(column))


def best_of(queries: np.ndarray, vectors: np.ndarray, keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions of its best ``n`` vectors, their cosines) from unit vectors.

    Queries are taken some at a time, so that the products of a block stay small.
    """
    for a in range(0, len(queries), _SCORED):
        scores = np.round(vectors @ queries[a : a + _SCORED].T, 4)
        for q in range(scores.shape[1]):
            near = _best(scores[:, q], keys, n)
            yield a + q, near, scores[near, q]


def usable(vector: str) -> Column:
    """Vectors that are there, hold something, and no null or non-finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _packed(rows: int, kind: pa.DataType) -> Callable:
    """Rows of (id, vector) as few rows of many: ids, and the numbers of their unit vectors."""

    def row(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        data = pa.array([np.concatenate(parts).tobytes()], pa.large_binary())
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), data.cast(pa.binary())], names=["ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                piece = batch.slice(a, rows)
                ids += piece.column(0).to_pylist()
                parts.append(unit_vectors(piece.column(1)))
                if len(ids) >= rows:
                    yield row(ids, parts)
                    ids, parts = [], []
        if ids:
            yield row(ids, parts)

    return run


def cosine_top_n(
    queries: DataFrame,
    corpus: DataFrame,
    n: int = fv.SEARCH_RESULTS,
    key: str = "vec_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Best ``n`` vectors per query by cosine (4 decimals), ties by key; exact.

    Vectors stay where they lie.  Tasks pack them into rows of a block, queries are packed alike
    and broadcast, and every pair of blocks is one matrix product; a task keeps ``n`` rows per
    query.  A set of more than ``BROADCAST_ROWS`` queries takes several passes.  Vectors that are
    null, empty or hold a null or non-finite number take no part.
    """
    key_type, query_type = dict(corpus.dtypes)[key], dict(queries.dtypes)["query_id"]
    passes = max(1, -(-queries.count() // BROADCAST_ROWS))
    arrow = {"string": pa.string(), "int": pa.int32()}
    kinds = [arrow.get(t, pa.int64()) for t in (query_type, key_type)]
    asked = queries.where(usable(vector)).select("query_id", F.col(vector).alias("v"))
    asked = asked.withColumn("_pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)))
    packed = corpus.where(usable(vector)).select(key, vector).mapInArrow(_packed(VECTOR_BLOCK, kinds[1]), f"ids array<{key_type}>, data binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(batch.column(c) for c in range(4))):
                ids, q_ids = np.asarray(ids.as_py()), q_ids.as_py()
                vectors = np.frombuffer(data.as_py()).reshape(len(ids), -1)
                asking = np.frombuffer(q_data.as_py()).reshape(len(q_ids), -1)
                for q, near, scores in best_of(asking, vectors, ids, n):
                    found = ids[near]
                    if q_ids[q] in kept:
                        scores, found = np.concatenate([kept[q_ids[q]][0], scores]), np.concatenate([kept[q_ids[q]][1], found])
                        first = _best(scores, found, n)
                        scores, found = scores[first], found[first]
                    kept[q_ids[q]] = scores, found
        for q, (scores, found) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([q] * len(found), kinds[0]), pa.array(found.tolist(), kinds[1]), pa.array(scores)], names=["query_id", key, "score"]
            )

    def one_pass(number: int) -> DataFrame:
        some = asked.where(F.col("_pass") == number).select("query_id", "v").coalesce(1)
        blocks = some.mapInArrow(_packed(query_block, kinds[0]), f"ids array<{query_type}>, data binary")
        # Each block of the queries meets each block of vectors: the question that is asked.
        met = packed.crossJoin(F.broadcast(blocks.toDF("q_ids", "q_data")))
        return met.mapInArrow(score, f"query_id {query_type}, {key} {key_type}, score double")

    found = reduce(DataFrame.unionByName, [one_pass(i) for i in range(passes)])
    return top_n(found, ["query_id"], [F.desc("score"), F.asc(key)], n)
