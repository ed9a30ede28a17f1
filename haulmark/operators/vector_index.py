"""Candidate index for vectors: cells around centres, equal vectors folded, exact scores.

An index is a folder of four tables:

``centres``  cell and its centre, fitted by k-means on a bounded sample (``SAMPLE`` vectors)
``vectors``  every different vector once per category, with the smallest key that has it;
             partitioned by category and cell
``members``  the keys of every vector, partitioned alike
``cells``    number of different vectors per category and cell

A query looks into the ``probes`` cells whose centres are nearest and gets exact cosines of the
vectors there, so only candidates can be missed, never misjudged; with as many probes as cells the
result is the exact one.  The usual number is set when the index is built: as many as searches
within the sample need to find 95 % of their neighbours, and a quarter of the cells at least.  Categories that a query may not see are left out before ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.ranking import top_n
from haulmark.operators.vectors import QUERY_BLOCK, VECTOR_BLOCK, best_of, unit_vectors, usable
from haulmark.sources.sizing import broadcast_if_small, fresh_path

SAMPLE = 20_000
MAX_CELLS = 1024
ROUNDS = 10
RECALL = 0.95
_HASH = ["h1", "h2"]
_GROUP = ["category", "cell", "block", "q_block"]


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, the type of its keys, and the centres of its cells."""

    spark: SparkSession
    path: str
    key: str
    key_type: str
    vector_type: str
    centres: np.ndarray
    probes: int

    def read(self, name: str) -> DataFrame:
        """A table of the index; the types of folder names are not left to inference."""
        key = f"`{self.key}` {self.key_type}"
        columns = {
            "vectors": f"h1 long, h2 long, v {self.vector_type}, {key}, category string, cell int",
            "members": f"h1 long, h2 long, {key}, category string, cell int",
            "cells": "category string, cell int, n long",
        }
        df = self.spark.read.schema(columns[name]).parquet(f"{self.path}/{name}")
        # An empty folder name comes back as null.
        return df.withColumn("category", F.coalesce("category", F.lit("")))

    @property
    def cells(self) -> int:
        return len(self.centres)


def open_index(spark: SparkSession, path: str, key: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    kinds = dict(spark.read.parquet(f"{path}/vectors").dtypes)
    return VectorIndex(spark, path, key, kinds[key], kinds["v"], np.array([r.centre for r in rows]).reshape(len(rows), -1), rows[0].probes if rows else 0)


def _fit(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors: farthest-first seeds, then rounds of assignment and mean."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < cells:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        cell = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, norm, out=centres.copy(), where=norm > 0)
    return centres


def _calibrated(vectors: np.ndarray, centres: np.ndarray) -> int:
    """Probes at which searches for some vectors of the sample find ``RECALL`` of their neighbours."""
    asking = np.linspace(0, len(vectors) - 1, min(len(vectors), 500)).astype(int)
    scores = vectors[asking] @ vectors.T
    scores[np.arange(len(asking)), asking] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : fv.SEARCH_RESULTS]
    place = np.argsort(_nearest(centres, vectors[asking], len(centres)), axis=1)
    cell = _nearest(centres, vectors, 1)[:, 0]
    needed = np.take_along_axis(place, cell[near], axis=1) + 1
    return int(np.quantile(needed, RECALL, method="higher"))


def _nearest(centres: np.ndarray, vectors: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest cells of every vector, nearest first."""
    order = np.argsort(-np.round(vectors @ centres.T, 9), axis=1, kind="stable")
    return order[:, :count]


def _with_cells(df: DataFrame, vector: str, centres: np.ndarray, count: int) -> DataFrame:
    """``df`` with ``cells``, the nearest cells of its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unit_vectors(batch.column(batch.schema.get_field_index(vector)))
                near = _nearest(centres, rows, count).astype(np.int32)
                offsets = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], pa.int32())
                yield batch.append_column("cells", pa.ListArray.from_arrays(offsets, pa.array(near.ravel())))

    return df.mapInArrow(run, df.withColumn("cells", F.array(F.lit(0).cast("int"))).schema)


def build(
    corpus: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    category: str | None = None,
    cells: int | None = None,
    sample: int = SAMPLE,
    name: str = "vector-index",
) -> VectorIndex:
    """Index of all usable vectors; only the centres come from a sample, chosen by a hash."""
    spark = corpus.sparkSession
    label = F.coalesce(F.col(category), F.lit("")) if category else F.lit("")
    rows = corpus.where(usable(vector)).select(key, label.alias("category"), F.col(vector).alias("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    picked = rows.select("h1", "h2", "v").dropDuplicates(_HASH).orderBy(*_HASH).limit(sample).select("v").toArrow()
    if picked.num_rows:
        known = unit_vectors(picked.column("v").combine_chunks())
        count = cells or max(1, min(MAX_CELLS, round(len(known) ** 0.5)))
        centres = _fit(known, min(count, len(known)))
        # Questions may lie apart from what is stored, so never less than a quarter of the cells.
        probes = min(len(centres), max(8, len(centres) // 4, _calibrated(known, centres)))
    else:
        centres, probes = np.zeros((0, 1)), 0
    path = fresh_path(spark, name)
    index = VectorIndex(spark, path, key, dict(corpus.dtypes)[key], dict(corpus.dtypes)[vector], centres, probes)
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int").write.parquet(f"{path}/centres")
    placed = _with_cells(rows, "v", centres, 1).withColumn("cell", F.col("cells")[0])
    by = ["category", "cell"]
    folded = placed.groupBy(*by, *_HASH).agg(F.first("v").alias("v"), F.min(key).alias(key))
    folded.hint("rebalance", *by).sortWithinPartitions(*by, *_HASH).write.partitionBy(*by).parquet(f"{path}/vectors")
    members = placed.select(*by, *_HASH, key)
    members.hint("rebalance", *by).sortWithinPartitions(*by, *_HASH).write.partitionBy(*by).parquet(f"{path}/members")
    index.read("vectors").groupBy(*by).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/cells")
    return index


def search(
    index: VectorIndex,
    queries: DataFrame,
    n: int = fv.SEARCH_RESULTS,
    vector: str = "embedding",
    allowed: str | None = None,
    probes: int | None = None,
) -> DataFrame:
    """Best ``n`` rows per query among those in the cells it looks into: query_id, key, score, rank.

    With ``allowed`` (array of categories, null = all) a query meets only vectors it may see.
    Queries and vectors meet in groups of a cell's block of vectors and a block of queries, both of
    bounded size, however full a cell is or however many queries choose it.
    """
    key, query_type = index.key, dict(queries.dtypes)["query_id"]
    schema = f"query_id {query_type}, {key} {index.key_type}, score double"
    if not index.cells:
        return index.spark.createDataFrame([], schema + ", rank int")
    carry = ["allowed"] if allowed else []
    asked = queries.where(usable(vector)).select("query_id", F.col(vector).alias("v"), *[F.col(allowed).alias(c) for c in carry])
    q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = _with_cells(asked, "v", index.centres, probes or index.probes)
    asked = asked.select("query_id", "v", *carry, F.explode("cells").alias("cell"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("q_block"))
    # One row per category and cell; the whole list is at most MAX_CELLS times the categories.
    stored = index.read("cells").withColumn("blocks", F.ceil(F.col("n") / VECTOR_BLOCK))
    probing = asked.join(broadcast_if_small(stored), "cell")
    if allowed:
        probing = probing.where(F.col("allowed").isNull() | F.array_contains("allowed", F.col("category")))
    looked = sorted(tuple(r) for r in probing.select("category", "cell").distinct().collect())
    read = F.col("cell").isin(sorted({c for _, c in looked})) & F.col("category").isin(sorted({g for g, _ in looked}))
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    vectors = index.read("vectors").where(read).join(broadcast_if_small(stored), ["category", "cell"])
    vectors = vectors.withColumn("block", F.pmod(F.col("h1"), F.col("blocks"))).withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    left = probing.select(*_GROUP, "query_id", "v")
    right = vectors.select(*_GROUP, *_HASH, key, "v")

    def score(asking: pa.Table, found: pa.Table) -> pa.Table:
        names = ["query_id", "category", "cell", *_HASH, key, "score"]
        if not asking.num_rows or not found.num_rows:
            return out.empty_table()
        q, v = (unit_vectors(t.column("v").combine_chunks()) for t in (asking, found))
        keys = np.asarray(found.column(key).to_pylist())
        of, near, scores = [], [], []
        for i, at, values in best_of(q, v, keys, n):
            of.append(np.full(len(at), i))
            near.append(at)
            scores.append(values)
        of, near = pa.array(np.concatenate(of)), pa.array(np.concatenate(near))
        columns = [asking.column("query_id").take(of), *[found.column(c).take(near) for c in names[1:-1]], pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(columns, names=names).cast(out)

    arrow = {"string": pa.string(), "int": pa.int32()}
    out = pa.schema(
        [("query_id", arrow.get(query_type, pa.int64())), ("category", pa.string()), ("cell", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()),
         (key, arrow.get(index.key_type, pa.int64())), ("score", pa.float64())]
    )
    wide = f"query_id {query_type}, category string, cell int, h1 long, h2 long, {key} {index.key_type}, score double"
    scored = left.groupBy(*_GROUP).cogroup(right.groupBy(*_GROUP)).applyInArrow(score, wide)
    # The rows of the n best vectors hold the n best rows: a vector's smallest key ranks it.
    best = top_n(scored, ["query_id"], [F.desc("score"), F.asc(key)], n, "_of").drop("_of", key)
    group = ["category", "cell", *_HASH]
    best = broadcast_if_small(best) if queries.count() * n <= 100_000 else best
    members = index.read("members").where(read).join(best.select(*group).distinct(), group, "left_semi")
    members = top_n(members, group, [F.asc(key)], n, "_m").drop("_m")
    rows = members.join(best, group).select("query_id", key, "score")
    return top_n(rows, ["query_id"], [F.desc("score"), F.asc(key)], n)


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """Share of the exact rows that a search found, per query."""
    marked = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("_hit")), ["query_id", key], "left")
    return marked.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
