"""Exact top-k by inner product with M-trees of pages.

The largest inner product is the nearest point after one more coordinate, sqrt(M - |x|^2) with M
the largest squared norm, is put to every candidate and 0 to every query: then
d(q, x)^2 = |q|^2 + M - 2 q.x, a metric in which the triangle inequality holds.

Candidates are dealt to the nearest of a bounded number of centres, cells are split into pages of
about ``PAGE`` vectors, and every page is written as an M-tree node: a centre with covering radius,
leaves with their own centre, covering radius and distance to the page's centre, and the distance
of every vector to its leaf's centre.  A block of queries and a page meet in a task.  Every query
visits the leaves best-first by the least distance their radius allows; leaves whose bound, first
from the stored parent distance and then from the centre, is beyond the query's k-th best are not
opened, and vectors whose stored distance rules them out are not scored.  The best k of every page
are merged at the end.  Scores are exact sums of whole numbers.

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; shorter vectors are read as padded with zeros; rows with equal ids are one, of
which the smallest vector counts; ties go to the smaller id; with fewer candidates than k all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.tables import bounded_sample, keep

PAGE = 8192
LEAF = 96
CENTRES = 64
SAMPLE = 4096
QUERY_BLOCK = 1024
SCALE = 64


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (floor(scale * component) as double) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    return valid.groupBy("vec_id").agg(F.min(F.transform("x", lambda c: F.floor(c * scale).cast("double"))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


class PageTree:
    """One page: vectors in leaf order, leaves with centre, radius and parent distance."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float):
        self.top = top
        lifted = _lifted(x, top)
        centre = lifted.mean(0, keepdims=True)
        rng = np.random.default_rng(len(ids))
        routers = lifted[rng.choice(len(ids), max(1, -(-len(ids) // LEAF)), replace=False)]
        home = _distances(lifted, routers).argmin(1)
        order = np.lexsort((ids, home))
        used, begin = np.unique(home[order], return_index=True)
        self.ids, self.x = ids[order], x[order]
        self.bounds = np.append(begin, len(ids))
        self.centre, self.routers = centre, routers[used]
        own = np.sqrt(((lifted[order] - np.repeat(self.routers, np.diff(self.bounds), axis=0)) ** 2).sum(1))
        self.stored = own
        self.radius = np.maximum.reduceat(own, begin)
        self.parent = _distances(centre, self.routers)[0]

    def row(self) -> dict:
        return {
            "ids": self.ids, "x": self.x.ravel(), "bounds": self.bounds, "centre": self.centre.ravel(), "routers": self.routers.ravel(),
            "stored": self.stored, "radius": self.radius, "parent": self.parent,
        }

    @classmethod
    def read(cls, row: dict[str, np.ndarray], width: int, top: float) -> PageTree:
        self = cls.__new__(cls)
        self.top = top
        for name in ("ids", "bounds", "stored", "radius", "parent"):
            setattr(self, name, row[name])
        self.x = row["x"].reshape(-1, width)
        self.centre = row["centre"].reshape(1, width + 1)
        self.routers = row["routers"].reshape(-1, width + 1)
        return self

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, vec_id and score of the best k of this page for every query."""
        n, leaves = len(q), len(self.radius)
        lifted = np.column_stack([q, np.zeros(n)])
        norm = (q**2).sum(1) + self.top
        best_score = np.full((n, k), -np.inf)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        slack = 1e-6 * (1 + np.sqrt(norm))
        to_centre = _distances(lifted, self.centre)[:, 0]
        # From the stored parent distances alone; replaced by the true bound when a leaf comes up.
        bound = np.maximum(np.abs(to_centre[:, None] - self.parent[None, :]) - self.radius[None, :], 0)
        exact = np.zeros((n, leaves), dtype=bool)
        distance = np.zeros((n, leaves))
        active = np.arange(n)
        while len(active):
            reach = np.sqrt(np.maximum(norm[active] - 2 * best_score[active, -1], 0)) + slack[active]
            leaf = bound[active].argmin(1)
            go = bound[active, leaf] <= reach
            active, leaf, reach = active[go], leaf[go], reach[go]
            for number in np.unique(leaf):
                here = np.flatnonzero(leaf == number)
                rows = active[here]
                fresh = rows[~exact[rows, number]]
                if len(fresh):
                    d = _distances(lifted[fresh], self.routers[number : number + 1])[:, 0]
                    distance[fresh, number], exact[fresh, number] = d, True
                    bound[fresh, number] = np.maximum(bound[fresh, number], d - self.radius[number])
                open_now = bound[rows, number] <= reach[here]
                rows, limit = rows[open_now], reach[here][open_now]
                bound[rows, number] = np.inf
                if len(rows):
                    self._visit(number, rows, limit, distance[rows, number], query_ids, q, best_score, best_id)
        found = np.isfinite(best_score)
        at = np.nonzero(found)[0]
        return at, best_id[found], best_score[found].astype(np.int64)

    def _visit(self, number, rows, limit, distance, query_ids, q, best_score, best_id) -> None:
        inside = slice(self.bounds[number], self.bounds[number + 1])
        stored = self.stored[inside]
        near = np.flatnonzero((np.abs(distance[:, None] - stored[None, :]) <= limit[:, None]).any(0))
        if not len(near):
            return
        ids = self.ids[inside][near]
        score = q[rows] @ self.x[inside][near].T
        score[query_ids[rows][:, None] == ids[None, :]] = -np.inf
        better = np.flatnonzero((score >= best_score[rows, -1:]).any(1))
        if not len(better):
            return
        rows, score = rows[better], score[better]
        k = best_score.shape[1]
        all_score = np.concatenate([best_score[rows], score], axis=1)
        all_id = np.concatenate([best_id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((all_id, -all_score), axis=1)[:, :k]
        best_score[rows] = np.take_along_axis(all_score, order, 1)
        best_id[rows] = np.take_along_axis(all_id, order, 1)


_ARRAYS = {"ids": "long", "x": "double", "bounds": "long", "centre": "double", "routers": "double", "stored": "double", "radius": "double", "parent": "double"}


def build_pages(points: DataFrame, width: int, top: float) -> DataFrame:
    """page and the arrays of its tree, for all ``points`` (vec_id, v)."""
    sample = bounded_sample(points, ["vec_id"], SAMPLE).orderBy("vec_id").toArrow()
    if not sample.num_rows:
        centres = np.zeros((1, width + 1))
    else:
        known = _lifted(_matrix(sample.column("v"), width), top)
        centres = known[np.random.default_rng(5).choice(len(known), min(CENTRES, len(known)), replace=False)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _distances(_lifted(_matrix(batch.column("v"), width), top), centres).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "v", "cell"])

    placed = keep(points.mapInArrow(assign, "vec_id long, v array<double>, cell long"), "cells")
    # Small neighbouring cells share a page; large ones are split by a hash of the id.
    sizes = placed.groupBy("cell").count().orderBy("cell").collect()
    total = sum(r["count"] for r in sizes)
    pages, first, room, layout = 0, 0, 0, []
    for r in sizes:
        parts = max(1, round(r["count"] / PAGE))
        if parts == 1 and r["count"] <= room:
            layout.append((r["cell"], first, 1))
            room -= r["count"]
            continue
        first = pages
        layout.append((r["cell"], first, parts))
        pages += parts
        room = PAGE - r["count"] if parts == 1 else 0
        first = pages - 1
    if not total:
        layout = [(0, 0, 1)]
    plan = placed.sparkSession.createDataFrame(layout, "cell long, first long, parts long")
    # At most ``CENTRES`` rows.
    dealt = placed.join(F.broadcast(plan), "cell").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("page"), "vec_id", "v")

    def build(group: pa.Table) -> pa.Table:
        tree = PageTree(group.column("vec_id").to_numpy(), _matrix(group.column("v"), width), top)
        arrays = {name: pa.array([values.tolist()], pa.list_(pa.int64() if _ARRAYS[name] == "long" else pa.float64())) for name, values in tree.row().items()}
        return pa.table({"page": group.column("page").slice(0, 1), **arrays})

    return dealt.groupBy("page").applyInArrow(build, "page long, " + ", ".join(f"{n} array<{t}>" for n, t in _ARRAYS.items()))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for every query row."""
    points = keep(whole_vectors(vectors, scale), "vectors")
    extent = points.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("top")).first()
    width, top = extent["width"] or 1, extent["top"] or 0.0
    pages = keep(build_pages(points, width, top), "pages")
    queries = points.where(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(pages.count() - 1).cast("long"))
    met = (dealt.withColumn("page", F.explode(numbers)) if pages.count() else dealt.withColumn("page", F.lit(None).cast("long"))).join(pages, "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].values.to_numpy(zero_copy_only=False) for name in _ARRAYS}
                block = batch.column("queries")[r].values
                query_ids = block.field("vec_id").to_numpy()
                at, ids, scores = PageTree.read(row, width, top).search(query_ids, _matrix(block.field("v"), width), k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
