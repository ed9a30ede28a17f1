"""Quality rules: an isolation forest on rule statistics.

Every text is reduced to exact counts in its own row.  A forest of random splits is grown on
bounded subsamples of the statistics, as the method has it, and the anomaly score of a document
is 2 ** (-mean path length / expected path length).  The score above which a document is rejected
is set from all labelled rows: the cut that separates the labels best while it rejects at most
``max_loss`` of the good ones.

Defined results: a null or wordless text has zero counts and fails the base rules; repeated rows
give repeated results; an empty table gives an empty result; without labelled rows of both kinds
nothing but the base rules rejects.  Only ``doc_id`` and ``text`` are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm import textstats
from haulmark.llm.tables import bounded_sample, keep
from haulmark.llm.tokens import slices

N_TREES = 100
SUBSAMPLE = 256
SCORE_BINS = 2000
MAX_LOSS = 0.01
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of ``textstats.COUNTS`` for every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(batch.column("text")):
                found = textstats.counts(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first)]
                    + [pa.array(found[name].astype(np.int64)) for name in textstats.COUNTS],
                    names=["doc_id", *textstats.COUNTS],
                )

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in textstats.COUNTS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of ``n`` points."""
    n = np.asarray(n, dtype=np.float64)
    inner = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(inner) + 0.5772156649015329) - 2 * inner / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Complete binary trees as arrays: feature (-1 at a leaf), cut, and path length of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    scale: float

    @classmethod
    def grow(cls, points: np.ndarray, trees: int = N_TREES, size: int = SUBSAMPLE, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(size, len(points))
        height = max(1, int(np.ceil(np.log2(max(size, 2)))))
        shape = (trees, 2 ** (height + 1) - 1)
        feature, cut, path = np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape)
        for t in range(trees):
            chosen = points[rng.choice(len(points), size, replace=False)] if size else points
            todo = [(0, 0, chosen)]
            while todo:
                node, depth, rows = todo.pop()
                low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
                varied = np.flatnonzero(high > low)
                if depth == height or not len(varied):
                    path[t, node] = depth + _expected_path(len(rows))
                    continue
                f = rng.choice(varied)
                value = rng.uniform(low[f], high[f])
                feature[t, node], cut[t, node] = f, value
                left = rows[:, f] < value
                todo += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]
        return cls(feature, cut, path, float(max(_expected_path(size), 1e-9)))

    def score(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(points), dtype=np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                inner = f >= 0
                right = points[rows, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.scale)


def _as_counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in textstats.COUNTS}


def anomaly_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    """All columns of ``text_counts`` and the score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(textstats.rates(_as_counts(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "anomaly"])

    return stats.mapInArrow(run, stats.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", anomaly double")


def rejecting_score(scored: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """Score from which documents are rejected, from a histogram of all labelled rows.

    The histogram has at most ``SCORE_BINS`` + 1 bins for each label, whatever the input.
    """
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("good"))
    bins = (
        scored.where(~base_failed()).join(known, "doc_id")
        .groupBy(F.floor(F.col("anomaly") * SCORE_BINS).cast("int").alias("bin"), "good")
        .count()
        .collect()
    )
    table = np.zeros((2, SCORE_BINS + 2))
    for r in bins:
        table[r["good"], r["bin"]] += r["count"]
    if not table.sum(1).all():
        return 2.0
    # Share of rows at or above each bin, for bad and good rows.
    bad, good = np.cumsum(table[:, ::-1], 1)[:, ::-1] / table.sum(1, keepdims=True)
    gain = np.where(good <= max_loss, bad - good, -1.0)
    return float(np.argmax(gain)) / SCORE_BINS if gain.max() > 0 else 2.0


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS, seed: int = 7) -> DataFrame:
    """doc_id, counts, anomaly, base_failed and kept for every row of ``docs`` (doc_id, text).

    ``labels`` holds doc_id and quality (1 good, 0 bad).  The trees see at most
    ``N_TREES * SUBSAMPLE`` rows, which is what they draw; counts, scores and the cut use all.
    """
    stats = keep(text_counts(docs), "rule-counts")
    sample = bounded_sample(stats, ["doc_id", "n_words", "word_chars"], N_TREES * SUBSAMPLE)
    rows = sample.select(*textstats.COUNTS).orderBy(*textstats.COUNTS).toArrow()
    points = textstats.rates({n: rows.column(n).to_numpy() for n in textstats.COUNTS})
    scored = keep(anomaly_scores(stats, Forest.grow(points, seed=seed)), "rule-scores")
    cut = rejecting_score(scored, labels, max_loss)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cut))
