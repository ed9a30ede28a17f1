"""Quality classifier: a factorisation machine.

The score of a text is a sigmoid of

    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so all pairs of features interact through vectors of ``RANK`` numbers in time linear in the
features.  Features are hashed words (every occurrence with value 1 / words), binned structure
statistics and the binned length of the text.  Labels, language, source and id never enter.

The machine is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen evenly by a hash of the id
from all rows that are not held out; every row of the table is scored in its own task without a
shuffle.

Defined results: null and empty texts have the statistics of an empty text and get its score;
repeated rows get equal scores; an empty table gives an empty result; without labelled rows the
machine scores everything 0.5, and with one kind of label near that label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from haulmark.llm import textstats
from haulmark.llm.tables import bounded_sample, held_out
from haulmark.llm.tokens import TextSlice, slices

WORD_BITS = 14
RANK = 8
TRAIN_ROWS = 12_000
BINS = 24
ACCEPT = 0.7

_WORDS = 1 << WORD_BITS
_FIELDS = 10


def structure(part: TextSlice) -> np.ndarray:
    """Feature number of the bin of every statistic, a row for each text."""
    c = textstats.counts(part)
    length = np.log2(1.0 + np.diff(part.bounds)) / 24.0
    words = np.log2(1.0 + c["n_words"]) / 22.0
    shares = np.column_stack([np.sqrt(textstats.rates(c)), length, words])
    bins = np.minimum((np.clip(shares, 0, 1) * BINS).astype(np.int64), BINS - 1)
    return _WORDS + bins + BINS * np.arange(_FIELDS)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, part: TextSlice) -> np.ndarray:
        buckets = (part.words() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        fixed = structure(part)
        n = np.maximum(part.n_words, 1).astype(np.float64)
        square = (self.factors**2).sum(1)
        margin = self.bias + self.linear[fixed].sum(1)
        total = self.factors[fixed].sum(1)
        own = square[fixed].sum(1)
        filled = np.flatnonzero(part.n_words)
        if len(filled):
            at = part.word_ptr[filled]
            margin[filled] += np.add.reduceat(self.linear[buckets], at) / n[filled]
            own[filled] += np.add.reduceat(square[buckets], at) / n[filled] ** 2
            for f in range(self.factors.shape[1]):
                total[filled, f] += np.add.reduceat(self.factors[buckets, f], at) / n[filled]
        margin += 0.5 * ((total**2).sum(1) - own)
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def training_rows(docs: DataFrame) -> DataFrame:
    """label, distinct word features, how often each occurs, and structure features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(batch.column("text")):
                fixed = structure(part)
                buckets = (part.words() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
                key, times = np.unique(part.word_doc * _WORDS + buckets, return_counts=True)
                cuts = np.searchsorted(key, np.arange(part.n_docs + 1) * _WORDS).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array((key % _WORDS).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32))),
                    pa.array(list(fixed.astype(np.int32)), pa.list_(pa.int32())),
                ]
                rest = [batch.column(c).slice(first, last - first) for c in ("doc_id", "good")]
                yield pa.RecordBatch.from_arrays([*rest, *lists], names=["doc_id", "good", "words", "times", "fixed"])

    return docs.mapInArrow(run, "doc_id long, good int, words array<int>, times array<int>, fixed array<int>")


def _fit(rows: pa.Table, epochs: int, batch: int, rate: float, decay: float, seed: int) -> Machine:
    """Logistic loss by Adam over mini-batches; the rows are the bounded sample."""
    rng = np.random.default_rng(seed)
    size = _WORDS + BINS * _FIELDS
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, RANK))
    good = rows.column("good").to_numpy().astype(np.float64)
    if not len(good):
        return Machine(0.0, w, np.zeros_like(v))
    share = np.clip(good.mean(), 0.02, 0.98)
    bias = float(np.log(share / (1 - share)))
    words = rows.column("words").combine_chunks()
    ptr = words.offsets.to_numpy()
    index = words.flatten().to_numpy().astype(np.int64)
    times = rows.column("times").combine_chunks().flatten().to_numpy().astype(np.float64)
    ptr = ptr - ptr[0]
    fixed = rows.column("fixed").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(good), _FIELDS)
    n = np.maximum(np.add.reduceat(np.append(times, 0), np.minimum(ptr[:-1], len(times))), 1)
    value = times / np.repeat(n, np.diff(ptr))
    theta = [w, v, np.array([bias])]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(good))
        for begin in range(0, len(order), batch):
            rows_now = np.sort(order[begin : begin + batch])
            lengths = np.diff(ptr)[rows_now]
            inside = np.repeat(ptr[:-1][rows_now] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            row = np.concatenate([np.repeat(np.arange(len(rows_now)), lengths), np.repeat(np.arange(len(rows_now)), _FIELDS)])
            feat = np.concatenate([index[inside], fixed[rows_now].ravel()])
            x = np.concatenate([value[inside], np.ones(len(rows_now) * _FIELDS)])
            m = len(rows_now)
            vx = theta[1][feat] * x[:, None]
            total = np.column_stack([np.bincount(row, vx[:, f], m) for f in range(RANK)])
            own = np.bincount(row, (vx**2).sum(1), m)
            margin = theta[2][0] + np.bincount(row, theta[0][feat] * x, m) + 0.5 * ((total**2).sum(1) - own)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - good[rows_now]) / m
            each = error[row] * x
            grads = [
                np.bincount(feat, each, size) + decay * theta[0],
                np.column_stack([np.bincount(feat, each * (total[row, f] - vx[:, f]), size) for f in range(RANK)])
                + decay * theta[1],
                np.array([error.sum()]),
            ]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(theta[2][0]), theta[0], theta[1])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = TRAIN_ROWS,
    epochs: int = 12,
    batch: int = 256,
    rate: float = 0.02,
    decay: float = 1e-5,
    seed: int = 11,
) -> Machine:
    """Machine from the labelled rows that are not held out (``labels``: doc_id, quality)."""
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    chosen = bounded_sample(known.where(~held_out()), ["doc_id"], max_rows)
    # The chosen ids are at most ``max_rows`` pairs of numbers.
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    rows = training_rows(joined).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    return _fit(rows, epochs, batch, rate, decay, seed)


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(machine.score(part))],
                    names=["doc_id", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, machine: Machine, accept: float = ACCEPT) -> DataFrame:
    """The rows, with all their columns, whose text scores ``accept`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [machine.score(part) for _, _, part in slices(batch.column("row").field("text"))]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) >= accept))

    # As one column, rows go through whatever the names of their columns are.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, StructType([StructField("row", rows.schema["row"].dataType)])).select("row.*")
