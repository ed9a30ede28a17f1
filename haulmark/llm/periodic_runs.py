"""Periodic runs: maximal stretches of words that repeat with a smallest period.

The runs of a text are found by its Lyndon roots.  Under one of the two orders of the symbols
(ascending, descending) every run holds a place at which its root is the longest Lyndon word that
begins there, and that word ends where the next smaller suffix begins.  So there are at most two
candidates a place; each is extended to the right and to the left by longest common extensions,
which suffix trees (Ukkonen) of the sequence and of its reversal answer in constant time.

A run of four periods or more covers words that all lie at most one period behind the last
occurrence of the same three words.  ``candidate_regions`` keeps only stretches in which that can
hold, at every scale of the period; no run is lost, and ordinary prose needs no tree.

Every text is handled in its row: there is no shuffle, and memory grows with the longest region.

Defined results: a null, empty or blank text has no words and no runs; a run never crosses a text;
repeated rows get the same result each; an empty table gives an empty result; other columns of
any name are kept and not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from haulmark.llm.suffix_tree import SuffixTree
from haulmark.llm.tables import WORD, in_batches

MIN_LENGTH = 6
MIN_EXPONENT = 4
_WORD = re.compile(WORD.encode())
_GRAM = 3


def _distance_back(ids: np.ndarray) -> np.ndarray:
    """How far back the same three words began last, for every place; a very large number if never."""
    n = len(ids) - _GRAM + 1
    wide = int(ids.max()) + 1
    pair = np.unique(ids[:-1].astype(np.int64) * wide + ids[1:], return_inverse=True)[1]
    gram = pair[:n] * np.int64(wide) + ids[_GRAM - 1 :]
    order = np.argsort(gram, kind="stable")
    back = np.full(n, np.iinfo(np.int64).max)
    same = gram[order[1:]] == gram[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def candidate_regions(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint (from, to) that hold all runs, each run whole in one of them."""
    n = len(ids)
    if n < MIN_LENGTH:
        return []
    back = _distance_back(ids)
    if (back < n).sum() < MIN_LENGTH - _GRAM:
        return []
    edge = np.zeros(n + 1, dtype=np.int64)
    reach = 1
    while True:
        # Periods above reach / 2 and up to reach.
        least = max(MIN_LENGTH, MIN_EXPONENT * (reach // 2 + 1))
        if least > n:
            break
        near = np.concatenate(([0], (back <= reach).astype(np.int8), [0]))
        turn = np.flatnonzero(np.diff(near))
        first, last = turn[::2], turn[1::2]
        enough = last - first >= least - (reach // 2 + 1) - (_GRAM - 1)
        np.add.at(edge, np.maximum(first[enough] - reach, 0), 1)
        np.add.at(edge, last[enough] + _GRAM - 1, -1)
        reach *= 2
    inside = np.concatenate(([0], (np.cumsum(edge)[:n] > 0).astype(np.int8), [0]))
    turn = np.flatnonzero(np.diff(inside))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def _lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word that begins at a place ends: the next smaller suffix."""
    ranks = rank.tolist()
    ends = [0] * (len(ranks) - 1)
    stack = [len(ranks) - 1]
    for i in range(len(ranks) - 2, -1, -1):
        while ranks[stack[-1]] > ranks[i]:
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return np.array(ends)


def runs_of(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of ids, in order of start, then period."""
    n = len(ids)
    symbols = np.unique(ids, return_inverse=True)[1].tolist()
    tree, mirror = SuffixTree(symbols), SuffixTree(symbols[::-1])
    begin = np.tile(np.arange(n), 2)
    end = np.concatenate([_lyndon_ends(tree.rank), _lyndon_ends(tree.reversed_rank())])
    # The empty suffix at n shares nothing with any other.
    right = tree.extension(begin, end)
    left = mirror.extension(n - begin, n - end)
    period = end - begin
    length = left + period + right
    found = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
    rows = np.column_stack([begin - left, length, period])[found]
    rows = np.unique(rows, axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_words(words: list[bytes]) -> np.ndarray:
    """(start, length, period) of all runs of a list of words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    found = [runs_of(ids[a:b]) + np.array([a, 0, 0]) for a, b in candidate_regions(ids)]
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge)[:-1] > 0
    return b" ".join([w for w, out in zip(words, gone.tolist()) if not out])


_FIELDS = ["start", "length", "period"]
_ENTRY = pa.struct([(f, pa.int64()) for f in _FIELDS])
_RUNS = ArrayType(StructType([StructField(f, LongType()) for f in _FIELDS]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index("row"))
        counts, sizes, entries, texts = [], [0], [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            words = _WORD.findall((text.as_py() or "").encode())
            runs = runs_of_words(words)
            counts.append(len(words))
            sizes.append(sizes[-1] + len(runs))
            entries.append(runs)
            texts.append((collapsed(words, runs) if len(runs) else b" ".join(words)).decode())
        flat = np.concatenate(entries) if entries else np.zeros((0, 3), dtype=np.int64)
        spans = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], fields=list(_ENTRY))
        runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)
        yield pa.RecordBatch.from_arrays(
            [rows, pa.array(counts, pa.int64()), runs, pa.array(texts, pa.large_string()).cast(pa.string())],
            names=["row", "n_words", "runs", "collapsed"],
        )


def _found(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (the given columns), n_words, runs and collapsed of every document."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    source = docs.select(row.alias("row"), "text")
    schema = source.select("row").schema.add("n_words", "long")
    schema = schema.add("runs", _RUNS).add("collapsed", "string")
    return in_batches(source, _batches, schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text
    (the words that no run holds after its first period, joined by one space) of every row."""
    return _found(docs, ["doc_id"]).select(F.col("row.c0").alias("doc_id"), "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first one of equals; null if none."""
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(
        runs, nothing, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all columns; texts with runs are replaced by their collapsed form."""
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(at["text"])
    return _found(docs, docs.columns).select(*[(text if c == "text" else x).alias(c) for c, x in at.items()])
