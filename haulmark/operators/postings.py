"""Term-addressable keyword index: postings by term, refreshed by deletes and adds.

An index is a folder of four tables:

``postings``  lists: a term, the chunks of a block that hold it (``keys``, and in the same order
              ``each_tf`` and ``each_size``, their numbers of terms), ``n_rows`` added with it, its ``n_uses``,
              block and segment; partitioned by category and by a hash of the term (``part``) and
              sorted by term inside a file
``terms``     changes of the document frequency of terms, partitioned by ``part``
``gone``      keys that a segment deleted; postings of earlier segments don't count for them
``segments``  one row per build or refresh, written last, with changes of the chunk and term
              counts; a segment without its row was interrupted and is passed over

A block is some chunks that were counted together, so all postings of a chunk in a segment lie in
one block, and what is shuffled and sorted are lists, not a row for every posting.

A search reads the parts of its terms and the categories it may see, nothing else.  A refresh
costs as much as the changed chunks and rewrites nothing; ``compacted`` writes the live rows as a
new index of one segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark import fixed_values as fv
from haulmark.functions.arrays import tally
from haulmark.functions.ranking import top_n
from haulmark.functions.text import terms
from haulmark.operators.search import QUERY_TERM_ROWS, SALTS, query_terms, tallied
from haulmark.sources.sizing import broadcast_if_small, fresh_path, materialize, within

PARTS = 32

# Words of a block; a larger chunk has a block of its own.
_BLOCK_WORDS = 1 << 22
# Blocks are numbered by segment, task and place in the task.
_TASK_BITS, _SEGMENT_BITS = 24, 44

# Scores and hits that a task of a search holds at a time.
_CELLS = 1 << 21
_HITS = 1 << 20


@dataclass(frozen=True)
class Postings:
    """Where an index lies, what identifies a chunk, and into how many parts terms are dealt."""

    spark: SparkSession
    path: str
    key: str
    key_type: str
    parts: int

    def read(self, name: str) -> DataFrame:
        """A table of the index; the types of folder names are not left to inference."""
        key = f"`{self.key}` {self.key_type}"
        columns = {
            "postings": f"{_lists_of(self.key_type)}, segment long, part int",
            "terms": "term string, df long, segment long, part int",
            "gone": f"{key}, segment long",
            "segments": "segment long, n_chunks long, n_terms long",
        }
        df = self.spark.read.schema(columns[name]).parquet(f"{self.path}/{name}")
        # An empty folder name comes back as null.
        return df.withColumn("category", F.coalesce("category", F.lit(""))) if name == "postings" else df

    def segments(self) -> list[int]:
        """Numbers of the finished segments; one a refresh, so a short list."""
        return sorted(r.segment for r in self.read("segments").select("segment").collect())

    def part_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")


def _words(chunks: DataFrame, key: str, text: str, category: str | None, placed: bool = False) -> DataFrame:
    """key, category, terms and n_terms; ``placed`` by key, for which the texts travel, not their terms."""
    label = F.coalesce(F.col(category), F.lit("")) if category else F.lit("")
    rows = chunks.select(key, label.alias("category"), F.col(text).alias("_text"))
    found = F.coalesce(terms(F.col("_text")), F.array().cast("array<string>"))
    return (rows.repartition(key) if placed else rows).select(key, "category", found.alias("terms")).withColumn("n_terms", F.size("terms"))


def _counts(words: DataFrame, key: str, rows: bool = False) -> DataFrame:
    """key, category, n_terms, term and tf, of rows with the same first three together; ``rows``: how many of them hold the term."""
    carry = [key, "category", "n_terms"]
    if not rows:
        return tallied(words, *carry).select(*carry, "term", "tf")
    # Both tallies are of the same terms in the same order.
    both = F.arrays_zip(tally(F.col("terms"), "term", "tf").alias("a"), tally(F.col("held"), "term", "rows").alias("b"))
    return _gathered(words, key).select(*carry, F.explode_outer(both).alias("_t")).where("_t.a.term IS NOT NULL").select(*carry, "_t.a.term", "_t.a.tf", "_t.b.rows")


def _gathered(words: DataFrame, key: str) -> DataFrame:
    """Rows with the same key, category and n_terms together: all ``terms``, and ``held``, those of a row once each."""
    return words.groupBy(key, "category", "n_terms").agg(
        F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list(F.array_distinct("terms"))).alias("held")
    )


def _posted(chunks: DataFrame, key: str, text: str, category: str | None) -> DataFrame:
    """Lists of postings.  A chunk is counted where it lies; only rows whose key (by its hash)
    occurs again travel to be counted together."""
    place = F.xxhash64(key)
    repeated = materialize(chunks.groupBy(place.alias("_place")).count().where("count > 1").select("_place"), "repeated-keys")

    def together(df: DataFrame) -> DataFrame:
        # Sorted, so that a block ends between two keys.
        return _listed(_gathered(_words(df, key, text, category, placed=True), key).repartition(key).sortWithinPartitions(key), key)

    if not within(repeated):
        return together(chunks)
    single, again = chunks, None
    if not repeated.isEmpty():
        known = F.broadcast(repeated)
        single = chunks.join(known, place == known["_place"], "left_anti")
        again = chunks.join(known, place == known["_place"], "left_semi")
    posted = _listed(_words(single, key, text, category).withColumn("held", F.lit(None).cast("array<string>")), key)
    return posted if again is None else posted.unionByName(together(again))


def _lists_of(key_type: str) -> str:
    return f"term string, category string, keys array<{key_type}>, each_tf array<int>, each_size array<int>, n_rows long, n_uses long, block long"


def _listed(words: DataFrame, key: str) -> DataFrame:
    """Lists of postings of key, category, n_terms, terms and held; without held, every term counts one row.

    Blocks are counted as arrays of numbers, and never part rows with the same key one after another.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            before = np.concatenate([[0], np.cumsum(pc.list_value_length(table.column("terms")).to_numpy())])
            starts, begin = np.flatnonzero(_changes(table.column("key").combine_chunks())), 0
            while (i := np.searchsorted(before[starts], before[begin] + _BLOCK_WORDS)) < len(starts):
                yield table.slice(begin, starts[i] - begin)
                begin = int(starts[i])
            rest = table.slice(begin)
        if rest is not None:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << _TASK_BITS
        for number, table in enumerate(blocks(batches)):
            n, lists = table.num_rows, table.column("terms").combine_chunks()
            found = lists.flatten().dictionary_encode()
            vocabulary = found.dictionary
            if not len(vocabulary):
                continue
            labels = table.column("category").combine_chunks().dictionary_encode()
            label = labels.indices.to_numpy().astype(np.int64)

            def tallied(arrays: pa.ListArray, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
                row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(arrays), 0).to_numpy())
                return np.unique((label[row] * len(vocabulary) + codes.to_numpy()) * n + row, return_counts=True)

            cells, tf = tallied(lists, found.indices)
            row, group = cells % n, cells // n
            rows, held = np.ones(len(cells), np.int64), table.column("held").combine_chunks()
            several = held.is_valid().to_numpy(zero_copy_only=False)
            if several.any():
                # The same terms of a row in the same order.
                rows[several[row]] = tallied(held, pc.index_in(held.flatten(), value_set=vocabulary))[1]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            ends = pa.array(np.append(first, len(cells)), pa.int32())
            size = table.column("n_terms").to_numpy()[row]
            columns = {
                "term": vocabulary.take(pa.array(group[first] % len(vocabulary))),
                "category": labels.dictionary.take(pa.array(group[first] // len(vocabulary))),
                "keys": pa.ListArray.from_arrays(ends, table.column("key").combine_chunks().take(pa.array(row))),
                "each_tf": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
                "each_size": pa.ListArray.from_arrays(ends, pa.array(size, pa.int32())),
                "n_rows": pa.array(np.add.reduceat(rows, first)),
                "n_uses": pa.array(np.add.reduceat(tf, first)),
                "block": pa.array(np.full(len(first), task + number)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = words.select(F.col(key).alias("key"), "category", "n_terms", "terms", "held")
    return rows.mapInArrow(run, _lists_of(dict(words.dtypes)[key]))


def _append(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _add_segment(index: Postings, segment: int, posted: DataFrame, n_added: int, removed: DataFrame | None) -> None:
    """Write one segment from the postings of added chunks and the words of removed ones.

    Texts are split into words once: frequencies and sizes are summed from the written postings.
    """
    spark, number = index.spark, F.lit(segment).cast("long")
    posted = posted.withColumn("part", index.part_of(F.col("term"))).withColumn("segment", number)
    posted = posted.withColumn("block", F.col("block") + (segment << _SEGMENT_BITS))
    # Rebalancing splits a large part over several files and puts small ones together.
    dealt = posted.hint("rebalance", "category", "part").sortWithinPartitions("category", "part", "term")
    _append(dealt, f"{index.path}/postings", "category", "part")
    stored = spark.read.schema("term string, n_rows long, n_uses long, segment long, part int").parquet(f"{index.path}/postings")
    stored = stored.where(F.col("segment") == segment)
    changed = stored.groupBy("part", "term").agg(F.sum("n_rows").alias("df"))
    n_chunks, n_terms = n_added, stored.agg(F.sum("n_uses")).first()[0] or 0
    if removed is not None:
        _append(removed.select(index.key, number.alias("segment")).distinct(), f"{index.path}/gone")
        lost = removed.select(F.explode_outer(F.array_distinct("terms")).alias("term")).where("term IS NOT NULL").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        changed = changed.unionByName(lost.select(index.part_of(F.col("term")).alias("part"), "term", "df")).groupBy("part", "term").agg(F.sum("df").alias("df"))
        row = removed.agg(F.count(F.lit(1)), F.sum("n_terms")).first()
        n_chunks, n_terms = n_chunks - row[0], n_terms - (row[1] or 0)
    changed = changed.where("df <> 0").withColumn("segment", number)
    _append(changed.hint("rebalance", "part").sortWithinPartitions("part", "term"), f"{index.path}/terms", "part")
    _append(spark.createDataFrame([(segment, n_chunks, n_terms)], "segment long, n_chunks long, n_terms long"), f"{index.path}/segments")


def build(
    chunks: DataFrame, key: str = "chunk_id", text: str = "chunk_text", category: str | None = None, parts: int = PARTS, name: str = "postings"
) -> Postings:
    """Index of all chunks, written to the shared folder."""
    spark = chunks.sparkSession
    index = Postings(spark, fresh_path(spark, name), key, dict(chunks.dtypes)[key], parts)
    # Nothing is deleted yet; the empty table gives the folder its columns.
    _append(chunks.select(key, F.lit(0).cast("long").alias("segment")).limit(0), f"{index.path}/gone")
    _add_segment(index, 0, _posted(chunks, key, text, category), chunks.count(), None)
    return index


def refresh(index: Postings, removed: DataFrame, added: DataFrame, text: str = "chunk_text", category: str | None = None) -> Postings:
    """Take ``removed`` chunks (with the text they were indexed by) out and ``added`` ones in.

    An updated chunk is in both: a key the index holds is never only added, since a search sums the
    postings of a key in one segment.  The frames are the deletes and adds of a change feed.
    """
    # The number of an interrupted segment is not used again.
    begun = index.read("postings").agg(F.max("segment")).first()[0] or 0
    segment = max(index.segments()[-1], begun) + 1
    known = (index.key, text, category)
    _add_segment(index, segment, _posted(added, *known), added.count(), _words(removed, *known))
    return index


def _live_lists(index: Postings, wanted: Column | None = None) -> DataFrame:
    """Lists of the finished segments; they may hold keys that are gone."""
    found = index.read("postings").where(F.col("segment").isin(index.segments()))
    return found if wanted is None else found.where(wanted)


def _live_rows(index: Postings, lists: DataFrame) -> DataFrame:
    """``lists`` with a row for every posting that is not gone: key, tf and n_terms instead of the arrays."""
    carry = [c for c in lists.columns if c not in ("keys", "each_tf", "each_size")]
    zipped = F.arrays_zip(F.col("keys"), F.col("each_tf"), F.col("each_size"))
    rows = lists.select(*carry, F.explode_outer(zipped).alias("_p")).select(
        *carry, F.col("_p.keys").alias(index.key), F.col("_p.each_tf").cast("long").alias("tf"), F.col("_p.each_size").alias("n_terms")
    )
    done = index.segments()
    if len(done) == 1:
        return rows
    gone = index.read("gone").where(F.col("segment").isin(done)).groupBy(index.key).agg(F.max("segment").alias("_gone"))
    gone = broadcast_if_small(gone)
    return rows.join(gone, (rows[index.key] == gone[index.key]) & (F.col("segment") < F.col("_gone")), "left_anti")


def live_postings(index: Postings, wanted: Column | None = None) -> DataFrame:
    """category, part, term, key, tf and n_terms of the chunks that the index holds now."""
    return _live_rows(index, _live_lists(index, wanted).drop("n_rows", "n_uses", "block")).drop("segment")


def frequencies(index: Postings, wanted: Column | None = None) -> DataFrame:
    """term and df (chunks that hold it), from the stored frequencies."""
    rows = index.read("terms").where(F.col("segment").isin(index.segments()))
    rows = rows.where(wanted) if wanted is not None else rows
    return rows.groupBy("part", "term").agg(F.sum("df").alias("df")).where("df > 0").select("term", "df")


def sizes(index: Postings) -> tuple[int, int]:
    """Number of chunks and of terms in all of them."""
    row = index.read("segments").agg(F.sum("n_chunks"), F.sum("n_terms")).first()
    return row[0] or 0, row[1] or 0


def compacted(index: Postings, name: str = "postings") -> Postings:
    """A new index of one segment with the live rows of ``index``."""
    new = Postings(index.spark, fresh_path(index.spark, name), index.key, index.key_type, index.parts)
    zero = F.lit(0).cast("long")
    rows = _live_rows(index, _live_lists(index).drop("n_rows", "n_uses"))
    # Frequencies are copied, so n_rows is not needed again.
    lists = rows.groupBy("category", "part", "term", "block").agg(
        F.collect_list(F.struct(index.key, F.col("tf").cast("int").alias("tf"), "n_terms")).alias("_p"), F.sum("tf").alias("n_uses")
    )
    part_of = lambda name: F.transform("_p", lambda p: p[name])
    lists = lists.select(
        "category", "part", "term", "block", "n_uses", part_of(index.key).alias("keys"), part_of("tf").alias("each_tf"), part_of("n_terms").alias("each_size")
    )
    rows = lists.withColumn("n_rows", F.lit(None).cast("long")).withColumn("segment", zero).hint("rebalance", "category", "part")
    _append(rows.sortWithinPartitions("category", "part", "term"), f"{new.path}/postings", "category", "part")
    known = frequencies(index).withColumn("part", index.part_of(F.col("term"))).withColumn("segment", zero)
    _append(known.hint("rebalance", "part").sortWithinPartitions("part", "term"), f"{new.path}/terms", "part")
    _append(index.read("gone").limit(0), f"{new.path}/gone")
    n_chunks, n_terms = sizes(index)
    _append(index.spark.createDataFrame([(0, n_chunks, n_terms)], "segment long, n_chunks long, n_terms long"), f"{new.path}/segments")
    return new


def _visible(queries: DataFrame, allowed: str) -> Column | None:
    """Categories that any of the queries may see; None when one of them may see all."""
    # One row per different policy entry.
    lists = [r[0] for r in queries.select(allowed).distinct().collect()]
    if any(labels is None for labels in lists):
        return None
    return F.col("category").isin(sorted({label for labels in lists for label in labels}))


def search(
    index: Postings,
    queries: DataFrame,
    n: int = fv.SEARCH_RESULTS,
    question: str = "question",
    allowed: str | None = None,
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
    query_term_rows: int = QUERY_TERM_ROWS,
) -> DataFrame:
    """Best ``n`` chunks per question by BM25: query_id, key, score, rank.

    Only the parts of the questions' terms are read.  With ``allowed`` (an array of categories of
    every question, null = all) postings of other categories are dropped before chunks are scored
    or ranked, and categories that no question may see are not read.  Lists travel once, to the
    task of their block; there they meet the questions and are summed by chunk.
    """
    carry = [allowed] if allowed else []
    wanted = query_terms(queries, question, *carry)
    # At most ``parts`` numbers.
    parts = sorted(r[0] for r in wanted.select(index.part_of(F.col("term"))).distinct().collect())
    read = F.col("part").isin(parts)
    small = within(wanted, query_term_rows)
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = hint(wanted.select("term").distinct())
    n_chunks, n_terms = sizes(index)
    mean = n_terms / n_chunks if n_chunks else 1.0
    known = frequencies(index, read).join(vocabulary, "term", "left_semi")
    idf = F.log(1 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.join(hint(known) if small else known, "term").select("query_id", *carry, "term", idf.alias("idf"))

    seen = _visible(queries, allowed) if allowed else None
    read = read if seen is None else read & seen
    if small:
        scored = _scored_in_tasks(index, read, weighted, n, allowed, k1, b, mean)
    else:
        weighted = weighted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = live_postings(index, read).join(vocabulary, "term", "left_semi").withColumn("_salt", F.pmod(F.xxhash64(index.key), F.lit(SALTS)).cast("int"))
        hits = found.join(weighted, ["term", "_salt"])
        if allowed:
            hits = hits.where(F.col(allowed).isNull() | F.array_contains(allowed, F.col("category")))
        tf = F.col("tf").cast("double")
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_terms") / mean))
        scored = hits.groupBy("query_id", index.key).agg(F.round(F.sum(F.col("idf") * share), 4).alias("score"))
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc(index.key)], n)


def _scored_in_tasks(index: Postings, read: Column, weighted: DataFrame, n: int, allowed: str | None, k1: float, b: float, mean: float) -> DataFrame:
    """query_id, key and score of the chunks that can be among the best ``n`` of a question.

    ``weighted`` has a counted, small number of rows.  The lists of a block lie together, so a task
    sums the scores of some of its chunks at a time, in order of their keys, for all questions, and
    only passes on those that ``n`` chunks of the block with smaller keys don't equal or beat, nor
    ``n`` chunks of other blocks beat: pairs of chunks and questions are never rows.
    """
    spark, key = index.spark, index.key
    rows = weighted.orderBy("term").collect()
    vocabulary = sorted({r.term for r in rows})
    number = {term: i for i, term in enumerate(vocabulary)}
    questions = {q: i for i, q in enumerate(dict.fromkeys(r.query_id for r in rows))}
    policies = {p: i for i, p in enumerate(dict.fromkeys(_policy(r, allowed) for r in rows))}
    term_of = np.array([number[r.term] for r in rows], np.int64)
    starts = np.searchsorted(term_of, np.arange(len(vocabulary) + 1))
    question_of = np.array([questions[r.query_id] for r in rows], np.int64)
    idf = np.array([r.idf for r in rows], np.float64)
    policy_of = np.array([policies[_policy(r, allowed)] for r in rows], np.int64)
    n_questions, seen = len(questions), list(policies)
    masked = any(p is not None for p in seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The best scores of all blocks before.
        beaten = np.full((n_questions, n), -np.inf)

        def emitted(part: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal beaten
            best = np.full((n_questions, n), -np.inf)
            lists = part.column("keys").combine_chunks()
            found = lists.flatten().dictionary_encode(null_encoding="encode")
            # In the order of Spark, null first.
            ranked = pc.array_sort_indices(found.dictionary, null_placement="at_start")
            keys, rank = found.dictionary.take(ranked), np.empty(len(ranked), np.int64)
            rank[ranked.to_numpy()] = np.arange(len(ranked))
            chunk = rank[found.indices.to_numpy()]
            order = np.argsort(chunk, kind="stable")
            chunk = chunk[order]
            first = np.searchsorted(chunk, np.arange(len(keys)))
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())[order]
            term = part.column("term_no").to_numpy()[row]
            tf = part.column("each_tf").combine_chunks().flatten().to_numpy()[order].astype(np.float64)
            size = part.column("each_size").combine_chunks().flatten().to_numpy()[order]
            share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
            if masked:
                labels = part.column("category").combine_chunks().dictionary_encode()
                sees = np.array([[p is None or c in p for p in seen] for c in labels.dictionary.to_pylist()], bool)
                label = labels.indices.to_numpy()[row]
            # Some chunks at a time, so that neither the scores nor the hits take much memory.
            hits = np.concatenate([[0], np.cumsum(starts[term + 1] - starts[term])])
            ends, begin = np.append(first, len(term)), 0
            while begin < len(first):
                room = np.searchsorted(hits[ends], hits[ends[begin]] + _HITS, side="right") - 1
                end = max(begin + 1, min(int(room), begin + max(1, _CELLS // max(1, n_questions)), len(first)))
                rows = slice(ends[begin], ends[end])
                sizes = starts[term[rows] + 1] - starts[term[rows]]
                posting = np.repeat(np.arange(rows.start, rows.stop), sizes)
                place = np.arange(len(posting)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[term[posting]]
                if masked:
                    kept = sees[label[posting], policy_of[place]]
                    posting, place = posting[kept], place[kept]
                cell = question_of[place] * (end - begin) + chunk[posting] - begin
                score = np.bincount(cell, idf[place] * share[posting], n_questions * (end - begin)).reshape(n_questions, -1)
                hit = score > 0
                score = np.floor(score * 1e4 + 0.5) / 1e4
                q, c = np.nonzero(hit & (score > best[:, -1:]) & (score >= beaten[:, -1:]))
                value = score[q, c]
                order = np.lexsort((c, -value, q))
                q, c, value = q[order], c[order], value[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, c, value = q[rank < n], c[rank < n], value[rank < n]
                for asked in np.unique(q):
                    best[asked] = -np.sort(-np.concatenate([best[asked], value[q == asked]]))[:n]
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q), keys.take(pa.array(begin + c)), pa.array(value)], names=["_q", key, "score"])
                begin = end
            beaten = -np.sort(-np.concatenate([beaten, best], axis=1), axis=1)[:, :n]

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # The last block of a batch may go on in the next one.
            first = np.flatnonzero(_changes(table.column("block").combine_chunks()))
            for begin, end in zip(first[:-1], first[1:], strict=True):
                yield from emitted(table.slice(begin, end - begin))
            held = table.slice(first[-1]) if len(first) else None
        if held is not None:
            yield from emitted(held)

    numbers = spark.createDataFrame(list(number.items()), "term string, term_no long")
    arrays = ["keys", "each_tf", "each_size"]
    carry = ["block", *(["category"] if masked else []), "term_no"]
    met = _live_lists(index, read).join(F.broadcast(numbers), "term").select(*carry, *arrays, "segment")
    if len(index.segments()) > 1:
        each = [F.col(key), F.col("tf").cast("int"), F.col("n_terms")]
        met = _live_rows(index, met).select(*carry, *[F.array(c).alias(a) for c, a in zip(each, arrays, strict=True)])
    met = met.drop("segment").repartition("block").sortWithinPartitions("block")
    scored = met.mapInArrow(run, f"_q long, `{key}` {index.key_type}, score double")
    schema = T.StructType([T.StructField("_q", T.LongType()), weighted.schema["query_id"]])
    named = spark.createDataFrame([(i, q) for q, i in questions.items()], schema)
    return scored.join(F.broadcast(named), "_q").drop("_q")


def _policy(row: Row, allowed: str | None) -> frozenset[str] | None:
    return frozenset(row[allowed]) if allowed and row[allowed] is not None else None


def _changes(keys: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; null equals null."""
    a, b = keys[1:], keys[:-1]
    same = pc.if_else(pc.and_(a.is_null(), b.is_null()), True, pc.fill_null(pc.equal(a, b), False))
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False).astype(bool)]) if len(keys) else np.zeros(0, bool)
