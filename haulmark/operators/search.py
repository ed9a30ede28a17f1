"""Keyword search (BM25) and rank fusion for a table of questions over a table of chunks.

Scores follow Robertson & Zaragoza (2009) for BM25 and Cormack et al. (2009) for fusion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions.arrays import tally
from haulmark.functions.ranking import top_n
from haulmark.functions.text import terms
from haulmark.sources.sizing import BROADCAST_ROWS, fresh_path, within

QUERY_TERM_ROWS = 200_000
SALTS = 64


def build_index(chunks: DataFrame, key: str = "chunk_id", text: str = "chunk_text", *carry: str, buckets: int | None = None) -> DataFrame:
    """One row per chunk: key, carried columns, its terms and their number.

    Rows are placed by ``key`` once.  Counting terms per chunk and summing scores per chunk
    later both find a chunk complete inside one partition, so neither shuffles again.
    """
    rows = chunks.select(key, *carry, text)
    placed = rows.repartition(buckets, key) if buckets else rows.repartition(key)
    words = placed.select(key, *carry, terms(F.col(text)).alias("terms"))
    return words.withColumn("n_terms", F.size("terms"))


def store_index(index: DataFrame, key: str, buckets: int, name: str = "search-index") -> DataFrame:
    """Write an index bucketed by ``key`` to the shared folder and return the stored table.

    Built with the same number of buckets, every task writes one bucket, and a search over
    the stored table keeps the placement by ``key``.
    """
    spark = index.sparkSession
    path = fresh_path(spark, name)
    table = "haulmark_" + path.rsplit("/", 1)[-1].replace("-", "_")
    index.write.option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def index_stats(index: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in terms."""
    return index.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("n_terms").alias("avg_terms"))


def postings(index: DataFrame, key: str = "chunk_id", *carry: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """Term frequencies per chunk, of the terms in ``vocabulary`` when one is given."""
    found = tallied(index, key, *carry, "n_terms")
    return found.join(vocabulary, "term", "left_semi") if vocabulary is not None else found


def tallied(index: DataFrame, *keys: str) -> DataFrame:
    """``keys``, term and tf of rows with ``terms``; rows with the same keys count as one.

    Terms are counted inside a row, so what is grouped are texts, not a row for every word.
    """
    held = index.groupBy(*keys).agg(F.flatten(F.collect_list("terms")).alias("_terms"))
    # The outer generator is not pushed into the scan; rows without terms go afterwards.
    spread = held.select(*keys, F.explode_outer(tally(F.col("_terms"), "term", "tf")).alias("_t"))
    return spread.where("_t.term IS NOT NULL").select(*keys, "_t.term", "_t.tf")


def query_terms(queries: DataFrame, question: str = "question", *carry: str) -> DataFrame:
    return queries.select(
        "query_id", *carry, F.explode(F.array_distinct(terms(F.col(question)))).alias("term")
    )


def bm25_search(
    index: DataFrame,
    queries: DataFrame,
    n: int = fv.SEARCH_RESULTS,
    key: str = "chunk_id",
    question: str = "question",
    category: str | None = None,
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
    query_term_rows: int = QUERY_TERM_ROWS,
) -> DataFrame:
    """Best ``n`` chunks per question: query_id, key, score, rank.

    With ``category`` the queries carry ``allowed`` (array of labels, NULL = everything) and
    chunks outside it are dropped before they are scored.

    A set of query terms of counted size is broadcast: a chunk is then scored where it lies
    and only ``n`` rows per question and task are shuffled, however frequent a term is.  A
    larger set is joined on the term plus a salt from the chunk key, so that a frequent term
    is spread over many tasks.
    """
    carry = ["allowed"] if category else []
    wanted = query_terms(queries, question, *carry)
    small = within(wanted, query_term_rows)
    hint = F.broadcast if small else (lambda df: df)

    vocabulary = hint(wanted.select("term").distinct())
    distinct = index.select(F.explode_outer(F.array_distinct("terms")).alias("term"))
    known = distinct.join(vocabulary, "term", "left_semi")
    frequency = known.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = index_stats(index)
    size = stats.select("n_chunks").scalar()
    mean = stats.select("avg_terms").scalar()
    idf = F.log(1 + (size - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.join(frequency, "term").select("query_id", *carry, "term", idf.alias("idf"))

    found = postings(index, key, *([category] if category else []), vocabulary=vocabulary)
    on = ["term"]
    if not small:
        weighted = weighted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        on.append("_salt")
    hits = found.join(hint(weighted), on)
    if category:
        hits = hits.where(F.col("allowed").isNull() | F.array_contains("allowed", F.col(category)))
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_terms") / mean))
    scored = hits.groupBy("query_id", key).agg(F.round(F.sum(part), 4).alias("score"))
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc(key)], n)


def fuse(rankings: list[DataFrame], key: str, n: int = fv.SEARCH_RESULTS, constant: int = fv.RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of several rankings with query_id, key and rank."""
    votes = None
    for ranking in rankings:
        vote = ranking.select("query_id", key, (1.0 / (constant + F.col("rank"))).alias("_vote"))
        votes = vote if votes is None else votes.unionByName(vote)
    fused = votes.groupBy("query_id", key).agg(F.round(F.sum("_vote"), 6).alias("score"))
    return top_n(fused, ["query_id"], [F.desc("score"), F.asc(key)], n)


def select_context(
    hits: DataFrame,
    threshold: float = fv.SIMILARITY_THRESHOLD,
    fallback: int = fv.CONTEXT_MIN,
    cap: int = fv.CONTEXT_MAX,
) -> DataFrame:
    """Hits at or above the threshold, or the first ``fallback`` when there are none; ``cap`` at most."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("_best"))
    both = hits.join(best, "query_id")
    keep = F.when(F.col("_best") >= threshold, F.col("score") >= threshold).otherwise(
        F.col("rank") <= fallback
    )
    kept = both.where(keep).drop("_best")
    return top_n(kept, ["query_id"], [F.asc("rank")], cap, "source_no")


def context_text(selected: DataFrame) -> DataFrame:
    """One context block per question from at most ``CONTEXT_MAX`` selected chunks."""
    name = F.when(F.length("source_path") > 0, F.element_at(F.split("source_path", "/"), -1)).otherwise("unknown")
    block = F.concat(
        F.lit("### Source "),
        F.col("source_no").cast("string"),
        F.lit(": "),
        name,
        F.lit(" ("),
        "category",
        F.lit(")\n"),
        "chunk_text",
    )
    gathered = selected.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("source_no", block.alias("block")))).alias("_b")
    )
    return gathered.select(
        "query_id",
        F.concat(
            F.lit("## Retrieved Context\n\n\n"),
            F.array_join(F.transform("_b", lambda s: s["block"]), "\n\n"),
        ).alias("context"),
    )


def hits_hint(max_hits: int | None):
    """Broadcast hits only when the caller knows how many there can be (questions times n)."""
    return F.broadcast if max_hits is not None and max_hits <= BROADCAST_ROWS else (lambda df: df)


def with_details(hits: DataFrame, chunks: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Hits with text, category and path of their chunk; the chunk table is only scanned."""
    details = chunks.select("chunk_id", "chunk_text", "category", "source_path")
    return details.join(hits_hint(max_hits)(hits), "chunk_id")


def expand_to_parents(hits: DataFrame, chunks: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Parent chunks of child hits, each once per question with its best child score."""
    hint = hits_hint(max_hits)
    children = chunks.where(F.col("chunk_type") == "child").select("chunk_id", "parent_id")
    best = (
        children.join(hint(hits), "chunk_id")
        .groupBy("query_id", "parent_id")
        .agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_children"))
    )
    parents = chunks.where(F.col("chunk_type") == "parent").select(
        F.col("chunk_id").alias("parent_id"), F.col("chunk_text").alias("parent_text"), "category", "source_path"
    )
    return parents.join(hint(best), "parent_id")


def similar_documents(
    hits: DataFrame, excluded: list[str], n: int = 3, snippet: int = 100
) -> DataFrame:
    """Best chunk per source document outside the excluded categories, ``n`` per question.

    Hits carry score, source_path, category and chunk_text.
    """
    from haulmark.functions.text import display_name, strip

    file_name = F.element_at(F.split(F.rtrim("source_path", F.lit("/")), "/"), -1)
    stem = F.regexp_replace(file_name, r"\.[^.]*\z", "")
    named = (
        hits.where(~F.lower(F.trim("category")).isin([c.lower() for c in excluded]))
        .withColumn("source", file_name)
        .withColumn("stem", stem)
        .where(F.length("stem") > 0)
    )
    best = top_n(named, ["query_id", "stem"], [F.desc("score"), F.asc("chunk_id")], 1, "_one").drop("_one", "rank")
    first = top_n(best, ["query_id"], [F.desc("score"), F.asc("stem")], n)
    text = F.concat(
        F.rtrim(strip(F.substring("chunk_text", 1, snippet)), F.lit(".")), F.lit("…")
    )
    return first.select(
        "query_id",
        "rank",
        display_name(F.col("stem")).alias("company"),
        "source",
        "category",
        F.when(F.length("chunk_text") > 0, text).otherwise("").alias("snippet"),
        F.least((F.col("score") * 100).cast("long"), F.lit(99)).alias("similarity"),
    )


def precision_at_k(hits: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """Share of relevant hits in the first ``k`` and whether any is relevant, per question."""
    first = hits.where(F.col("rank") <= k)
    marked = first.join(relevant.select(key).distinct().withColumn("_rel", F.lit(1)), key, "left")
    rel = F.sum(F.coalesce("_rel", F.lit(0)))
    return marked.groupBy("query_id").agg(
        F.round(rel / F.count(F.lit(1)), 4).alias("precision"), (rel > 0).alias("any_hit")
    )
