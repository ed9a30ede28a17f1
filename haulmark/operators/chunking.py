"""Parent and child chunks of documents, computed row by row without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv
from haulmark.functions import text as tx
from haulmark.functions.arrays import running_starts


def _placed_sections(docs: DataFrame, keys: list[str], text_col: str, size: int, overlap: int):
    """One row per non-blank section: number, text, emitted offset and true offset."""
    cut = docs.where(tx.has_text(F.col(text_col))).select(
        *keys, tx.sections(F.col(text_col)).alias("_raw")
    )
    # Only the piece before the first header can be blank.
    blank = ~tx.has_text(F.col("_raw")[0])
    kept = cut.select(
        *keys,
        F.when(blank, F.slice("_raw", 2, F.greatest(F.size("_raw") - 1, F.lit(0))))
        .otherwise(F.col("_raw"))
        .alias("_sections"),
        F.when(blank, F.length(F.col("_raw")[0]) + 1).otherwise(0).cast("long").alias("_lead"),
    )
    emitted = lambda s: F.length(s) + (tx.window_count(F.length(s), size, overlap) - 1) * overlap
    placed = kept.select(
        *keys,
        "_sections",
        "_lead",
        running_starts(F.transform("_sections", emitted)).alias("_emitted"),
        running_starts(F.transform("_sections", lambda s: F.length(s) + 1)).alias("_place"),
    ).select(
        *keys,
        "_lead",
        F.arrays_zip("_sections", F.slice("_emitted", 1, F.size("_sections")).alias("_emitted"),
                     F.slice("_place", 1, F.size("_sections")).alias("_place")).alias("_zip"),
    )
    # The arrays are never empty.  The outer form keeps the optimizer from pushing a
    # "size > 0" filter, and with it the whole text expression, down to the scan.
    return placed.select(*keys, "_lead", F.posexplode_outer("_zip").alias("section_no", "_s")).select(
        *keys,
        "section_no",
        F.col("_s._sections").alias("section_text"),
        F.col("_s._emitted").alias("char_start"),
        (F.col("_s._place") + F.col("_lead")).alias("true_start"),
    )


def split_sections(docs: DataFrame, text_col: str = "parsed_text") -> DataFrame:
    """One row per non-blank section with its place in the document."""
    keys = [c for c in docs.columns if c != text_col]
    return _placed_sections(docs, keys, text_col, fv.PARENT_SIZE, 0).drop("char_start")


def chunk_documents(
    docs: DataFrame,
    parent_size: int = fv.PARENT_SIZE,
    child_size: int = fv.CHILD_SIZE,
    overlap: int = fv.OVERLAP,
    text_col: str = "parsed_text",
) -> DataFrame:
    """Parent chunks and their child chunks for every document.

    ``char_start`` and ``char_end`` count emitted characters: the newlines between sections
    are not counted and overlaps are counted twice, so they drift from the document;
    ``true_start`` is the place of the unstripped child (or parent) in the document itself.  Ids are built from
    the document id and positions, so a second run gives the same ids.
    """
    if child_size >= parent_size:
        raise ValueError("child_size must be smaller than parent_size")
    if overlap >= child_size:
        raise ValueError("overlap must be smaller than child_size")
    parent_overlap = overlap // 2
    parent_step, child_step = parent_size - parent_overlap, child_size - overlap
    keys = ["doc_id", "category", "source_path"]

    windows = _placed_sections(docs, keys, text_col, parent_size, parent_overlap).select(
        *keys,
        F.col("section_no").alias("_sn"),
        F.col("char_start").alias("_emitted"),
        F.col("true_start").alias("_place"),
        F.posexplode_outer(tx.slide(F.col("section_text"), parent_size, parent_overlap)).alias(
            "_wn", "_piece"
        ),
    )
    parents = windows.select(
        *keys,
        F.concat(F.lit("P-"), "doc_id", F.lit("-"), "_sn", F.lit("-"), "_wn").alias("_pid"),
        tx.strip(F.col("_piece")).alias("_text"),
        (F.col("_emitted") + F.col("_wn") * parent_size).alias("_start"),
        F.length("_piece").alias("_raw_length"),
        (F.col("_place") + F.col("_wn") * parent_step).alias("_true"),
        tx.indent(F.col("_piece")).alias("_indent"),
    )
    with_children = parents.select(
        *keys,
        "_pid",
        "_text",
        "_start",
        "_raw_length",
        "_true",
        "_indent",
        tx.slide(F.col("_text"), child_size, overlap).alias("_children"),
    )

    def row(chunk_id, parent_id, kind, text, start, end, place):
        return F.struct(
            chunk_id.alias("chunk_id"),
            parent_id.cast("string").alias("parent_id"),
            F.lit(kind).alias("chunk_type"),
            text.alias("chunk_text"),
            start.cast("long").alias("char_start"),
            end.cast("long").alias("char_end"),
            place.cast("long").alias("true_start"),
        )

    parent_row = row(
        F.col("_pid"),
        F.lit(None),
        "parent",
        F.col("_text"),
        F.col("_start"),
        F.col("_start") + F.col("_raw_length"),
        F.col("_true"),
    )
    child_rows = F.transform(
        "_children",
        lambda t, k: row(
            F.concat(F.lit("C-"), F.col("_pid"), F.lit("-"), k.cast("string")),
            F.col("_pid"),
            "child",
            tx.strip(t),
            F.col("_start") + k * child_step,
            F.col("_start") + k * child_step + F.length(t),
            F.col("_true") + F.col("_indent") + k * child_step,
        ),
    )
    return with_children.select(
        *keys, F.explode_outer(F.concat(F.array(parent_row), child_rows)).alias("_c")
    ).select(
        "_c.chunk_id",
        "_c.parent_id",
        "_c.chunk_type",
        "_c.chunk_text",
        *keys,
        "_c.char_start",
        "_c.char_end",
        "_c.true_start",
    )


def sync_chunks(stored: DataFrame, docs: DataFrame, changes: DataFrame, **sizes: int) -> DataFrame:
    """Chunk table after a change feed (doc_id, change): only changed documents are chunked."""
    stale = changes.where(F.col("change") != "insert").select("doc_id")
    fresh = docs.join(changes.where(F.col("change") != "delete").select("doc_id"), "doc_id", "left_semi")
    return stored.join(stale, "doc_id", "left_anti").unionByName(chunk_documents(fresh, **sizes))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type", "category").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.length("chunk_text")).alias("n_chars"),
        F.avg(F.length("chunk_text")).alias("avg_chars"),
    )


def document_statistics(docs: DataFrame, text_col: str = "parsed_text") -> DataFrame:
    size = F.length(text_col)
    return docs.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.avg(size).alias("avg_chars"),
        F.sum(F.when(F.col(text_col).isNull() | (size == 0), 1).otherwise(0)).alias("n_empty"),
    )
