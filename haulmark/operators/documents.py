"""From files or parsed elements to the parsed document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark import fixed_values as fv

ELEMENTS = "struct<document:struct<elements:array<struct<content:string>>,pages:array<struct<id:int>>>>"


def category_label(category_id: Column, labels: dict[str, str] | None = None) -> Column:
    """Label of a category folder; an unknown folder keeps its own name."""
    pairs = [F.lit(v) for kv in (labels or fv.CATEGORY_LABELS).items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category_id), category_id)


def path_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    """Document id, file name and category folder taken from the path."""
    parts = F.split(F.col(path), "/", -1)
    return df.withColumns(
        {
            "doc_id": F.sha2(F.col(path), 256),
            "file_name": F.try_element_at(parts, F.lit(-1)),
            "category_id": F.try_element_at(parts, F.lit(-2)),
        }
    ).withColumn("category", category_label(F.col("category_id")))


def flatten_elements(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Text and page count of a parsed document held as JSON."""
    keys = [c for c in df.columns if c != parsed]
    tree = df.select(*keys, F.from_json(F.col(parsed), ELEMENTS).alias("_tree"))
    contents = F.transform("_tree.document.elements", lambda e: e["content"])
    return tree.select(
        *keys,
        F.concat_ws("\n", contents).alias("parsed_text"),
        F.size("_tree.document.pages").alias("page_count"),
    )


def with_content_hash(df: DataFrame, content: str = "parsed_text") -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.col(content), 256))
