"""Mixing sources to target weights by capped water-filling.

Sources share a number of words by weight.  No source may give more than ``max_epochs`` times its
own size; what a clamped source can't take is shared by the others in proportion to their weights
until nobody is above the cap.  Every document is taken a whole number of times, and documents up
to a boundary in a seeded hash order once more; the document at the boundary gives the words that
are still missing, so that the words taken of a source are its target rounded down.

The plan has one row per source.  It comes from sums per source and hash bucket, a table of at
most ``BUCKETS`` rows per source, and from the documents of one bucket per source; no source is
sorted as a whole, and documents are not shuffled.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
source of size 0 has target 0; rows with the same id share the same place in the order and give
equal shares of what their group gives; an empty table gives an empty result.  Only ``doc_id``,
``source`` and ``text`` are read by ``mixture``; ``mixed`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.tables import WORD, keep
from haulmark.sources.sizing import broadcast_if_small

BUCKETS = 4096
SHARE = 1.5
MAX_EPOCHS = 2
WEIGHTS = (5, 2, 1)
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int) -> Column:
    """Seeded place of a document in the order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """Targets of sources (source, weight, source_size); sums of whole numbers are exact."""
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    capped = sizes.select(
        "*",
        (F.col("source_size") * max_epochs).alias("cap"),
        (F.sum("source_size").over(everything) * share).alias("total"),
    )
    tested = capped.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cap_before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    ).withColumn("full", F.col("cap") * F.col("weight_left") <= F.col("weight") * (F.col("total") - F.col("cap_before")))
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    shared = F.col("weight") * (F.col("total") - spent) / open_weight
    return tested.select(
        "source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared).alias("target")
    )


def mixture_plan(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per source of ``sized`` (doc_id, source, size): target, whole epochs and boundary.

    Sources take the weights in turn in order of their names.
    """
    placed = sized.select("source", "size", place(F.col("doc_id"), seed).alias("place"))
    bucket = F.substring("place", 1, 3)
    buckets = keep(placed.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    targets = source_targets(sizes.withColumn("weight", weight), share, max_epochs)
    whole = F.floor(F.floor("target") / F.nullif(F.col("source_size"), F.lit(0)))
    plan = targets.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    # The bucket, and in it the document, where the remaining words run out.
    p, b = plan.alias("p"), buckets.alias("b")
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    cut = (
        b.join(broadcast_if_small(p), F.expr("b.source <=> p.source"))
        .select("b.source", "bucket", "bucket_size", "rest")
        .withColumn("before", before)
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size")))
    )
    inner = F.sum("group_size").over(Window.partitionBy("source").orderBy("place")) - F.col("group_size")
    boundary = (
        placed.withColumn("bucket", bucket).alias("d")
        .join(broadcast_if_small(cut.alias("c")), F.expr("d.source <=> c.source AND d.bucket = c.bucket"))
        .groupBy("d.source", "place", "before", "rest")
        .agg(F.sum("size").alias("group_size"))
        .withColumn("missing", F.col("rest") - F.col("before") - inner)
        .where((F.col("missing") >= 0) & (F.col("missing") < F.col("group_size")))
        .select("source", F.col("place").alias("boundary"), "missing", "group_size")
    )
    q = boundary.alias("q")
    return p.join(broadcast_if_small(q), F.expr("p.source <=> q.source"), "left").select(
        "p.source", "source_size", "target", "whole", "boundary", "missing", "group_size"
    )


def _extra(place_of: Column, size: Column) -> Column:
    """Words that a document gives beyond its whole epochs; without a boundary none are missing."""
    part = F.floor(size * F.col("missing") / F.col("group_size"))
    return (
        F.when(place_of < F.col("boundary"), size)
        .when(place_of == F.col("boundary"), part)
        .otherwise(F.lit(0))
        .cast("long")
    )


def mixture(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken words of every row."""
    sized = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    plan = mixture_plan(sized, seed=seed, **options)
    d = sized.withColumn("place", place(F.col("doc_id"), seed)).alias("d")
    return d.join(broadcast_if_small(plan.alias("p")), F.expr("d.source <=> p.source")).select(
        "doc_id",
        "d.source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + _extra(F.col("place"), F.col("size"))).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them; the last copy may be cut after a word."""
    size = word_count(F.col("text"))
    sized = keep(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    plan = mixture_plan(sized, seed=seed, **options)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = wrapped.withColumn("place", place(F.col("row.doc_id"), seed)).withColumn("size", word_count(F.col("row.text"))).alias("d")
    taken = d.join(broadcast_if_small(plan.alias("p")), F.expr("d.row.source <=> p.source")).select(
        "row", "size", "whole", _extra(F.col("place"), F.col("size")).alias("extra")
    )
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0))
    rows = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"), F.lit(1).cast("long"))))
    rows = rows.where("size = 0 OR whole > 0 OR extra > 0")
    partial = (F.col("copy") > F.col("whole")) & (F.col("extra") < F.col("size"))
    head = F.regexp_extract(F.col("row.text"), r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.split(F.substr(F.col("row.text"), F.length(head) + 1), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, F.col("extra").cast("int"))
    text = F.when(partial, F.array_join(words, "")).otherwise(F.col("row.text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
