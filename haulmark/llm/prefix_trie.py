"""Conversation prefix trie: which conversations begin with the same turns, and what sharing saves.

Every conversation is a path of prefix digests (128 bits, chained over its turns).  A count-min
sketch of all digests is made first: it never counts too little, so an estimate of one proves that
a prefix belongs to a single conversation, and with it all longer ones.  Such tails become nodes
where they lie; only prefixes that may be shared are shuffled by digest and grouped exactly.  A
full sketch proves less and shuffles more, the result stays the same.

Sums over subtrees need neither the tree's order nor a walk over its levels.  A node belongs to its
smallest member; the nodes that belong to a conversation are the lower part of its path, from
``owned_from`` on.  So the distinct nodes below any node are counted once by adding up, over the
members, the part of the path that they own.

Turns go through Python sorted and in a stream, one digest at a time, so a conversation of any
length takes constant memory; groups are only counted and summed, before the shuffle too.  The
nodes that very many others look up as their parent (at most 1,000) are broadcast, the rest joined.

Defined results: a null role or text counts as empty; turns with equal numbers follow role, then
text, and null numbers come first; rows without a conversation id belong to no conversation; equal
rows are turns of their own; a conversation without turns (it can only come from ``extra``) is a
member of the root alone; an empty table has no nodes; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.tables import WORD, in_batches, keep

SKETCH_ROWS = 4
SKETCH_CELLS = 1 << 20  # cells of a row at most; a cell is one byte, so the sketch has 4 MB at most
LOOKED_UP = 1000
_BLOCK = 1 << 14
_IDS = 1 << 14
_WORD = re.compile(WORD.encode())
_ROOT = hashlib.md5(b"").digest()
_NONE = hashlib.sha256(b"").hexdigest()
_PATH = "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, words long, through long"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the turns of every conversation."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "role", "text")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, depth, through = None, _ROOT, 0, 0
    for batch in batches:
        rows = []
        digests = bytearray()
        conv, place, role, text = (batch.column(k) for k in range(4))
        for c, at, r, t in zip(conv.to_pylist(), place.to_pylist(), role.to_pylist(), text):
            parent = digest
            if at is None:
                now, digest, depth, through, words, parent = c, _ROOT, 0, 0, 0, _ROOT
            else:
                said, by = t.as_py().encode(), r.encode()
                words = len(_WORD.findall(said))
                digest = hashlib.md5(digest + len(by).to_bytes(8, "little") + by + said).digest()
                depth, through = depth + 1, through + words
            rows.append((now, depth, words, through))
            digests += digest + parent
        found = np.array(rows, dtype=np.int64).reshape(-1, 4)
        keys = np.frombuffer(bytes(digests), dtype="<i8").reshape(-1, 4)
        columns = [found[:, 0], found[:, 1], *keys.T, found[:, 2], found[:, 3]]
        names = ["conv_id", "depth", "d1", "d2", "p1", "p2", "words", "through"]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


def prefix_paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for every prefix of every conversation, the empty one included: conv_id, depth,
    digest (d1, d2), the parent's (p1, p2), words of the last text and of the whole prefix."""
    roots = convs.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"))
    every = turns.select("conv_id", "place", "role", "text").unionByName(roots)
    dealt = every.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_first())
    return in_batches(dealt, _chained, _PATH)


def _cells(d1: np.ndarray, d2: np.ndarray, cells: int) -> list[np.ndarray]:
    """One cell of every row of the sketch for every digest."""
    a, b = d1.view(np.uint64), d2.view(np.uint64)
    return [((a + np.uint64(r) * (b | np.uint64(1))) % np.uint64(cells)).astype(np.int64) for r in range(SKETCH_ROWS)]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _counted(cells: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((SKETCH_ROWS, cells), dtype=np.uint8)
        for batch in batches:
            for row, at in zip(sketch, _cells(_numbers(batch, "d1"), _numbers(batch, "d2"), cells)):
                cell, n = np.unique(at, return_counts=True)
                row[cell] = np.minimum(row[cell] + np.minimum(n, 2), 2)
        blocks = sketch.reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([blocks[k].tobytes() for k in used], pa.binary())], names=["block", "cells"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(cells.as_py(), dtype=np.uint8)
            total[block] = np.minimum(total[block] + part, 2) if block in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "cells"])


def count_min(paths: DataFrame, max_cells: int = SKETCH_CELLS) -> np.ndarray:
    """Sketch of all digests below the root, counts cut at two; its size is bounded by ``max_cells``."""
    below = paths.where("depth > 0").select("d1", "d2")
    cells = min(max_cells, max(_BLOCK, 1 << (8 * below.count()).bit_length()))
    schema = "block long, cells binary"
    # Equal blocks of all partitions meet in one of a few tasks and are added up as they come.
    blocks = in_batches(in_batches(below, _counted(cells), schema).repartition("block"), _merged, schema).collect()
    sketch = np.zeros((SKETCH_ROWS * cells // _BLOCK, _BLOCK), dtype=np.uint8)
    for r in blocks:
        sketch[r.block] = np.frombuffer(r.cells, dtype=np.uint8)
    return sketch.reshape(SKETCH_ROWS, cells)


def proven_single(paths: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``paths`` with ``single``: true where the sketch proves that one conversation has the prefix."""
    shared = paths.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = shared.value
            at = _cells(_numbers(batch, "d1"), _numbers(batch, "d2"), table.shape[1])
            single = np.minimum.reduce([row[a] for row, a in zip(table, at)]) == 1
            yield batch.append_column("single", pa.array(single & (_numbers(batch, "depth") > 0)))

    return in_batches(paths, run, _PATH + ", single boolean")


def prefix_trie(turns: DataFrame, extra: DataFrame | None = None, max_cells: int = SKETCH_CELLS) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, and which conversation ends where.

    ``turns`` has conv_id, place, role and text; ``extra`` (conv_id) names conversations without turns.
    Nodes: d1 and d2 (digest), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (words not repeated when every node below is kept once) and
    tail (a prefix of one conversation, proven by the sketch).  Ends: conv_id, d1, d2, tail.
    """
    convs = turns.select("conv_id").unionByName(extra.select("conv_id")) if extra is not None else turns.select("conv_id")
    paths = keep(prefix_paths(turns, convs.where("conv_id IS NOT NULL").distinct()), "prefix-paths")
    paths = keep(proven_single(paths, count_min(paths, max_cells)), "prefix-singles")

    before = F.col("through") - F.col("words")
    whole = paths.groupBy("conv_id").agg(
        F.max("depth").alias("size"), F.max("through").alias("total"), F.min(F.when(F.col("single"), F.struct("depth", before.alias("before")))).alias("tail")
    )
    whole = keep(whole, "prefix-conversations")
    placed = paths.join(whole, "conv_id")
    is_tail = F.coalesce(F.col("depth") >= F.col("tail.depth"), F.lit(False))
    shared = placed.where(~is_tail)

    owners = shared.groupBy("d1", "d2", "depth").agg(F.min(F.struct("conv_id", before.alias("before"))).alias("first"), F.max("size").alias("longest"))
    owned = owners.groupBy(F.col("first.conv_id").alias("conv_id")).agg(
        F.min(F.struct("depth", F.col("first.before").alias("before"))).alias("own"), F.max(F.col("longest") == F.col("depth")).alias("is_leaf")
    )
    ends_in_tail = F.coalesce(F.col("tail.depth") <= F.col("size"), F.lit(False))
    start = F.coalesce("own", "tail")
    whole = keep(
        whole.join(owned, "conv_id", "left").select(
            "conv_id", "size", "total", "tail",
            F.coalesce(start["depth"], F.col("size") + 1).alias("owned_from"),
            F.coalesce(F.col("total") - start["before"], F.lit(0)).alias("owned_words"),
            (ends_in_tail | F.coalesce("is_leaf", F.lit(False))).cast("long").alias("leaf"),
        ),
        "prefix-owners",
    )
    placed = paths.join(whole, "conv_id")
    shared, tails = placed.where(~is_tail), placed.where(is_tail)

    rest = F.col("total") - before
    own_rest = F.when(F.col("depth") >= F.col("owned_from"), rest).otherwise(F.col("owned_words"))
    child = (F.col("owned_from") <= F.col("depth") + 1) & (F.col("size") > F.col("depth"))
    nodes = shared.groupBy("d1", "d2", "depth", "p1", "p2").agg(
        F.min(F.struct("conv_id", "owned_from")).alias("first"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        (F.sum(rest) - F.sum(own_rest)).alias("saved_tokens"),
    )
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = nodes.select("d1", "d2", "p1", "p2", F.col("first.conv_id").alias("conv_id"), "depth", F.col("first.owned_from").alias("owned_from"), *figures, F.lit(False).alias("tail"))
    nodes = keep(nodes, "prefix-nodes")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    single = tails.select(
        "d1", "d2", "p1", "p2", "conv_id", "depth", "owned_from", one.alias("n_convs"),
        (F.col("depth") < F.col("size")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.lit(True).alias("tail"),
    )
    ends = placed.where("depth = size").select("conv_id", "d1", "d2", is_tail.alias("tail"))
    return _with_parents(nodes.unionByName(single), nodes), ends


def _with_parents(every: DataFrame, nodes: DataFrame) -> DataFrame:
    """parent_conv_id of all nodes: the node's own conversation, unless its part of the path begins here."""
    asks = (F.col("depth") > 0) & (F.col("depth") == F.col("owned_from"))
    asked = every.where(asks)
    # Every child asks once, so at most LOOKED_UP nodes can have more than that share of the children.
    children = nodes.agg(F.sum("n_children")).first()[0] or 0
    is_hot = F.col("n_children") > max(LOOKED_UP, children // LOOKED_UP)
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.where(is_hot).select("p1", "p2", F.col("parent_conv_id").alias("hot_parent"))
    met = asked.join(F.broadcast(hot), ["p1", "p2"], "left")
    few = met.where("hot_parent IS NULL").drop("hot_parent").join(parents.where(~is_hot).select("p1", "p2", "parent_conv_id"), ["p1", "p2"])
    many = met.where("hot_parent IS NOT NULL").withColumnRenamed("hot_parent", "parent_conv_id")
    rest = every.where(~asks).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return few.unionByName(many).unionByName(rest).drop("p1", "p2", "owned_from")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, ids = None, []

    def piece():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
            names=["d1", "d2", "first", "ids"],
        )

    for batch in batches:
        for d1, d2, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if ids and (key != (d1, d2) or len(ids) == _IDS):
                yield piece()
                ids = []
            key = (d1, d2)
            ids.append(c)
    if ids:
        yield piece()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, found = None, None, []
    for batch in batches:
        for d1, d2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if key == (d1, d2):
                digest.update(b",")
            else:
                if key:
                    found.append((*key, digest.hexdigest()))
                key, digest = (d1, d2), hashlib.sha256()
            digest.update(ids.as_py().encode())
        yield _digests(found)
        found = []
    if key:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["d1", "d2", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """d1, d2 and SHA-256 of the ids that end at a node, ascending and joined by commas.

    The digest needs the ids in order, so the last step runs over a node's ids in one task.  It gets
    them as pieces of up to 16,384 ids that were sorted and joined in many tasks, and keeps one piece.
    """
    dealt = ends.select("d1", "d2", "conv_id").repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    pieces = in_batches(dealt, _joined_ids, "d1 long, d2 long, first long, ids string")
    return in_batches(pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first"), _hashed_ids, "d1 long, d2 long, ends_sha256 string")


def with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ends_sha256."""
    found = keep(ends_digests(ends.where("NOT tail")), "prefix-ends")
    alone = F.when(F.col("tail") & (F.col("n_children") == 0), F.sha2(F.col("conv_id").cast("string"), 256))
    return nodes.join(found, ["d1", "d2"], "left").withColumn("ends_sha256", F.coalesce(alone, "ends_sha256", F.lit(_NONE)))
