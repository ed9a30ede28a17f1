"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles (all its words, where it has fewer than five).
Every sketch takes the ``PICK`` smallest hashes of occurrence-labelled shingles and keeps the
shingles in text order, so texts agree in a sketch only if they hold the same shingles in the same
order.  Texts that agree in one of ``SKETCHES`` sketches are candidates.  Two texts are linked when

    m / (n1 + n2 - m) >= 0.8,

m being their longest common subsequence of shingles: the Jaccard similarity of the shingles that
an alignment matches.  The alignment is banded; the band is as wide as a pair at the threshold can
need, so it loses nothing.  A pair at 0.8 is missed by all sketches about once in 100,000 times.

Classes are the connected components of the links.  Equal texts are one node.  In the first round a
member of a bucket is compared with the bucket's first.  Members of a bucket that are then still in
different components are dealt into blocks of ``BLOCK``; in the second round they meet inside their
block, in the third those of different blocks.  A task verifies its pairs itself and returns only
links that join components, fewer than it has members.  So no bucket is gathered, and a group of
texts that are all alike gives links in proportion to its members.

Defined results: a null text is a class of its own; equal texts, also empty ones, are one class;
texts of white space or empty are linked only to equal ones; a class is named by its smallest
doc_id; repeated rows (same id and text) are in the same class and only one of them is kept; an
empty table gives an empty result.  ``near_duplicates`` reads ``doc_id`` and ``text`` only;
``deduplicated`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.components import components
from haulmark.llm.tables import in_batches, keep, text_key
from haulmark.llm.tokens import SHINGLE, TextSlice, keys_by_doc, mix, run_hash, slices
from haulmark.sources.sizing import broadcast_if_small

SKETCHES = 16
PICK = 3
THRESHOLD = 0.8
BLOCK = 64
COPY_PAIRS = 256

_TOP = np.uint64(2**64 - 1)
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_runs(part: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts one after the other, and where each text's begin."""
    hashes, at = part.shingles()
    docs = part.word_doc[at]
    short = np.flatnonzero((part.n_words > 0) & (part.n_words < SHINGLE))
    if len(short):
        words = part.words()
        whole = [run_hash(words[part.word_ptr[d] : part.word_ptr[d + 1]], int(part.n_words[d]))[0] for d in short]
        order = np.argsort(np.concatenate([docs, short]), kind="stable")
        hashes = np.concatenate([hashes, np.array(whole, dtype=np.uint64)])[order]
        docs = np.concatenate([docs, short])[order]
    return hashes, np.searchsorted(docs, np.arange(part.n_docs + 1))


def labelled_occurrences(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first, second, ... occurrence of a shingle in its text apart."""
    keys = keys_by_doc(hashes, owner)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    place = np.arange(len(keys))
    occurrence = np.empty(len(keys), dtype=np.uint64)
    occurrence[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mix(hashes + occurrence * np.uint64(0xD6E8FEB86659FD93))


def order_sketches(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """``SKETCHES`` keys for every text with a shingle (zeros for the others)."""
    n_docs = len(ptr) - 1
    out = np.zeros((n_docs, SKETCHES), dtype=np.uint64)
    filled = np.flatnonzero(np.diff(ptr))
    if not len(filled):
        return out
    begin, lengths = ptr[:-1][filled], np.diff(ptr)[filled]
    owner = np.repeat(np.arange(len(filled)), lengths)
    labelled = labelled_occurrences(hashes, owner)
    for j, seed in enumerate(_SEEDS):
        value = labelled * seed
        value ^= value >> np.uint64(32)
        value *= seed
        chosen = np.full((len(filled), PICK), -1, dtype=np.int64)
        for k in range(PICK):
            least = np.minimum.reduceat(value, begin)
            at = np.flatnonzero(value == np.repeat(least, lengths))
            texts, first = np.unique(owner[at], return_index=True)
            at = at[first]
            left = least[texts] != _TOP
            chosen[texts[left], k] = at[left]
            value[at] = _TOP
        chosen.sort(axis=1)
        key = np.full(len(filled), seed, dtype=np.uint64)
        for k in range(PICK):
            key = mix(key * np.uint64(31) + np.where(chosen[:, k] >= 0, hashes[chosen[:, k]], np.uint64(0)))
        out[filled, j] = key
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (shingles) and keys (one per sketch) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(batch.column("text")):
                hashes, ptr = shingle_runs(part)
                keys = order_sketches(hashes, ptr).view(np.int64)
                n = np.diff(ptr)
                cuts = np.concatenate([[0], np.cumsum(np.where(n > 0, SKETCHES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[n > 0].ravel()))
                rest = [batch.column(c).slice(first, last - first) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), lists], names=["doc_id", "text_key", "n", "keys"])

    given = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    return in_batches(given, run, "doc_id long, text_key string, n long, keys array<long>")


def _banded(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence that matches no positions further apart than ``band``.

    Bit-parallel: bit j of ``v`` is zero where column j adds one; the bits are those of the band.
    """
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    width = 2 * band + 1
    full = (1 << width) - 1
    v, found = full, 0
    for i, x in enumerate(a):
        low = i - band
        if low > 0:  # column low - 1 leaves the band
            found += not v & 1
            v = (v >> 1) | (1 << (width - 1))
        first = max(low, 0)
        hits = 0
        for j in where.get(x, ()):
            if first <= j < first + width and j <= i + band:
                hits |= 1 << (j - first)
        if hits:
            u = v & hits
            v = ((v + u) | (v - u)) & full
    return found + width - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned similarity of two shingle sequences; 0 where it can't reach ``threshold``."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return 0.0
    need = int(np.ceil(threshold * (n1 + n2) / (1 + threshold) - 1e-9))
    if min(n1, n2) < need:
        return 0.0
    short = min(n1, n2)
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    differs = np.flatnonzero(a[n1 - short + head :][::-1] != b[n2 - short + head :][::-1])
    tail = int(differs[0]) if len(differs) else short - head
    a, b = a[head : n1 - tail], b[head : n2 - tail]
    known, times = np.unique(a, return_counts=True)
    other, others = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(known, other, assume_unique=True, return_indices=True)
    most = head + tail + int(np.minimum(times[i], others[j]).sum())
    if most < need:
        return 0.0
    matched = head + tail + (_banded(a.tolist(), b.tolist(), n1 + n2 - 2 * need) if len(i) else 0)
    found = matched / (n1 + n2 - matched)
    return found if found >= threshold - 1e-12 else 0.0


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, copy_pairs: int = COPY_PAIRS) -> DataFrame:
    """The pairs (a, b) of ``texts`` (node, text) that are linked.

    A text ``a`` with many pairs is copied once per ``copy_pairs`` of them, and its pairs are dealt
    over the copies, so no task reads all pairs of a large bucket's first.
    """
    copies = F.ceil(F.count(F.lit(1)) / copy_pairs).cast("int").alias("copies")
    many = keep(pairs.groupBy("a").agg(copies).where("copies > 1"), "many-pairs")
    copied = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(broadcast_if_small(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), copied).cast("int").alias("copy"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(broadcast_if_small(many), "a", "left")
    left = left.select("a", "text_a", F.explode(F.sequence(F.lit(0), copied - 1)).alias("copy"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = dealt.join(left, ["a", "copy"]).join(right, "b").select("a", "b", "text_a", "text_b")

    def sequences(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, part in slices(column):
            hashes, ptr = shingle_runs(part)
            yield from (hashes[ptr[d] : ptr[d + 1]] for d in range(part.n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(sequences(batch.column("text_a")), sequences(batch.column("text_b")), strict=True)
            linked = pa.array([similarity(x, y, threshold) > 0 for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(linked)

    return in_batches(joined, run, "a long, b long")


def _fits(n1, n2, threshold: float):
    return F.least(n1, n2) >= threshold * F.greatest(n1, n2)


def first_pairs(buckets: DataFrame, threshold: float) -> DataFrame:
    """Every member of a bucket with the bucket's first."""
    first = buckets.groupBy("sketch", "key").agg(F.min(F.struct("node", "n")).alias("first"))
    seen = buckets.join(first, ["sketch", "key"]).where((F.col("first.node") != F.col("node")) & _fits(F.col("n"), F.col("first.n"), threshold))
    return seen.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()


def split_members(buckets: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of buckets that hold more than one component, dealt into blocks."""
    member = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = member.groupBy("sketch", "key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    split = sizes.where("low < high").select("sketch", "key", F.ceil(F.col("members") / block).alias("blocks"))
    return member.join(split, ["sketch", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def sequences_of(texts: DataFrame) -> DataFrame:
    """node and seq: the shingle hashes of every text in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(batch.column("text")):
                hashes, ptr = shingle_runs(part)
                lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, last - first), lists], names=["node", "seq"])

    return in_batches(texts, run, "node long, seq array<long>")


class _Block:
    """Members of a bucket that meet others in one task."""

    def __init__(self, rows: pa.StructArray):
        self.node, self.n, self.label = (rows.field(c).to_numpy() for c in ("node", "n", "label"))
        self.keys = rows.field("keys").flatten().to_numpy().reshape(len(self.node), SKETCHES)
        column = rows.field("seq")
        lengths = pa.compute.list_value_length(column).to_numpy()
        flat = column.flatten().to_numpy().view(np.uint64)
        self.seqs = np.split(flat, np.cumsum(lengths)[:-1])
        self.owner = np.repeat(np.arange(len(self.node)), lengths)
        self.marks = labelled_occurrences(flat, self.owner)


def _shared(x_marks: np.ndarray, x_owner: np.ndarray, y_marks: np.ndarray, y_owner: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many marks every text of one block has in common with every text of another."""
    known, x_at = np.unique(x_marks, return_inverse=True)
    at = np.searchsorted(known, y_marks)
    at[at == len(known)] = 0
    held = known[at] == y_marks
    y_at, y_owner = at[held], y_owner[held]
    total = np.zeros(shape)
    for begin in range(0, len(known), 1 << 15):
        width = min(1 << 15, len(known) - begin)
        sides = []
        for marks_at, owner, rows in ((x_at, x_owner, shape[0]), (y_at, y_owner, shape[1])):
            inside = (marks_at >= begin) & (marks_at < begin + width)
            side = np.zeros((rows, width), dtype=np.float32)
            side[owner[inside], marks_at[inside] - begin] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def _spanning(x: _Block, y: _Block, possible: np.ndarray, need: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join the components of the two blocks as all links of the possible pairs would.

    Pairs whose components are joined by then are passed over, so there are fewer links than
    components, however many pairs are alike.
    """
    common = _shared(x.marks, x.owner, y.marks, y.owner, possible.shape)
    i, j = np.nonzero(possible & (common >= need))
    order = np.argsort(-common[i, j], kind="stable")
    root: dict[int, int] = {}

    def find(label: int) -> int:
        while label in root:
            label = root[label]
        return label

    found = []
    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        one, other = find(int(x.label[p])), find(int(y.label[q]))
        if one != other and similarity(x.seqs[p], y.seqs[q], threshold) > 0:
            root[max(one, other)] = min(one, other)
            found.append((int(x.node[p]), int(y.node[q])))
    return found


def block_links(members: DataFrame, signed: DataFrame, threshold: float, within: bool) -> DataFrame:
    """Verified links (a, b) that join different components, inside blocks or between two blocks.

    ``members`` are those of ``split_members``, ``signed`` has node, keys and seq.  A pair is looked
    at in the first bucket both are in.  Blocks that hold one and the same component don't meet.
    """
    bucket = ["key", "sketch"]
    rows = members.join(signed, "node").groupBy(*bucket, "block").agg(F.collect_list(F.struct("node", "n", "label", "keys", "seq")).alias("rows"))
    spans = members.groupBy(*bucket, "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    if within:
        sides = rows.join(spans.where("low < high").select(*bucket, "block"), [*bucket, "block"]).select("sketch", F.col("rows").alias("xs"), F.col("rows").alias("ys"))
    else:
        one = spans.select(*bucket, F.col("block").alias("i"), "low", "high")
        two = spans.select(*bucket, F.col("block").alias("j"), F.col("low").alias("low_2"), F.col("high").alias("high_2"))
        met = one.join(two, bucket).where("i < j AND least(low, low_2) < greatest(high, high_2)").select(*bucket, "i", "j")
        sides = met.join(rows.select(*bucket, F.col("block").alias("i"), F.col("rows").alias("xs")), [*bucket, "i"])
        sides = sides.join(rows.select(*bucket, F.col("block").alias("j"), F.col("rows").alias("ys")), [*bucket, "j"]).select("sketch", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sketch = batch.column("sketch")[r].as_py()
                x = _Block(batch.column("xs")[r].values)
                y = x if within else _Block(batch.column("ys")[r].values)
                earlier = (x.keys[:, None, :sketch] == y.keys[None, :, :sketch]).any(-1)
                possible = ~earlier & (x.label[:, None] != y.label[None, :])
                if within:
                    possible &= x.node[:, None] < y.node[None, :]
                need = np.ceil(threshold * (x.n[:, None] + y.n[None, :]) / (1 + threshold) - 1e-9)
                possible &= np.minimum(x.n[:, None], y.n[None, :]) >= need
                if possible.any():
                    found = np.array(_spanning(x, y, possible, need, threshold), dtype=np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], names=["a", "b"])

    return in_batches(sides, run, "a long, b long").distinct()


def _texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the wanted nodes."""
    keyed = nodes.select("node", "text_key", F.col("doc_id").alias("first_id")).join(wanted, "node")
    given = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key"))
    found = given.join(broadcast_if_small(keyed), "text_key").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, class_id and kept (one row of each class) for every row of ``docs``."""
    sketches = keep(sketch(docs), "sketches")
    nodes = sketches.where("text_key IS NOT NULL").groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", "n", F.posexplode("keys").alias("sketch", "key"))
    shared = entries.groupBy("sketch", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("sketch", "key")
    buckets = keep(entries.join(shared, ["sketch", "key"]), "buckets")
    pairs = keep(first_pairs(buckets, threshold), "pairs")
    links = keep(verified(pairs, _texts_of(_nodes_of(pairs), nodes, docs), threshold), "links")
    labels = components(links)
    members = keep(split_members(buckets, labels), "members")
    texts = _texts_of(members.select("node").distinct(), nodes, docs)
    signed = keep(sequences_of(texts).join(nodes.select("node", "keys"), "node"), "signed")
    for within in (True, False):
        late = keep(block_links(members, signed, threshold, within), "links")
        if not late.isEmpty():
            links = keep(links.unionByName(late), "links")
            labels = components(links)
            members = keep(split_members(buckets, labels), "members")
    grouped = nodes.join(labels, "node", "left").select("text_key", "doc_id", F.coalesce("label", "node").alias("label"))
    # The smallest id of the class and the text that has it; ids that are null come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key"))
    named = grouped.groupBy("label").agg(first.alias("best"))
    classes = grouped.join(named, "label").select("text_key", F.col("best.doc_id").alias("class_id"), (F.col("best.text_key") == F.col("text_key")).alias("best"))
    rows = sketches.select("doc_id", "text_key").join(classes, "text_key", "left")
    own = F.col("text_key").isNull()
    return rows.select(
        "doc_id",
        "text_key",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (own | (F.col("best") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("kept"),
    )


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of every class."""
    found = near_duplicates(docs, threshold)
    counted = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"), F.first("kept").alias("kept"))
    # What goes is less than what stays; a row that stays is found by not being on the list.
    marked = keep(counted.where("NOT kept OR (rows > 1 AND text_key IS NOT NULL)"), "classes")
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", text_key("row.text"))
    joined = wrapped.alias("r").join(
        broadcast_if_small(marked.alias("m")), F.expr("CAST(r.row.doc_id AS BIGINT) <=> m.doc_id AND r.key <=> m.text_key"), "left"
    )
    single = joined.where("kept IS NULL").select("row.*")
    repeated = joined.where("kept").groupBy("m.doc_id", "m.text_key").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated)
