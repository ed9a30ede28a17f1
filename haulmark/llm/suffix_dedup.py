"""Exact repeated strings by bucket-pointer refinement; every byte that lies in one is removed.

A byte goes when a string of ``LENGTH`` bytes that covers it also begins somewhere else.  Strings
are looked at through anchors: of the 101 grams of 100 bytes in such a string the one with the
least hash, so equal strings have the same anchor and about one place in fifty is one.

1. Initial buckets: anchors with equal grams.  Grams that occur once drop out; the count is made
   before the shuffle, too.
2. Every remaining anchor gets its context, the bytes that any string around it can reach.  Equal
   contexts are folded: all strings of a context that occurs twice are repeated.
3. Buckets that hold several contexts are refined.  The strings of an anchor are numbered by how far
   before the anchor they begin (0 to 100).  A bucket for an interval of these numbers is split in
   two halves; the strings of a half share more bytes, further right for the lower half, further
   left for the upper, and the new bucket of an anchor is its old one together with the bytes at
   that offset.  So each level uses the buckets of the level before; a bucket of one drops out, and
   what is left at a single number is a repeated string.  Bytes are compared, not hashes.
4. A bucket of more contexts than ``BUCKET`` is never gathered.  It is first refined by ten blocks
   of numbers through grouped digests of 128 bits, and its rest string by string.

Texts are shuffled once, by a key of the row; the plan uses that exchange again for each look at
the texts.  No group of copies meets in a task: keys are counted and joined, and equal rows fold.

Defined results: texts are UTF-8 bytes and a null text is empty; a match never crosses a text; a
string that overlaps itself counts; equal rows are different texts, so from 200 bytes on both go
entirely; ties can't occur; an empty table gives an empty result; other columns are kept.  Very long
texts are read in slices, and only the marks of a text have to fit beside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from haulmark.llm.tables import in_batches, keep

LENGTH = 200
GRAM = LENGTH // 2
FLANK = LENGTH - GRAM
BUCKET = 16_384
BLOCK = 10
_SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = 16  # bytes that hold one bit for each of the FLANK + 1 strings of an anchor


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, _SLICE + 2 * LENGTH)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _SLICE + 2 * LENGTH)
_VALUE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
_VALUE ^= _VALUE >> np.uint64(29)


def _least(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    span, out = 1, values
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[:-rest], out[rest:]) if rest else out


def _slice_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors; ``ends`` is where the text of each byte ends."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _UP[:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    np.maximum(grams, 1, out=grams)
    low = _least(grams, FLANK + 1, np.minimum)
    low[np.arange(len(low)) + LENGTH > ends[: len(low)]] = 0  # no string begins here
    padded = np.zeros(len(grams) + FLANK, dtype=np.uint64)
    padded[FLANK : FLANK + len(low)] = low
    at = np.flatnonzero(_least(padded, FLANK + 1, np.maximum) == grams)
    return at, grams[at]


def anchors(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text, places, gram hashes) of all texts with anchors."""
    group: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        n = len(text)
        if n < LENGTH:
            continue
        if n > _SLICE:
            found = []
            whole = np.frombuffer(text, dtype=np.uint8)
            for a in range(0, n - LENGTH + 1, _SLICE):
                part = whole[a : a + _SLICE + LENGTH - 1]
                at, gram = _slice_anchors(part, np.full(len(part), len(part)))
                found.append((at + a, gram))
            at, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
            yield k, at, np.concatenate([f[1] for f in found])[first]
            continue
        if size + n > _SLICE:
            yield from _group_anchors(texts, group)
            group, size = [], 0
        group.append(k)
        size += n
    yield from _group_anchors(texts, group)


def _group_anchors(texts: list[bytes], group: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not group:
        return
    data = np.frombuffer(b"".join([texts[k] for k in group]), dtype=np.uint8)
    bounds = np.cumsum([len(texts[k]) for k in group])
    at, gram = _slice_anchors(data, np.repeat(bounds, np.diff(bounds, prepend=0)))
    cut = np.searchsorted(at, np.concatenate(([0], bounds)))
    for k, a, b, end in zip(group, cut[:-1], cut[1:], bounds):
        yield k, at[a:b] - (end - len(texts[k])), gram[a:b]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram and t1: every gram of a text's anchors, twice where the text itself repeats it."""
    for batch in batches:
        keys = _column(batch, "t1").to_numpy()
        found, owner = [], []
        for k, _, gram in anchors(_texts(_column(batch, "text"))):
            own, n = np.unique(gram, return_counts=True)
            found += [own, own[n > 1]]
            owner.append(np.full(len(own) + int((n > 1).sum()), keys[k]))
        if found:
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(found)), pa.array(np.concatenate(owner))], names=["gram", "t1"])


def _reach(text: bytes, at: int) -> tuple[int, int]:
    """How far the strings around an anchor reach: bytes before it, and the first byte after them."""
    return min(FLANK, at), min(len(text), at + LENGTH)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, context digest (k1, k2) and place (t1, t2, at) of anchors whose gram is repeated.

    Where a text has the same context again (a stretch of one character has it at every place), the
    other places are in ``more``.
    """
    for batch in batches:
        texts = _texts(_column(batch, "text"))
        t1, t2 = (_column(batch, c).to_numpy() for c in ("t1", "t2"))
        wanted = _column(batch, "grams")
        grams, places, more, owner, digests = [], [], [], [], []
        for k, at, gram in anchors(texts):
            text = texts[k]
            known = np.isin(gram.view(np.int64), wanted[k].values.to_numpy())
            own: dict[bytes, list[int]] = {}
            of = gram[known].tolist()
            for g, a in zip(of, at[known].tolist()):
                before, end = _reach(text, a)
                found = own.setdefault(hashlib.md5(before.to_bytes(1, "little") + text[a - before : end]).digest(), [])
                if not found:
                    grams.append(g)
                found.append(a)
            digests += own
            places += [found[0] for found in own.values()]
            more += [found[1:] or None for found in own.values()]
            owner += [k] * len(own)
        if digests:
            key = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            columns = [_longs(np.array(grams, dtype=np.uint64)), _longs(key[:, 0]), _longs(key[:, 1]), _longs(t1[owner]), _longs(t2[owner])]
            columns += [pa.array(places, pa.int64()), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "k1", "k2", "t1", "t2", "at", "more"])


_PLACE = "gram long, k1 long, k2 long, t1 long, t2 long, at long, more array<long>"
_OPEN = "gram long, needed boolean, t1 long, t2 long, at long, before int, context binary"
_ID = ["t1", "t2", "at"]
_MARKS = "t1 long, t2 long, at long, mask binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are to be refined."""
    names = [c.split()[0] for c in _OPEN.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        texts = _texts(_column(batch, "text"))
        rows = []
        for text, t1, t2, asked in zip(texts, _column(batch, "t1").to_pylist(), _column(batch, "t2").to_pylist(), _column(batch, "asked").to_pylist()):
            for x in asked:
                if x["t2"] == t2:
                    before, end = _reach(text, x["at"])
                    rows.append((x["gram"], x["needed"], t1, t2, x["at"], before, text[x["at"] - before : end]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def refine(contexts: list[bytes], before: list[int], needed: list[bool]) -> list[int]:
    """For every context of a bucket that is needed the set of its repeated strings, as bits by number."""
    low = [max(0, LENGTH - (len(c) - b)) for c, b in zip(contexts, before)]
    marks = [0] * len(contexts)
    todo = [(0, FLANK, [(i, 0, open_) for i, open_ in enumerate(needed)])]
    while todo:
        x, y, members = todo.pop()
        # Members that agree in all strings of the interval are done; one of them stays to be met.
        same: dict[bytes | int, list[tuple[int, int, bool]]] = {}
        for m in members:
            i = m[0]
            whole = low[i] <= x and before[i] >= y
            same.setdefault(contexts[i][before[i] - y : before[i] + LENGTH - x] if whole else i, []).append(m)
        left = []
        for group in same.values():
            if len(group) > 1:
                for i, _, open_ in group:
                    if open_:
                        marks[i] |= ((1 << (y - x + 1)) - 1) << x
                left.append((group[0][0], group[0][1], False))
            else:
                left += group
        if x == y or not any(m[2] for m in left):
            continue
        middle = (x + y) // 2
        for first, last, a, b in ((x, middle, LENGTH - y, LENGTH - middle), (middle + 1, y, -middle - 1, -x)):
            # Bucket of a half: the bucket so far and the bytes at the further offset.
            split: dict[tuple[int, bytes], list[tuple[int, int, bool]]] = {}
            for m in left:
                i = m[0]
                if low[i] <= last and before[i] >= first:
                    split.setdefault((m[1], contexts[i][before[i] + a : before[i] + b]), []).append(m)
            kept = [g for g in split.values() if len(g) > 1 and any(m[2] for m in g)]
            if kept:
                todo.append((first, last, [(i, k, open_) for k, g in enumerate(kept) for i, _, open_ in g]))
    return marks


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the needed contexts of all buckets; rows come sorted by bucket."""
    names = ["gram", "needed", *_ID, "before", "context"]
    held: list[tuple] = []

    def marks(rows: list[tuple]) -> list[tuple]:
        found = refine([r[6] for r in rows], [r[5] for r in rows], [r[1] for r in rows])
        return [(*r[2:5], m.to_bytes(_MASK, "little")) for r, m in zip(rows, found) if m and r[1]]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[*_ID, "mask"])

    for batch in batches:
        out = []
        for row in zip(*(_column(batch, c).to_pylist() for c in names)):
            if held and held[0][0] != row[0]:
                out += marks(held)
                held = []
            held.append(row)
        yield batch_of(out)
    if held:
        yield batch_of(marks(held))


_NUMBERS = ", ".join(str(k) for k in range(0, FLANK + 1, BLOCK))


def _large_buckets(opened: DataFrame) -> DataFrame:
    """Marks of contexts in buckets that no task may gather: by blocks of strings, then by string."""
    low = F.greatest(F.lit(0), LENGTH - (F.length("context") - F.col("before")))
    rows = opened.withColumn("low", low).withColumn("x", F.explode(F.expr(f"array({_NUMBERS})"))).withColumn("y", F.least(F.col("x") + BLOCK - 1, F.lit(FLANK)))
    rows = rows.where("low <= y AND before >= x")
    piece = lambda a, size: F.md5(F.substring(F.col("context"), F.col("before") + 1 - a, size))
    blocks = rows.select(
        "gram", "x", "y", "needed", *_ID, "before", "low", "context",
        piece(F.col("x"), LENGTH - F.col("y") + F.col("x")).alias("shared"),
        # All bytes of the block's strings, as far as the text has them.
        F.concat_ws(":", F.greatest("x", "low"), F.least("y", "before"),
                    piece(F.least("y", "before"), LENGTH + F.least("y", "before") - F.greatest("x", "low"))).alias("whole"),
    )
    key = ["gram", "x", "y", "shared"]
    folded = blocks.groupBy(*key, "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_ID)).alias("rep"), F.max("needed").alias("needed"))
    buckets = folded.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*key)
    some = blocks.where("needed").join(folded.where("n > 1").select(*key, "whole"), [*key, "whole"])
    met = folded.join(buckets, key).select("gram", "x", "y", F.col("n").alias("copies"), F.col("rep.*"))
    left = blocks.join(met, ["gram", "x", "y", *_ID])
    each = left.withColumn("number", F.explode(F.sequence(F.greatest("x", "low"), F.least("y", "before"))))
    each = each.select("gram", "number", *_ID, (F.col("needed") & (F.col("copies") == 1)).alias("needed"), piece(F.col("number"), F.lit(LENGTH)).alias("string"))
    twice = each.groupBy("gram", "number", "string").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("asked")).where("n > 1 AND asked").select("gram", "number", "string")
    single = each.where("needed").join(twice, ["gram", "number", "string"]).select(*_ID, F.col("number").alias("x"), F.col("number").alias("y"))
    spans = some.select(*_ID, F.greatest("x", "low").alias("x"), F.least("y", "before").alias("y")).unionByName(single)
    return in_batches(spans, _bits, _MARKS)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = [(((1 << (y - x + 1)) - 1) << x).to_bytes(_MASK, "little") for x, y in zip(_column(batch, "x").to_pylist(), _column(batch, "y").to_pylist())]
        yield pa.RecordBatch.from_arrays([*[_column(batch, c) for c in _ID], pa.array(masks, pa.binary())], names=[*_ID, "mask"])


def _removed(as_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(_column(batch, "text"))
            marks = _column(batch, "marks")
            bounds, parts = marks.offsets.to_numpy(), marks.values
            of, at = (parts.field(c).to_numpy() for c in ("t2", "at"))
            masks, more = parts.field("mask"), parts.field("more")
            sizes, edges, kept = [0], [], []
            for k, t2 in enumerate(_column(batch, "t2").to_numpy()):
                a, b = bounds[k], bounds[k + 1]
                found = np.zeros((0, 2), dtype=np.int64)
                if a < b:
                    mine = of[a:b] == t2
                    which = pa.array(mine)
                    again = more.slice(a, b - a).filter(which).flatten().to_numpy()
                    found = _spans(len(texts[k]), at[a:b][mine], again, masks.slice(a, b - a).filter(which))
                sizes.append(sizes[-1] + len(found))
                if len(found):
                    edges.append(found)
                    cut = [0, *found.ravel().tolist(), len(texts[k])]
                    kept.append(b"".join([texts[k][i:j] for i, j in zip(cut[::2], cut[1::2])]))
                else:
                    kept.append(texts[k])
            if as_text:
                kept = [x.decode("utf-8", "ignore") for x in kept]
            flat = np.concatenate(edges) if edges else np.zeros((0, 2), dtype=np.int64)
            fields = [pa.field(c, pa.int64()) for c in ("start", "end")]
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in (0, 1)], fields=fields)
            spans = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)
            names = ["row", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([_column(batch, "row"), spans, pa.array(kept, pa.string() if as_text else pa.binary())], names=names)

    return run


def _spans(size: int, at: np.ndarray, again: np.ndarray, masks: pa.Array) -> np.ndarray:
    """Maximal stretches of bytes (start, end) that the marked strings of a text cover.

    Around anchors without a mask, and those ``again``, all strings are marked.
    """
    whole = masks.is_null().to_numpy(zero_copy_only=False)
    every = np.concatenate((at[whole], again))
    starts, ends = [np.maximum(every - FLANK, 0)], [np.minimum(every + LENGTH, size)]
    if not whole.all():
        packed = np.frombuffer(b"".join(masks.filter(pa.array(~whole)).to_pylist()), dtype=np.uint8).reshape(-1, _MASK)
        row, number = np.nonzero(np.unpackbits(packed, axis=1, bitorder="little"))
        starts.append(at[~whole][row] - number)
        ends.append(starts[-1] + LENGTH)
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.concatenate((first[1:], [True]))
    return np.column_stack([start[first], reach[last]])


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (the given columns), text and a key of 128 bits (t1, t2) of the row's id and text."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row")
    return docs.select(row, "text", F.xxhash64("doc_id", "text").alias("t1"), F.xxhash64(F.lit(_BASE >> 1), "text", "doc_id").alias("t2"))


_SPANS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "end")]))


def _marked(docs: DataFrame, columns: list[str], bucket: int, as_text: bool = False) -> DataFrame:
    """row, spans (start, end; in bytes) and kept (the bytes outside them) of every row."""
    keyed = _keyed(docs, columns)
    grams = in_batches(keyed.select("t1", "text"), _grams, "gram long, t1 long")
    repeated = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    # The small sides of joins on grams and contexts are dealt out anew, so that a hot key can be split.
    lists = grams.join(repeated.repartition("gram"), "gram").groupBy("t1").agg(F.collect_set("gram").alias("grams"))
    lists = keep(lists, "repeated-grams")

    # All looks at the texts use the same columns, so that the plan shuffles them once.
    texts = lambda asked: keyed.join(asked, "t1").select("row", "text", "t1", "t2", asked.columns[1])
    places = in_batches(texts(lists), _contexts, _PLACE)
    key = ["gram", "k1", "k2"]
    copies = F.sum(1 + F.when(F.col("more").isNotNull(), F.size("more")).otherwise(0)).alias("n")
    contexts = places.groupBy(*key).agg(copies, F.min(F.struct(*_ID)).alias("rep"))
    # Asking for the place keeps it in the plan, so that all uses share one pass and one exchange.
    contexts = contexts.where(F.col("rep").isNotNull())
    buckets = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where("members > 1 AND least = 1")
    asked = contexts.join(buckets.select("gram", "members"), "gram").select("rep.*", "gram", "members", (F.col("n") == 1).alias("needed"))

    def opened(which: Column) -> DataFrame:
        lists = asked.where(which).groupBy("t1").agg(F.collect_list(F.struct("t2", "at", "gram", "needed")).alias("asked"))
        return in_batches(texts(lists), _cut_out, _OPEN)

    small = opened(F.col("members") <= bucket).repartition("gram").sortWithinPartitions("gram")
    small = in_batches(small, _refined, _MARKS)
    large = _large_buckets(opened(F.col("members") > bucket).repartition("t1", "at"))
    no_mask, no_more = F.lit(None).cast("binary").alias("mask"), F.lit(None).cast("array<long>").alias("more")
    folded = places.join(contexts.where("n > 1").select(*key).repartition(*key), key).select(*_ID, "more", no_mask)
    marks = folded.unionByName(small.unionByName(large).withColumn("more", no_more))
    marks = marks.groupBy("t1").agg(F.collect_list(F.struct("t2", "at", "more", "mask")).alias("marks"))
    found = keyed.join(marks, "t1", "left").select("row", "text", "t1", "t2", F.coalesce("marks", F.array().cast(marks.schema["marks"].dataType)).alias("marks"))
    schema = StructType([found.schema["row"], StructField("spans", _SPANS)]).add("kept", "string" if as_text else "binary")
    return in_batches(found, _removed(as_text), schema)


def repeated_strings(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, spans (start and end of maximal removed runs, in bytes) and kept (the other bytes)."""
    return _marked(docs, ["doc_id"], bucket).select(F.col("row.c0").alias("doc_id"), "spans", "kept")


def deduplicated(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` with all columns, ``text`` without repeated strings.

    Where a span cuts a character in two, what is left of it goes, too.
    """
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    text = F.when(F.size("spans") > 0, F.col("kept")).otherwise(at["text"])
    return _marked(docs, docs.columns, bucket, as_text=True).select(*[(text if c == "text" else x).alias(c) for c, x in at.items()])
