"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles.  For one hash function, a compact window
(l, c, r) stands for all subsequences between l and r that contain c: their min-hash is the hash
of c.  The windows of a text are the nodes of the Cartesian tree over its hashes; only those at
least as wide as the shortest passage are made, about 2 n / width of them.  Windows of different
texts with the same hash are joined in two rounds.  In the first, each meets the first text of its
hash, the one before it in the order of documents, and the first ones that also agree on the half
passage before the least shingle, on that after it, or on both: at most five pairs a window,
however many texts share a hash.  In the second, windows whose least shingle lies in no verified
passage meet all earlier windows of their hash, in blocks of ``BLOCK`` windows inside tasks; only
pairs are passed on that hold a common passage around the least shingle, and of these none for a
stretch inside of one that the window has.

A pair of the first round is looked at further when, over one passage, windows of at least
``MIN_HASHES`` of the ``HASHES`` functions overlap; one is enough in the second, which has seen the
shingles.  Each pair is verified on the words: the passages are
segments in which nearly all shingles occur in the earlier text, and they count when the Jaccard
similarity of the two passages' shingles is ``THRESHOLD`` or more and the passage has at least
``MIN_WORDS`` words.  A pair of passages at 0.8 shares fewer than two of five hashes about once in
150 times; equal passages share all.  What a window with a verified passage at its least shingle
could add is a little more of the same passage from another source; such windows don't go on to
the second round, which keeps it small where a passage has many copies.

A later equal text is one passage as long as the text, whatever its length, if it has a word.

Defined results: null and wordless texts have no passages; rows with the same id and text are one
document; repeats inside one text are not reported; the order of documents is that of doc_id (null
first), then of the text's hash; an empty table gives an empty result.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.tables import in_batches, keep, text_key
from haulmark.llm.tokens import SHINGLE, RunHashes, mix, slices
from haulmark.sources.sizing import broadcast_if_small

HASHES = 5
MIN_HASHES = 2
MIN_WORDS = 50
THRESHOLD = 0.8

# Windows of a hash that meet those of another block in one task, and how many at a time as matrices.
BLOCK = 4096
_ROWS = 512
# Shingles that so many pairs of such windows share are counted pair by pair.
_FEW = 64

_SEEDS = mix(np.arange(101, 101 + HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbouring values, by doubling."""
    pick, span = np.minimum if least else np.maximum, 1
    while 2 * span <= width:
        values = pick(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _middle_first(places: list[int], left: int, right: int, width: int) -> Iterator[tuple[int, int, int]]:
    """Windows of places with the same least value, the middle one first."""
    todo = [(0, len(places), left, right)]
    while todo:
        i, j, begin, end = todo.pop()
        if i < j and end - begin >= width:
            m = (i + j) // 2
            yield begin, places[m], end
            todo += [(i, m, begin, places[m]), (m + 1, j, places[m] + 1, end)]


def compact_windows(values: np.ndarray, ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, place of the least value, and end of all windows of ``width`` or more.

    A node of the Cartesian tree is that wide only if it is the least of some ``width`` neighbours,
    and so are the nodes around it, so one pass with a stack over those few places gives all.  Of
    equal values the middle one is the upper node, which keeps the windows of a text of one
    repeated word about 2 n / width, too.
    """
    n = len(values)
    empty = (np.zeros(0, np.int64),) * 3
    if n < width:
        return empty
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    least = np.where(owner[: n - width + 1] == owner[width - 1 :], _sliding(values, width, True), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, False) == values)
    places, texts, held = at.tolist(), owner[at].tolist(), values[at].tolist()
    ends = ptr.tolist()
    left, right, tied = [0] * len(places), [0] * len(places), {}
    last = places.copy()  # of a tied value, its last place so far
    stack: list[int] = []
    text = -1
    for i, (place, value) in enumerate(zip(places, held, strict=True)):
        if texts[i] != text:
            for k in stack:
                right[k] = ends[text + 1]
            stack, text = [], texts[i]
        while stack and held[stack[-1]] > value:
            right[stack.pop()] = place
        if not stack:
            left[i] = ends[text]
        elif held[stack[-1]] == value:
            head = stack[-1]
            left[i] = left[head]
            tied.setdefault(head, [head]).append(i)
            last[head] = place
            continue
        else:
            left[i] = last[stack[-1]] + 1
        stack.append(i)
    for k in stack:
        right[k] = ends[text + 1]
    begin, end = np.array(left, np.int64), np.array(right, np.int64)
    for members in tied.values():
        end[members] = 0
    wide = end - begin >= width
    found = [(begin[wide], at[wide], end[wide])]
    for head, members in tied.items():
        more = list(_middle_first([places[k] for k in members], left[head], right[head], width))
        if more:
            found.append(tuple(np.array(more, np.int64).T))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if len(at) else empty


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key, span, spot, doc_id and tag of all compact windows, packed since all of them are shuffled.

    ``key`` ends in the number of the hash function, ``span`` is begin and end, and ``spot`` the
    place of the least shingle and ``around``: 16 bits of a hash of the shingles up to the least one
    and 16 of those from it on, each for half a passage of the least width, or 0 where the text
    ends before.
    """
    width = min_words - SHINGLE + 1
    half = -(-width // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(batch.column("text")):
                hashes, at = part.shingles()
                ptr = np.searchsorted(part.word_doc[at], np.arange(part.n_docs + 1))
                owner = part.word_doc[at]
                runs = RunHashes(hashes)
                ids, tags = (batch.column(c).slice(first, last - first) for c in ("doc_id", "tag"))
                for number, seed in enumerate(_SEEDS):
                    value = hashes * seed
                    value ^= value >> np.uint64(29)
                    value *= seed
                    begin, least, end = compact_windows(value, ptr, width)
                    text = pa.array(owner[least])
                    base, stop = ptr[owner[least]], ptr[owner[least] + 1]
                    before = np.where(least - half + 1 >= base, runs.of(np.maximum(least - half + 1, 0), half), np.uint64(0))
                    after = np.where(least + half <= stop, runs.of(least, half), np.uint64(0))
                    around = (before >> np.uint64(48) << np.uint64(16)) | (after >> np.uint64(48))
                    arrays = [
                        pa.array((mix(value[least] + seed) & ~np.uint64(7) | np.uint64(number)).view(np.int64)),
                        pa.array((begin - base) << 32 | (end - base)),
                        pa.array((least - base) << 32 | around.astype(np.int64)),
                        ids.take(text),
                        tags.take(text),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "span", "spot", "doc_id", "tag"])

    return docs.mapInArrow(run, "key long, span long, spot long, doc_id long, tag long")


def together(found: DataFrame) -> DataFrame:
    """The windows of keys that different texts share, ``n``, how many windows have the key, and their place among these."""
    by_key = Window.partitionBy("key")
    place = F.row_number().over(by_key.orderBy(F.col("doc_id").asc_nulls_first(), "tag", "span"))
    placed = found.repartition("key").withColumn("place", place)
    counted = placed.withColumns({"n": F.max("place").over(by_key), "low": F.min("tag").over(by_key), "high": F.max("tag").over(by_key)})
    return counted.where("low <> high").drop("low", "high")


def _unpacked() -> Column:
    """The window as a struct: me (doc_id, tag), begin, least and end."""
    high = lambda name: F.shiftright(name, 32).cast("int")
    end = F.col("span").bitwiseAND(0xFFFFFFFF).cast("int")
    return F.struct(F.struct("doc_id", "tag").alias("me"), high("span").alias("begin"), high("spot").alias("least"), end.alias("end"))


def candidates(met: DataFrame, min_words: int = MIN_WORDS, min_hashes: int = MIN_HASHES) -> DataFrame:
    """Pairs (later, earlier) of documents of the first round that share enough windows, and where
    to look in both; ``met`` are the windows of ``together``.

    Windows of a document overlap in a passage of the least width only if they hold the same point
    of a grid of that width, so the interval join is a grouping by grid points.
    """
    place = [F.col("doc_id").asc_nulls_first(), F.col("tag"), F.col("span")]
    order = Window.partitionBy("key").orderBy(*place)
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    # Dealt by key before the columns are unpacked; the windows below sort and shuffle nothing.
    around = F.col("spot").bitwiseAND(0xFFFFFFFF)
    seen = met.repartition("key").withColumns({"window": _unpacked(), "around": around, "to": F.shiftright(around, 16), "on": around.bitwiseAND(0xFFFF)})
    seen = seen.withColumns({"first": F.first("window").over(until(order)), "before": F.lag("window").over(order)})
    for half in ("to", "on", "around"):
        same = until(Window.partitionBy("key", half).orderBy(*place))
        seen = seen.withColumn(f"first_{half}", F.when(F.col(half) != 0, F.first("window").over(same)))
    others = F.array_distinct(F.array_compact(F.array("first", "before", "first_to", "first_on", "first_around")))
    bit = F.expr("shiftleft(1, CAST(key & 7 AS INT))")
    pairs = seen.where("before IS NOT NULL").select(bit.alias("bit"), F.col("window").alias("x"), F.explode(others).alias("y"))
    pairs = pairs.where("NOT (x.me <=> y.me)").select(F.col("x.me").alias("later"), F.col("y.me").alias("earlier"), "bit", *_where_to_look())
    width = min_words - SHINGLE + 1
    points = F.sequence(F.ceil(F.col("begin_x") / width), F.greatest(F.ceil(F.col("end_x") / width) - 1, F.ceil(F.col("begin_x") / width)))
    shared = pairs.select("*", F.explode(points).alias("point")).groupBy("later", "earlier", "point").agg(
        F.bit_count(F.bit_or("bit")).alias("hashes"), *_ranges()
    )
    return shared.where(F.col("hashes") >= min_hashes).groupBy("later", "earlier").agg(*_ranges())


def _where_to_look() -> list[Column]:
    """Ranges of the windows x and y in which a shared passage can lie: it holds the least shingle
    of both and is no longer than the shorter one."""
    reach = F.expr("least(x.end - x.begin, y.end - y.begin)")
    low = lambda side: F.greatest(F.col(f"{side}.begin"), F.col(f"{side}.least") - reach)
    high = lambda side: F.least(F.col(f"{side}.end"), F.col(f"{side}.least") + reach)
    return [low("x").alias("begin_x"), high("x").alias("end_x"), low("y").alias("begin_y"), high("y").alias("end_y")]


def _ranges() -> list[Column]:
    return [f(name).alias(name) for f, name in ((F.min, "begin_x"), (F.max, "end_x"), (F.min, "begin_y"), (F.max, "end_y"))]


def _best(held: np.ndarray, penalty: int) -> tuple[int, int]:
    """The segment with the greatest score: +1 where held, -penalty elsewhere."""
    total = np.concatenate([[0], np.cumsum(np.where(held, 1, -penalty))])
    stop = int(np.argmax(total - np.minimum.accumulate(total)))
    return int(np.argmin(total[: stop + 1])), stop


def _longest(held: np.ndarray, least: int) -> tuple[int, int] | None:
    """The longest segment in which 8 of 9 shingles are held, if it has ``least`` places; two
    passages of one length with fewer common shingles are below 0.8.  Ends that are not held go as
    long as ``least`` places stay."""
    total = np.concatenate([[0], np.cumsum(np.where(held, 1, -8))])
    high = np.maximum.accumulate(total[::-1])[::-1]
    reach = np.searchsorted(-high, -total, side="right") - 1
    start = int(np.argmax(reach - np.arange(len(total))))
    stop = int(reach[start])
    if stop - start < least:
        return None
    while stop - start > least and not held[start]:
        start += 1
    while stop - start > least and not held[stop - 1]:
        stop -= 1
    return start, stop


def passages(x: np.ndarray, y: np.ndarray, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """First word and words of the passage in x and in y, and their similarity.

    A stretch without a segment of ``_longest`` holds no passage.  In others the segments of best
    score are tried from lenient to strict, which join a passage over its changed words but not
    over foreign text, then the longest; what lies beside an accepted one is looked at anew.  An end of up to ten
    shingles behind a changed word may be left out of a passage that is long enough without it.
    """
    width = min_words - SHINGLE + 1
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    at = np.minimum(np.searchsorted(ranked, x), len(y) - 1)
    held = ranked[at] == x

    def match(begin: int, end: int) -> tuple[int, int, int, int, float] | None:
        places = order[at[begin:end]][held[begin:end]]
        # The same shingles may occur elsewhere in y: keep those along the passage's own diagonal.
        shift = places - (begin + np.flatnonzero(held[begin:end]))
        along = places[np.abs(shift - np.median(shift)) <= (end - begin) // 4 + SHINGLE]
        if not len(along):
            return None
        first, last = int(along.min()), int(along.max()) + 1
        mine, other = np.unique(x[begin:end]), np.unique(y[first:last])
        common = len(np.intersect1d(mine, other, assume_unique=True))
        similarity = common / (len(mine) + len(other) - common)
        return (begin, end - begin + SHINGLE - 1, first, last - first + SHINGLE - 1, similarity) if similarity >= threshold else None

    found = []
    todo = [(0, len(x))]
    while todo:
        begin, end = todo.pop()
        part = held[begin:end]
        longest = _longest(part, width) if end - begin >= width else None
        if longest is None:
            continue
        start, stop = longest
        for penalty in (2, 4, 8, None):
            a, b = longest if penalty is None else _best(part, penalty)
            passage = match(begin + a, begin + b) if b - a >= width and 9 * int(part[a:b].sum()) >= 8 * (b - a) else None
            if passage:
                found.append(passage)
                start, stop = a, b
                break
        todo += [(begin, begin + start), (begin + stop, end)]
    return found


_PASSAGE = (
    "doc_id long, tag long, first_word long, n_words long, source_id long, source_first_word long, source_n_words long, similarity double"
)


def _sequence(text: str) -> np.ndarray:
    part = next(slices(pa.array([text], pa.large_string())))[2]
    return part.shingles()[0]


def verified(pairs: DataFrame, texts: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Passages of the pairs; ``texts`` has me (doc_id, tag) and text.

    The ranges of the earlier texts are cut out first, so that only these are dealt to the later
    texts: a long text that many others refer to is sent once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            column, parts = batch.column("text"), []
            for r, (begin, end) in enumerate(zip(batch.column("begin_y").to_pylist(), batch.column("end_y").to_pylist(), strict=True)):
                text = column[r].as_py()
                if text != known[0]:
                    known = (text, _sequence(text))
                parts.append(known[1][begin:end].view(np.int64))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            excerpt = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            names = ["later", "source_id", "begin_x", "end_x", "begin_y"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], excerpt], names=[*names, "excerpt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tag", "first_word", "n_words", "source_id", "source_first_word", "source_n_words", "similarity"]
        kinds = [pa.int64()] * 7 + [pa.float64()]
        known: tuple = (None, None)
        for batch in batches:
            rows = []
            text, excerpt = batch.column("text"), batch.column("excerpt")
            fixed = [batch.column(n).to_pylist() for n in ("later", "source_id", "begin_x", "end_x", "begin_y")]
            for r, (later, source, begin_x, end_x, begin_y) in enumerate(zip(*fixed, strict=True)):
                if text[r].as_py() != known[0]:
                    known = (text[r].as_py(), _sequence(text[r].as_py()))
                x, y = known[1][begin_x:end_x], excerpt[r].values.to_numpy().view(np.uint64)
                if len(x) and len(y):
                    for a, n, b, m, s in passages(x, y, min_words, threshold):
                        rows.append((later["doc_id"], later["tag"], begin_x + a, n, source, begin_y + b, m, s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    first = pairs.join(texts.withColumnRenamed("me", "earlier"), "earlier").select(
        "later", F.col("earlier.doc_id").alias("source_id"), "begin_x", "end_x", "begin_y", "end_y", "text"
    )
    excerpts = first.mapInArrow(
        cut, "later struct<doc_id: long, tag: long>, source_id long, begin_x int, end_x int, begin_y int, excerpt array<long>"
    )
    return excerpts.join(texts.withColumnRenamed("me", "later"), "later").mapInArrow(run, _PASSAGE)


def open_windows(met: DataFrame, found: DataFrame) -> DataFrame:
    """Windows (key, window, open) of the hashes that still have partners for an open window: one
    whose least shingle lies in no passage of ``found``.

    Up to three windows of a hash have all met in the first round, and the first has none to meet.
    """
    span = F.struct(F.col("first_word").alias("a"), (F.col("first_word") + F.col("n_words") - SHINGLE + 1).alias("b"))
    spans = found.groupBy(F.struct("doc_id", "tag").alias("me")).agg(F.collect_list(span).alias("spans"))
    placed = met.where("n > 3").select("key", "place", F.struct("doc_id", "tag").alias("me"), _unpacked().alias("window")).join(spans, "me", "left")
    settled = F.exists("spans", lambda p: (p["a"] <= F.col("window.least")) & (F.col("window.least") < p["b"]))
    is_open = (F.col("place") > 1) & ~F.coalesce(settled, F.lit(False))
    marked = placed.groupBy("key", "window").agg(F.max(is_open).alias("open"))
    return marked.withColumn("any", F.max("open").over(Window.partitionBy("key"))).where("any").drop("any")


def zones(members: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``members`` with the zone of every window: its shingles (32 bits each) up to the least width
    to both sides of the least one, and the ``spot`` of that one among them."""
    width = min_words - SHINGLE + 1
    row = F.struct("key", "window.begin", "window.least", "window.end", "open")
    wanted = members.groupBy("window.me").agg(F.collect_list(row).alias("rows"))
    held = docs.select(F.struct("doc_id", "tag").alias("me"), "text").join(broadcast_if_small(wanted), "me")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in slices(batch.column("text")):
                hashes, at = part.shingles()
                ptr = np.searchsorted(part.word_doc[at], np.arange(part.n_docs + 1))
                lists, mes = (batch.column(c).slice(first, last - first) for c in ("rows", "me"))
                rows, doc = lists.flatten(), np.repeat(np.arange(last - first), np.diff(lists.offsets.to_numpy()))
                begin, least, end = (rows.field(n).to_numpy().astype(np.int64) for n in ("begin", "least", "end"))
                low, high = np.maximum(begin, least - width + 1), np.minimum(end, least + width)
                stops = np.concatenate([[0], np.cumsum(high - low)])
                picked = hashes[np.arange(stops[-1]) + np.repeat(ptr[doc] + low - stops[:-1], high - low)]
                zone = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array((picked >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                arrays = [rows.field("key"), mes.take(pa.array(doc)), *(rows.field(n) for n in ("begin", "least", "end", "open")), pa.array((least - low).astype(np.int32)), zone]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "me", "begin", "least", "end", "open", "spot", "zone"])

    schema = "key long, me struct<doc_id: long, tag: long>, begin int, least int, end int, open boolean, spot int, zone array<int>"
    return in_batches(held.select("me", "text", "rows"), run, schema)


class _Block:
    """Windows of one hash with their zones, in numpy."""

    def __init__(self, rows: pa.StructArray):
        zone = rows.field("zone")
        self.rows, self.open = rows, rows.field("open").to_numpy(zero_copy_only=False).astype(bool)
        self.spot, self.least = rows.field("spot").to_numpy(), rows.field("least").to_numpy()
        self.ptr = zone.offsets.to_numpy() - zone.offsets[0].as_py()
        self.marks = zone.flatten().to_numpy()
        self.owner = np.repeat(np.arange(len(rows)), np.diff(self.ptr))
        doc = rows.field("me").field("doc_id")
        self.named = doc.is_valid().to_numpy(zero_copy_only=False)
        self.doc, self.tag = doc.fill_null(0).to_numpy(), rows.field("me").field("tag").to_numpy()

    def zone(self, i: int) -> np.ndarray:
        return self.marks[self.ptr[i] : self.ptr[i + 1]]


def _after(x: _Block, i: np.ndarray, y: _Block, j: np.ndarray) -> np.ndarray:
    """Where window i of x is of a later document than window j of y; null ids come first."""
    doc, tag = x.doc[i], x.tag[i]
    same = x.named[i] == y.named[j]
    return (x.named[i] & ~y.named[j]) | (same & ((doc > y.doc[j]) | ((doc == y.doc[j]) & (tag > y.tag[j]))))


def _stretches(held: np.ndarray, spot: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of the longest stretch around ``spot`` of each row in which 8 of 9 are
    held; both 0 where none has ``width`` places."""
    n = held.shape[1]
    total = np.concatenate([np.zeros((len(held), 1), np.int32), np.cumsum(np.where(held, 1, -8), axis=1, dtype=np.int32)], axis=1)
    best, first, end = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
    stops = np.arange(n + 1)
    for begin in range(min(spot, n - width) + 1):
        low = max(begin + width, spot + 1)
        good = total[:, low:] >= total[:, begin, None]
        stop = np.where(good, stops[low:], 0).max(axis=1)
        longer = stop - begin > best
        best[longer], first[longer], end[longer] = stop[longer] - begin, begin, stop[longer]
    return first, end


def _shared(x_row: np.ndarray, x_at: np.ndarray, y_row: np.ndarray, y_at: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """How many places of every window of x hold a shingle of every window of y.

    Shingles of a few pairs are counted pair by pair, those of many as a product of matrices.
    """
    n_x, n_y, n_marks = shape
    pair = np.unique(y_at * n_y + y_row)
    y_at, y_row = pair // n_y, pair % n_y
    n_pairs = np.bincount(x_at, minlength=n_marks) * np.bincount(y_at, minlength=n_marks)
    order = np.argsort(x_at, kind="stable")
    starts = np.searchsorted(x_at[order], np.arange(n_marks + 1))
    few = n_pairs[y_at] <= _FEW
    sizes = np.where(few, starts[y_at + 1] - starts[y_at], 0)
    at = np.arange(sizes.sum()) + np.repeat(starts[y_at] - (np.cumsum(sizes) - sizes), sizes)
    cell = x_row[order][at] * n_y + np.repeat(y_row, sizes)
    common = np.bincount(cell, minlength=n_x * n_y).reshape(n_x, n_y).astype(np.float32)
    many = np.flatnonzero(n_pairs > _FEW)
    number = np.full(n_marks, -1)
    number[many] = np.arange(len(many))
    for begin in range(0, len(many), 1 << 13):
        size = min(1 << 13, len(many) - begin)
        one, two = np.zeros((n_x, size), np.float32), np.zeros((n_y, size), np.float32)
        for side, row, col in ((one, x_row, number[x_at]), (two, y_row, number[y_at])):
            inside = (col >= begin) & (col < begin + size)
            np.add.at(side, (row[inside], col[inside] - begin), 1)
        common += one @ two.T
    return common


def _meeting(x: _Block, y: _Block, width: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Open windows of x and windows of earlier documents in y whose zones hold a common passage.

    Zones that hold too few of the other block's shingles go first, so texts that only share a
    phrase cost no more than sorting them.  Windows of y with the same zone are one, the first.  A
    window of x takes those of y with the longest stretch first, and no further one whose stretch
    lies inside a passage it has, so the number of pairs follows that of the windows.
    """
    need = -(-8 * width // 9)
    asked = x.open[x.owner] & np.isin(x.marks, y.marks)
    rows = np.flatnonzero(np.bincount(x.owner[asked], minlength=len(x.rows)) >= need)
    if not len(rows):
        return rows, rows
    asked &= np.isin(x.owner, rows)
    offered = np.isin(y.marks, x.marks[asked])
    order = np.lexsort((y.least, y.tag, y.doc, y.named))
    others, seen = [], set()
    for j in order[np.isin(order, y.owner[offered])]:
        known = (int(y.spot[j]), y.zone(j).tobytes())
        if known not in seen:
            seen.add(known)
            others.append(j)
    others = np.array(others, np.int64)
    had: dict[int, list[tuple[int, int]]] = {}
    found: list[tuple[int, int]] = []
    for p in range(0, len(rows), _ROWS):
        mine = rows[p : p + _ROWS]
        own = asked & np.isin(x.owner, mine)
        known, x_at = np.unique(x.marks[own], return_inverse=True)
        for q in range(0, len(others), _ROWS):
            theirs = others[q : q + _ROWS]
            place = np.full(len(y.rows), -1)
            place[theirs] = np.arange(len(theirs))
            at = np.minimum(np.searchsorted(known, y.marks), len(known) - 1)
            hit = offered & (place[y.owner] >= 0) & (known[at] == y.marks)
            holds = np.zeros((len(theirs), len(known)), bool)
            holds[place[y.owner[hit]], at[hit]] = True
            common = _shared(np.searchsorted(mine, x.owner[own]), x_at, place[y.owner[hit]], at[hit], (len(mine), len(theirs), len(known)))
            for i, shared in zip(mine.tolist(), common, strict=True):
                j = np.flatnonzero(shared >= need)
                j = j[_after(x, np.full(len(j), i), y, theirs[j])]
                if not len(j):
                    continue
                zone, mine_had = x.zone(i), had.setdefault(i, [])
                where = np.minimum(np.searchsorted(known, zone), len(known) - 1)
                a, b = _stretches(holds[j][:, where] & (known[where] == zone), int(x.spot[i]), width)
                for r in np.argsort(a - b, kind="stable").tolist():
                    if b[r] > a[r] and not any(c <= a[r] and b[r] <= d for c, d in mine_had):
                        got = [(g[0], g[0] + g[1] - SHINGLE + 1) for g in passages(zone, y.zone(theirs[j[r]]), width + SHINGLE - 1, threshold)]
                        if any(not any(c <= g and h <= d for c, d in mine_had) for g, h in got):
                            mine_had += got
                            found.append((i, int(theirs[j[r]])))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _promising(lists: pa.ListArray, need: int) -> np.ndarray:
    """Of many blocks at a time, those with an open window of which others hold enough shingles."""
    rows = lists.flatten()
    zone = rows.field("zone")
    block = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    owner = np.repeat(np.arange(len(rows)), np.diff(zone.offsets.to_numpy()))
    marks = mix(zone.flatten().to_numpy().view(np.uint32).astype(np.uint64) | block[owner].astype(np.uint64) << np.uint64(32))
    # Equal shingles of a block lie together, those of a window in its order.
    order = np.argsort(marks, kind="stable")
    ranked, who = marks[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(ranked)))
    common = np.repeat(who[starts] != who[starts + sizes - 1], sizes) if len(ranked) else np.zeros(0, bool)
    shared = np.bincount(who[common], minlength=len(rows))
    good = (shared >= need) & rows.field("open").to_numpy(zero_copy_only=False).astype(bool)
    return np.unique(block[good])


def late_candidates(members: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (later, earlier) of the second round and where to look in both; ``members`` are those
    of ``open_windows``.

    The windows of a hash are one block, or if they are many, dealt into blocks of about ``BLOCK`` of
    which every two meet in a task.
    """
    width = min_words - SHINGLE + 1
    split = keep(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "split-hashes")
    row = F.struct("me", "begin", "least", "end", "open", "spot", "zone")
    small = members if split.isEmpty() else members.join(broadcast_if_small(split), "key", "left_anti")
    rows = zones(small, docs, min_words).groupBy("key").agg(F.collect_list(row).alias("xs")).where("size(xs) > 1")
    sides = rows.select("xs", F.lit(None).cast(rows.schema["xs"].dataType).alias("ys"))
    if not split.isEmpty():
        large = zones(members.join(broadcast_if_small(split), "key", "left_semi"), docs, min_words).join(broadcast_if_small(split), "key")
        block = F.pmod(F.xxhash64("me", "least"), F.col("blocks")).cast("int").alias("i")
        dealt = keep(large.groupBy("key", "blocks", block).agg(F.collect_list(row).alias("xs")), "window-blocks")
        one = dealt.select("key", "i", "xs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).where("i <> j")
        two = dealt.select("key", F.col("i").alias("j"), F.col("xs").alias("ys"))
        sides = sides.unionByName(dealt.select("xs", F.lit(None).cast(rows.schema["xs"].dataType).alias("ys")))
        sides = sides.unionByName(one.join(two, ["key", "j"]).select("xs", "ys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paired = batch.column("ys").is_valid().to_numpy(zero_copy_only=False)
            good = np.flatnonzero(paired) if paired.all() else np.union1d(np.flatnonzero(paired), _promising(batch.column("xs"), -(-8 * width // 9)))
            for r in good.tolist():
                x = _Block(batch.column("xs")[r].values)
                y = _Block(batch.column("ys")[r].values) if paired[r] else x
                i, j = _meeting(x, y, width, threshold)
                if len(i):
                    arrays = []
                    for side, at in ((x, i), (y, j)):
                        picked = side.rows.take(pa.array(at))
                        arrays.append(pa.StructArray.from_arrays([picked.field(n) for n in ("me", "begin", "least", "end")], ["me", "begin", "least", "end"]))
                    yield pa.RecordBatch.from_arrays(arrays, names=["x", "y"])

    kind = "struct<me: struct<doc_id: long, tag: long>, begin: int, least: int, end: int>"
    pairs = in_batches(sides, run, f"x {kind}, y {kind}")
    return pairs.select(F.col("x.me").alias("later"), F.col("y.me").alias("earlier"), *_where_to_look()).groupBy("later", "earlier").agg(*_ranges())


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, first_word, n_words, source_id, source_first_word, source_n_words and similarity of
    every maximal passage of a document that an earlier document holds."""
    tag = F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").cast("long"), tag.alias("tag"), text_key().alias("text_key"), "text").where("text IS NOT NULL")
    groups = keyed.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    copied = keep(groups.where("n > 1").select("text_key", F.col("first.doc_id").alias("first_id")), "copied-texts")
    placed = keyed.join(broadcast_if_small(copied.withColumn("copied", F.lit(True))), "text_key", "left")
    single = placed.where(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "tag", "text")
    copies = placed.where(F.col("copied") & ~F.col("doc_id").eqNullSafe(F.col("first_id")))

    def looked_at(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("later").alias("me")).unionByName(pairs.select(F.col("earlier").alias("me"))).distinct()
        held = single.select(F.struct("doc_id", "tag").alias("me"), "text").join(broadcast_if_small(wanted), "me")
        texts = keep(held.groupBy("me").agg(F.first("text").alias("text")), "passage-texts")
        return keep(verified(pairs, texts, min_words, threshold), "passages")

    met = keep(together(windows(single, min_words)), "shared-windows")
    found = looked_at(keep(candidates(met, min_words), "passage-pairs"))
    members = keep(open_windows(met, found), "open-windows")
    late = keep(late_candidates(members, single, min_words, threshold), "passage-pairs")
    found = found.unionByName(looked_at(late))
    # Passages of one document: those inside another are left out.
    order = Window.partitionBy("doc_id", "tag").orderBy("first_word", F.desc("n_words"), F.col("source_id").asc_nulls_first(), "source_first_word")
    end = F.col("first_word") + F.col("n_words")
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    maximal = found.withColumn("reached", reached).where(F.col("reached").isNull() | (end > F.col("reached")))
    columns = ["doc_id", "first_word", "n_words", "source_id", "source_first_word", "source_n_words", "similarity"]
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    whole = copies.withColumn("n", n).where("n > 0").select(
        "doc_id", F.lit(0).cast("long").alias("first_word"), F.col("n").alias("n_words"), F.col("first_id").alias("source_id"),
        F.lit(0).cast("long").alias("source_first_word"), F.col("n").alias("source_n_words"), F.lit(1.0).alias("similarity"),
    )
    return maximal.select(*columns).unionByName(whole.distinct())
