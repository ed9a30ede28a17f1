"""Best-fit packing into bins of several permitted sizes.

A document of n words fills n + 1 places, one for its end mark; longer ones than the largest bin
are cut into pieces.  Pieces are placed from the longest to the shortest into the open bin with
the least room that still takes them.  Where none does, a bin is opened, of the size that costs
least per place expected to be filled: the pieces still waiting are tried in it, longest first.
At the end every bin shrinks to the least permitted size that holds its contents.

Pieces are dealt by hash into shards of about ``SHARD_PIECES``, each packed in one task, so a task
never holds more than that and a shard wastes at most its few last bins.

Defined results: null and empty texts are one end mark; repeated rows are packed each for itself;
an empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.source_mixing import word_count
from haulmark.llm.tables import keep

SIZES = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 8192
BIN_COST = 24


def sequence_cost(size: int) -> float:
    """Cost of one sequence: its places and a fixed overhead."""
    return size + BIN_COST


class _Waiting:
    """Pieces that wait, by length; finds the longest that is not above a limit."""

    def __init__(self, lengths: Sequence[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.order = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.order.pop(bisect_left(self.order, n))

    def filled(self, room: int) -> int:
        """Places that longest-first filling would use of ``room``."""
        used, top = 0, bisect_right(self.order, room)
        while top and used < room:
            n = self.order[top - 1]
            used += n * min(self.count[n], (room - used) // n)
            top = min(top - 1, bisect_right(self.order, room - used))
        return used


def best_fit(lengths: Sequence[int], sizes: Sequence[int], cost: Callable[[int], float] = sequence_cost) -> list[tuple[int, int]]:
    """Bin number and size of the bin for every length; ``lengths`` must fall."""
    sizes = sorted(sizes)
    waiting = _Waiting(lengths)
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    placed = []
    for n in lengths:
        waiting.take(n)
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            fitting = [s for s in sizes if s >= n]
            room = min(fitting, key=lambda s: (cost(s) / (n + waiting.filled(s - n)), -s))
            number = len(used)
            used.append(0)
        used[number] += n
        left = room - n
        if left:
            if not by_room.setdefault(left, []):
                insort(rooms, left)
            by_room[left].append(number)
        placed.append(number)
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return [(number, final[number]) for number in placed]


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """doc_id, piece, start and length (in places) of every document."""
    sized = docs.select("doc_id", (word_count(F.col("text")) + 1).alias("places"))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("places") - 1) / longest))
    cut = sized.select("doc_id", "places", F.explode(numbers).alias("piece"))
    start = F.col("piece") * longest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("places") - start).cast("int").alias("length"))


def pack(docs: DataFrame, sizes: Sequence[int] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, bin, capacity and offset in the bin, one row per piece."""
    cut = keep(pieces(docs, max(sizes)), "pack-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    row = F.monotonically_increasing_id()
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", row), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        found = best_fit(table.column("length").to_pylist(), sizes)
        ends: dict[int, int] = {}
        offsets = []
        for (number, _), n in zip(found, table.column("length").to_pylist(), strict=True):
            offsets.append(ends.get(number, 0))
            ends[number] = offsets[-1] + n
        first = table.column("shard")[0].as_py() << 32
        columns = {name: table.column(name) for name in ("doc_id", "piece", "start", "length")}
        columns["bin"] = pa.array([first + number for number, _ in found], pa.int64())
        columns["capacity"] = pa.array([size for _, size in found], pa.int32())
        columns["offset"] = pa.array(offsets, pa.int32())
        return pa.table(columns)

    schema = "doc_id long, piece long, start long, length int, bin long, capacity int, offset int"
    return dealt.withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("shard").applyInArrow(run, schema)
