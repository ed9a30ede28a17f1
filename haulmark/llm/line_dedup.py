"""Line dedup: repeated runs of lines by prefix doubling over line ids; later copies go.

All texts form one sequence of line ids (lines without a word are passed over and stay).  Suffixes
are told apart by prefix doubling: at level k every suffix carries the name of its first 2**k
lines, and the name of 2**(k + 1) lines is made of the names of two halves.  Suffixes with the
same name are an interval of the suffix array in which the longest common prefix is 2**k or more,
so the names of the levels are the tree of those intervals.  A name is the place of the first
suffix of the interval, which is all that deletion has to know of the order: which suffixes share
a prefix, and which of them comes first.  A suffix that is alone in its interval is in none of the
deeper ones and drops out, so levels shrink and end with the longest repeated run.

The longest common prefixes reveal the maximal runs of at least ``min_lines`` lines of which an
earlier copy exists, and all lines of these are deleted.  A run of one line is deleted, too, where
the line has at least ``long_line`` words; shorter lines stay when they are repeated alone.

The order is that of doc_id (null first), then of the text's key, then of lines; runs end with
their text.  Everything is DataFrame functions; names are counted and joined and never gathered,
so a frequent line is no hot group, and every level is written to the shared folder.

Defined results: lines without a word that lie inside a deleted run go with it; a null text stays null; a text of which all lines go becomes empty; rows with the
same id and text are one document and get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.tables import keep, text_key
from haulmark.sources.sizing import broadcast_if_small

MIN_LINES = 2
LONG_LINE = 50
_HAS_WORD = r"[^\x20\x09-\x0D]"
_WORD = _HAS_WORD + "+"


def line_table(docs: DataFrame, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, text_key, start (place of the first line) and lines (number in the text, id, whether
    it has ``long_line`` words) of every different document; places follow the order of documents
    without gaps."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("id"), F.regexp_count(x, F.lit(_WORD)).alias("words")))
    kept = lambda x: F.struct(x["i"].alias("i"), x["id"].alias("id"), (x["words"] >= long_line).alias("long"))
    held = F.transform(F.filter(lines, lambda x: x["words"] > 0), kept)
    given = docs.where("text IS NOT NULL").select("doc_id", text_key().alias("text_key"), held.alias("lines"))
    unique = keep(given, "lines").groupBy("doc_id", "text_key").agg(F.first("lines").alias("lines"))
    ordered = unique.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    numbered = ordered.withColumn("number", F.monotonically_increasing_id()).withColumn("n", F.size("lines").cast("long"))
    numbered = keep(numbered, "line-docs").withColumn("part", F.shiftright("number", 33))
    # One row per partition of the range.
    parts = numbered.groupBy("part").agg(F.sum("n").alias("part_n"))
    base = parts.select("part", (F.sum("part_n").over(Window.orderBy("part")) - F.col("part_n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("number")) - F.col("n")
    return numbered.join(broadcast_if_small(base), "part").select("doc_id", "text_key", "lines", "n", (F.col("base") + inside).alias("start"))


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` occurs twice or more, with the first place of it as ``name``."""
    groups = rows.groupBy(*by).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(groups, by).select("pos", "left", "doc", F.col("first").alias("name"))


def _positions(table: DataFrame) -> DataFrame:
    """pos, left (lines to the end of the text), doc, id and long of all lines."""
    at = table.select("start", "n", F.posexplode("lines").alias("i", "line"))
    return at.select(
        (F.col("start") + F.col("i")).alias("pos"), (F.col("n") - F.col("i")).alias("left"), F.col("start").alias("doc"), "line.id", "line.long"
    )


def long_copies(table: DataFrame) -> DataFrame:
    """pos, doc, source and length of the long lines of which an earlier copy exists."""
    named = _named(_positions(table).where("long"), ["id"]).where("name < pos")
    return named.select("pos", "doc", F.col("name").alias("source"), F.lit(1).cast("long").alias("length"))


def doubling_levels(table: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: pos, left (lines to the end of the text), doc (its first place) and name
    of all suffixes whose first 2**k lines occur elsewhere, too."""
    levels = [keep(_named(_positions(table), ["id"]), "level")]
    while not levels[-1].isEmpty():
        step = 1 << (len(levels) - 1)
        level = levels[-1]
        right = level.select((F.col("pos") - step).alias("pos"), F.col("name").alias("right"))
        joined = level.where(F.col("left") >= 2 * step).join(right, "pos").select("pos", "left", "doc", "name", "right")
        levels.append(keep(_named(keep(joined, "halves"), ["name", "right"]), "level"))
    return levels[:-1]


def _depth(levels: list[DataFrame], lines: int) -> DataFrame | None:
    """pos, doc and name of the suffixes whose first ``lines`` lines occur elsewhere, too."""
    k = lines.bit_length() - 1
    if k >= len(levels):
        return None
    rest = lines - (1 << k)
    if not rest:
        return levels[k].select("pos", "doc", "name")
    right = levels[k].select((F.col("pos") - rest).alias("pos"), F.col("name").alias("right"))
    joined = levels[k].where(F.col("left") >= lines).join(right, "pos").select("pos", "left", "doc", "name", "right")
    return _named(keep(joined, "halves"), ["name", "right"]).select("pos", "doc", "name")


def later_copies(levels: list[DataFrame], min_lines: int) -> DataFrame | None:
    """pos, doc and name of suffixes of whose first ``min_lines`` lines an earlier copy exists."""
    found = _depth(levels, min_lines)
    return None if found is None else found.where("name < pos")


def repeated_runs(levels: list[DataFrame], min_lines: int = MIN_LINES) -> DataFrame | None:
    """pos, doc, source and length of the maximal runs of which an earlier copy lies at ``source``.

    A run begins where the line before it doesn't continue the same copy, so no run holds a later
    copy that is in none of them.  The source is the first member of the deepest interval that has
    an earlier member (of ``min_lines`` lines where no deeper one has); the length is the exact
    common prefix of the two, found by going down the levels.  A name that lies in the next text
    doesn't lengthen a run.
    """
    later = later_copies(levels, min_lines)
    if later is None:
        return None
    before = later.select((F.col("pos") + 1).alias("pos"), (F.col("name") + 1).alias("continued"))
    # Single lines next to each other may lie in two texts: each begins a run.
    new = F.lit(min_lines == 1) | F.col("continued").isNull() | (F.col("continued") != F.col("name"))
    begins = keep(later.join(before, "pos", "left").where(new).select("pos", "doc", F.col("name").alias("first")), "begins")
    runs = begins.select("pos", "doc", "first", F.lit(None).cast("long").alias("source"), F.lit(0).cast("long").alias("length"))
    for k in reversed(range(len(levels))):
        if k == min_lines.bit_length() - 1:
            length = F.when(F.col("source").isNull(), F.lit(min_lines).cast("long")).otherwise(F.col("length"))
            runs = runs.withColumns({"length": length, "source": F.coalesce("source", "first")})
        names = levels[k].select(F.col("pos").alias("at"), F.col("doc").alias("doc_at"), "name")
        other = names.select(F.col("at").alias("at2"), F.col("doc_at").alias("doc_at2"), F.col("name").alias("name2"))
        known = runs.withColumn("at", F.col("pos") + F.col("length")).withColumn("at2", F.col("source") + F.col("length"))
        met = known.join(names, "at", "left").join(other, "at2", "left")
        opened = F.col("source").isNull() & (F.col("name") < F.col("pos"))
        goes_on = (F.col("name") == F.col("name2")) & (F.col("doc_at") == F.col("doc")) & (F.col("doc_at2") <= F.col("source"))
        runs = met.select(
            "pos",
            "doc",
            "first",
            F.when(opened, F.col("name")).otherwise(F.col("source")).alias("source"),
            (F.col("length") + F.when(opened | goes_on, 1 << k).otherwise(0)).alias("length"),
        )
        runs = keep(runs, "runs")
    return runs.select("pos", "doc", "source", "length")


def deleted_lines(table: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, text_key and spans (first and last line number in the text) of what is deleted."""
    order = Window.partitionBy("doc").orderBy("pos", "length")
    reach = F.max(F.col("pos") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.select("doc", "pos", "length", F.when(reach.isNull() | (F.col("pos") > reach), F.col("pos")).alias("begin"))
    islands = islands.withColumn("begin", F.last("begin", ignorenulls=True).over(order))
    spans = islands.groupBy("doc", "begin").agg((F.max(F.col("pos") + F.col("length")) - 1).alias("end"))
    by_doc = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    # A text without lines begins where the next one does.
    found = table.where("n > 0").join(by_doc, F.col("start") == F.col("doc"))
    number = lambda place: F.element_at("lines", (place - F.col("start") + 1).cast("int"))["i"]
    return found.select("doc_id", "text_key", F.transform("spans", lambda s: F.struct(number(s["begin"]).alias("first"), number(s["end"]).alias("last"))).alias("spans"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """The rows of ``docs`` with all columns, ``text`` without later copies of runs of lines."""
    return _applied(docs, min_lines, long_line).select(*[F.col("new").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_counts(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, n_lines, n_deleted and text (what is left) of every row."""
    return _applied(docs, min_lines, long_line).select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.size(F.split("row.text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_deleted", F.lit(0)).cast("long").alias("n_deleted"),
        F.col("new").alias("text"),
    )


def _applied(docs: DataFrame, min_lines: int, long_line: int) -> DataFrame:
    """row (all columns), new (text that is left) and n_deleted."""
    table = keep(line_table(docs, long_line), "line-table")
    runs = repeated_runs(doubling_levels(table), min_lines)
    single = long_copies(table)
    runs = single if runs is None else runs.unionByName(single)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    spans = keep(deleted_lines(table, runs), "spans")
    rows = rows.withColumn("key", text_key("row.text")).alias("r")
    joined = rows.join(broadcast_if_small(spans.alias("s")), F.expr("r.row.doc_id <=> s.doc_id AND r.key = s.text_key"), "left").select("row", "spans")
    # The generator keeps the split from being planned into the function over the spans.
    cut = joined.withColumn("part", F.explode(F.array(F.when(F.col("spans").isNotNull(), F.split("row.text", "\n", -1)))))
    edges = F.concat(F.array(F.lit(-1)), F.transform("spans", lambda s: s["last"]))
    until = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.size("part")))
    pieces = F.transform(
        F.arrays_zip(edges.alias("after"), until.alias("until")),
        lambda e: F.slice("part", e["after"] + 2, e["until"] - e["after"] - 1),
    )
    new = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    n_deleted = F.aggregate("spans", F.lit(0), lambda total, s: total + s["last"] - s["first"] + 1)
    return cut.select("row", new.alias("new"), n_deleted.alias("n_deleted"))
