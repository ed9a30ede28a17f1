"""Column functions over text: whitespace, sections, windows, intents, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark import fixed_values as fv

_S, _I = fv.SPACE, fv.INLINE_SPACE

# One alternation for all five kinds of section header.  It is written against the raw
# line (surrounding blanks allowed) so that a document is cut by a single regex pass.
HEADER = (
    rf"[{_I}]*+(?:"
    rf"#{{1,4}}[{_I}]++[^{_S}]"  # markdown heading
    rf"|[A-Z][A-Z\-{_I}]{{3,}}[A-Z\-][{_I}]*+(?=\n|\z)"  # ALL CAPS line
    rf"|\p{{Nd}}++\.\p{{Nd}}*+[{_I}]++[A-Z]"  # 3.1 Title
    rf"|(?i:Section|Article|Part|Chapter)[{_I}]++\p{{Nd}}"  # Section 4
    rf"|[A-Z][a-z][^\n]{{10,}}:[{_I}]*+(?=\n|\z)"  # Title line ending in a colon
    rf")"
)


def strip(text: Column) -> Column:
    """Remove surrounding whitespace of every kind, not only blanks."""
    return F.trim(text, F.lit(fv.SPACE_CHARACTERS))


def indent(text: Column) -> Column:
    """Number of leading whitespace characters."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(fv.SPACE_CHARACTERS)))


def has_text(text: Column) -> Column:
    return text.rlike(rf"[^{_S}]")


def is_section_header(line: Column) -> Column:
    return line.rlike(rf"\A(?:{HEADER})")


def sections(text: Column) -> Column:
    """Split before every header line; the first line never starts a second section."""
    return F.split(text, rf"\n(?={HEADER})", -1)


def slide(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` characters; the last one reaches the end.

    A window starts only where more than ``overlap`` characters remain, which is the same
    as stopping at the first window that touches the end.  One regex scan, so the cost is
    linear in the text and no window is cut by seeking from the start again.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window size")
    step = size - overlap
    windows = F.regexp_extract_all(
        text, F.lit(rf"(?s)(?=(.{{{overlap + 1},{size}}})).{{1,{step}}}"), F.lit(1)
    )
    return F.when(F.length(text) <= size, F.array(text)).otherwise(windows)


def window_count(length: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    extra = F.ceil((length - F.lit(size)) / F.lit(float(step)))
    return F.when(length <= size, F.lit(1)).otherwise(extra.cast("int") + 1)


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when any needle is a substring of ``text``; callers pass lowered text."""
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def detect_intent(question: Column, sql_keywords: list[str] | None = None) -> Column:
    """keyword when a reference id occurs, sql when a keyword occurs, else hybrid."""
    keywords = fv.SQL_KEYWORDS if sql_keywords is None else sql_keywords
    return (
        F.when(question.rlike(fv.REFERENCE_ID), "keyword")
        .when(contains_any(F.lower(question), keywords), "sql")
        .otherwise("hybrid")
    )


def reference_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fv.REFERENCE_ID), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased search terms; hyphens and underscores keep reference ids whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))


def display_name(stem: Column, suffixes: list[str] | None = None) -> Column:
    """Readable name of a file stem: cut at the first listed suffix, blanks, title case."""
    suffixes = fv.FILE_STEM_SUFFIXES if suffixes is None else suffixes
    lowered = F.lower(stem)
    name = stem
    for suffix in reversed(suffixes):
        at = F.instr(lowered, suffix)
        name = F.when(at > 1, F.substring(stem, F.lit(1), at - 1)).otherwise(name)
    return strip(F.initcap(F.translate(name, "_-", "  ")))


def strip_fences(sql: Column) -> Column:
    """Drop a leading markdown fence line and a trailing fence from generated text."""
    body = strip(sql)
    opened = F.when(
        body.startswith("```"),
        F.when(body.contains("\n"), F.regexp_replace(body, r"(?s)\A[^\n]*\n", "")).otherwise(
            F.substring(body, 4, 1 << 30)
        ),
    ).otherwise(body)
    return strip(F.regexp_replace(opened, r"```\z", ""))


def sql_verdict(sql: Column) -> Column:
    """Audit verdict of one generated statement, naming the first blocked keyword."""
    body = F.upper(strip(sql))
    verdict = F.when((body == "") | body.startswith("--"), F.lit("NO_ANSWER"))
    for word in fv.BLOCKED_STATEMENTS:
        verdict = verdict.when(body.rlike(rf"\b{word}\b"), F.lit(f"BLOCKED_{word}"))
    return verdict.when(~body.startswith("SELECT"), F.lit("NOT_SELECT")).otherwise(F.lit("ALLOWED"))


def normalize_ratio(ratio: Column) -> Column:
    """Ratios above 1 are percentages and are scaled down; NULL counts as 0."""
    value = F.coalesce(ratio.cast("double"), F.lit(0.0))
    return F.when(value > 1, value / 100).otherwise(value)
