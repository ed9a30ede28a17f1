"""Chunking against a plain loop written from the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from haulmark.functions import text as tx
from haulmark.operators.chunking import chunk_documents, split_sections

HEADERS = ["# Title", "   ## Sub  ", "LOSS HISTORY", "A-B CD  ", "3.1 Rules", "12. Scope", "section 4", "PART 9 x", "Required documents for review:"]
PLAIN = ["#", "#####  x", "ABC", "ABCD   ", "3 Rules", "3.1 rules", "Sections", "Short:", "plain text", "", "   ", "é: 5", "Ab" + "x" * 9 + ":"]


def header(line):
    line = line.strip()
    tests = (
        re.match(r"#{1,4}\s+\S", line),
        re.fullmatch(r"[A-Z][A-Z\s\-]{4,}", line),
        re.match(r"\d+\.\d*\s+[A-Z]", line),
        re.match(r"(section|article|part|chapter)\s+\d", line, re.I),
        re.fullmatch(r"[A-Z][a-z].{10,}:", line),
    )
    return any(tests)


def windows(text, size, overlap):
    if len(text) <= size:
        return [text]
    starts = range(0, len(text), size - overlap)
    return [text[s : s + size] for s in starts if s == 0 or s + overlap < len(text)]


def expected(doc, text, parent, child, overlap):
    parts = []
    for line in text.split("\n"):
        if not parts or header(line):
            parts.append([])
        parts[-1].append(line)
    out, at = set(), 0
    texts = [t for t in ("\n".join(p) for p in parts) if t.strip()]
    for i, part in enumerate(texts):
        for j, piece in enumerate(windows(part, parent, overlap // 2)):
            pid = f"P-{doc}-{i}-{j}"
            out.add((pid, None, piece.strip(), at, at + len(piece)))
            for k, c in enumerate(windows(piece.strip(), child, overlap)):
                start = at + k * (child - overlap)
                out.add((f"C-{pid}-{k}", pid, c.strip(), start, start + len(c)))
            at += len(piece)
    return out


def documents(spark, texts):
    rows = [(str(i), "c", f"/vol/c/{i}.pdf", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, category string, source_path string, parsed_text string")


def texts():
    rnd = random.Random(5)
    made = ["", "  \n  ", "x", "x" * 59, "x" * 60, "x" * 61, "é😀" * 150, "# A\n# B\n# C", "\n \n# A\nb", "x" * 250, "x" * 251, "a \n " * 90]
    for _ in range(60):
        lines = [rnd.choice(HEADERS + PLAIN + ["word " * rnd.randint(1, 90)]) for _ in range(rnd.randint(1, 30))]
        made.append("\n".join(lines))
    return made


def test_chunks_match_plain_loop(spark):
    made = texts()
    got = chunk_documents(documents(spark, made), 250, 60, 20).collect()
    rows = {(r.chunk_id, r.parent_id, r.chunk_text, r.char_start, r.char_end) for r in got}
    want = set()
    for i, t in enumerate(made):
        if t.strip():
            want |= expected(str(i), t, 250, 60, 20)
    assert rows == want
    assert len(got) == len(want)


def test_children_lie_in_document_at_true_start(spark):
    made = texts()
    for r in chunk_documents(documents(spark, made), 250, 60, 20).where("chunk_type = 'child'").collect():
        assert made[int(r.doc_id)][r.true_start :].lstrip().startswith(r.chunk_text)


def test_same_ids_on_every_run(spark):
    docs = documents(spark, texts())
    ids = lambda: sorted(r.chunk_id for r in chunk_documents(docs).collect())
    first = ids()
    assert first == ids()
    assert len(set(first)) == len(first)


def test_headers(spark):
    rows = spark.createDataFrame([(l,) for l in HEADERS + PLAIN], "line string")
    got = {r.line: r.h for r in rows.select("line", tx.is_section_header(F.col("line")).alias("h")).collect()}
    assert got == {l: header(l) for l in HEADERS + PLAIN}


def test_windows_restore_the_text(spark):
    for n in (0, 1, 59, 60, 61, 100, 101, 999, 1000):
        t = "".join(chr(97 + i % 26) for i in range(n))
        got = spark.range(1).select(tx.slide(F.lit(t), 60, 20).alias("w")).first().w
        assert got == windows(t, 60, 20)
        assert got[0] + "".join(w[20:] for w in got[1:]) == t


def test_sections_of_blank_document(spark):
    assert split_sections(documents(spark, ["", " \n "])).count() == 0


def test_sizes_are_checked(spark):
    docs = documents(spark, ["x"])
    with pytest.raises(ValueError):
        chunk_documents(docs, 100, 100, 10)
    with pytest.raises(ValueError):
        chunk_documents(docs, 100, 50, 50)


def test_no_shuffle(spark):
    plan = chunk_documents(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
