"""Repeated strings against a table of all strings of 200 bytes."""

import hashlib
import random
from collections import Counter

import pytest

from haulmark.llm import queries, suffix_dedup

SIZE = suffix_dedup.LENGTH


def plain(texts):
    """Spans of every text (bytes)."""
    seen = Counter(t[i : i + SIZE] for t in texts for i in range(len(t) - SIZE + 1))
    for t in texts:
        spans = []
        for i in range(len(t) - SIZE + 1):
            if seen[t[i : i + SIZE]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + SIZE
                else:
                    spans.append([i, i + SIZE])
        yield [tuple(s) for s in spans]


def prose(rng, size):
    return "".join(rng.choice("abcdeé ") for _ in range(size))


def awkward(seed, docs=60):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (90, 120, 150, 185, 199, 200, 201, 230, 300, 340, 500, 1200)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(prose(rng, rng.choice([0, 3, 40, 150, 400])))
            whole = rng.choice(shared)
            a = rng.choice([0, 0, 0, rng.randrange(60)])
            part = whole[a : len(whole) - rng.choice([0, 0, 0, rng.randrange(60)])]
            if rng.random() < 0.3 and part:
                k = rng.randrange(len(part))
                part = part[:k] + "X" + part[k + 1 :]
            parts.append(part)
        rows.append((i, "".join(parts)))
    rows += [(900, None), (901, ""), (902, "ab" * 300), (903, "x" * 450), (904, rows[3][1]), (3, rows[3][1]), (None, shared[-1]), (905, "x" * 100 + prose(rng, 700))]
    rng.shuffle(rows)
    return rows


def write(spark, rows, folder):
    frame = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, t1 int, kept string, row int")
    frame.write.parquet(f"{folder}/documents.parquet")
    return frame


def expected(rows):
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), t, spans in zip(rows, texts, plain(texts)):
        kept = b"".join(t[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)]))
        yield i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_query_equals_all_strings(spark, tmp_path, seed):
    rows = awkward(seed)
    write(spark, rows, tmp_path)
    got = queries.op12_suffix_dedup(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_buckets_beyond_a_task_give_the_same(spark):
    rows = awkward(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda df: sorted(map(str, df.collect()))
    assert order(suffix_dedup.repeated_strings(frame, bucket=3)) == order(suffix_dedup.repeated_strings(frame))


def test_long_texts_in_slices_have_the_anchors_of_short_ones(monkeypatch):
    rng = random.Random(5)
    text = (prose(rng, 9000) + "y" * 700 + prose(rng, 3000)).encode()
    ((_, at, gram),) = suffix_dedup.anchors([text])
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1000)
    ((_, at2, gram2),) = suffix_dedup.anchors([text])
    assert at.tolist() == at2.tolist() and gram.tolist() == gram2.tolist()
    ((_, at3, _),) = suffix_dedup.anchors([text[37:]])
    assert set(at3 + 37) <= set(at.tolist())


def test_deduplicated_keeps_columns(spark, tmp_path):
    frame = write(spark, awkward(6, 20), tmp_path)
    found = suffix_dedup.deduplicated(frame)
    assert found.columns == frame.columns
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[900].text is None and rows[901].text == "" and rows[903].text == "" and rows[904].kept == "k"
    assert suffix_dedup.deduplicated(frame.limit(0)).count() == 0
