"""Every class of near copies keeps exactly one row, whatever ids its rows have."""

import random

import pytest

from haulmark.llm import near_dedup, tables


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_with_null_and_repeated_ids_keep_one_row(spark, seed):
    rng = random.Random(seed)
    rows, n_classes = [], 12
    for c in range(n_classes):
        words = [f"c{c}w{i}" for i in range(80)]
        for k in range(rng.randrange(1, 6)):
            copy = list(words)
            if k:
                copy[rng.randrange(2, 78)] = f"x{rng.randrange(10**9)}"
            rows.append((rng.choice([None, rng.randrange(30)]), " ".join(copy)))
            if rng.random() < 0.3:
                rows.append(rows[-1])
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.deduplicated(docs).collect()
    assert sorted(r.text.split("w")[0] for r in kept) == sorted(f"c{c}" for c in range(n_classes))
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for c in range(n_classes):
        own = [i for i, t in rows if t.startswith(f"c{c}w")]
        label = min((i for i in own if i is not None), default=None)
        (one,) = [r for r in kept if r.text.startswith(f"c{c}w")]
        assert one.doc_id == label


def test_a_null_id_does_not_delete_its_class(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (5, " ".join([*words[:-1], "end"])), (None, "another text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.text.split())) for r in near_dedup.deduplicated(docs).collect()) == [(0, 5), (5, 60)]


@pytest.mark.parametrize("step", ["sketch", "verified"])
def test_batches_of_texts_are_bounded_from_the_first_call_of_a_session(spark, step):
    """Not only after a step that comes later has lowered the session's limit."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, "64m")
    texts = spark.createDataFrame([(0, "one two three four five six"), (1, "one two three four five six")], "node long, text string")
    if step == "sketch":
        rows = near_dedup.sketch(texts.withColumnRenamed("node", "doc_id"))
    else:
        rows = near_dedup.verified(spark.createDataFrame([(0, 1)], "a long, b long"), texts)
    assert int(spark.conf.get(limit).rstrip("b")) <= tables.BATCH_BYTES
    assert rows.count() == (2 if step == "sketch" else 1)
