"""The postings index: refresh equals rebuild, searches read their terms' parts, roles see their categories."""

import random
import re

import pytest
from pyspark.sql import functions as F

from haulmark.operators import postings, search

CHUNK = "chunk_id string, chunk_text string, category string"
ASKED = "query_id long, question string, allowed array<string>"
WORDS = [f"word{i}" for i in range(60)]


def chunks_of(seed, ids):
    rng = random.Random(seed)
    rows = [(f"c{i}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 25))), "abcd"[i % 4]) for i in ids]
    return rows + [("none", None, "a"), ("blank", " \n", None), ("nowhere", "word1 word2", None)]


def questions(spark, rows):
    return spark.createDataFrame(rows, ASKED)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    allowed = [None, ["a"], ["b", "c"], [], ["a", "b", "c", "d"]]
    rows = [(i, " ".join(rng.choices(WORDS, k=4)), allowed[i % 5]) for i in range(20)]
    return questions(spark, [*rows, (50, "", None), (51, None, ["a"]), (52, "unknown words only", None)])


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())


def state(index):
    live = postings.live_postings(index).select("term", "chunk_id", "category", "tf", "n_terms").collect()
    return sorted(map(tuple, live)), sorted(map(tuple, postings.frequencies(index).collect())), postings.sizes(index)


def test_search_equals_the_scan_of_all_chunks(spark, asked):
    # To the index a null text is an empty one.
    frame = spark.createDataFrame(chunks_of(1, range(300)), CHUNK)
    index = postings.build(frame, category="category", parts=8)
    scan = search.build_index(frame.fillna(""), "chunk_id", "chunk_text", "category")
    want = found(search.bm25_search(scan, asked, 8, category="category"))
    assert found(postings.search(index, asked, 8, allowed="allowed")) == want
    # Many question terms are joined with a salt instead of being broadcast.
    assert found(postings.search(index, asked, 8, allowed="allowed", query_term_rows=3)) == want
    assert found(postings.search(index, asked, 8)) == found(search.bm25_search(scan, asked, 8))


def test_refreshed_index_equals_a_rebuilt_one(spark, asked):
    rows = {r[0]: r for r in chunks_of(2, range(200))}
    frame = lambda rs: spark.createDataFrame(list(rs), CHUNK)
    index = postings.build(frame(rows.values()), category="category", parts=8)
    rng = random.Random(3)
    for step in range(3):
        gone = rng.sample(sorted(rows), 30)
        removed = [rows.pop(k) for k in gone]
        added = [(k, f"{t or ''} again word{step}", c) for k, t, c in removed[:12]] + [(f"n{step}-{i}", "word3 fresh", "b") for i in range(5)]
        rows |= {r[0]: r for r in added}
        postings.refresh(index, frame(removed), frame(added), category="category")
        rebuilt = postings.build(frame(rows.values()), category="category", parts=8)
        assert state(index) == state(rebuilt)
        assert found(postings.search(index, asked, 8, allowed="allowed")) == found(postings.search(rebuilt, asked, 8, allowed="allowed"))
    small = postings.compacted(index)
    assert state(small) == state(index) and small.segments() == [0]


def test_an_interrupted_segment_is_passed_over(spark):
    index = postings.build(spark.createDataFrame(chunks_of(4, range(50)), CHUNK), parts=4)
    before = state(index)
    half = postings._words(spark.createDataFrame([("x", "word1", "a")], CHUNK), "chunk_id", "chunk_text", None)
    lost = postings._counts(half, "chunk_id").withColumn("part", index.part_of(F.col("term"))).withColumn("segment", F.lit(1).cast("long"))
    postings._append(lost, f"{index.path}/postings", "category", "part")
    assert state(index) == before


def test_a_search_reads_only_the_parts_and_categories_it_needs(spark):
    index = postings.build(spark.createDataFrame(chunks_of(5, range(400)), CHUNK), category="category", parts=16)
    hits = postings.search(index, questions(spark, [(1, "word5 word9", ["b"])]), allowed="allowed")
    terms = spark.createDataFrame([("word5",), ("word9",)], "term string").select(index.part_of(F.col("term")).alias("part"))
    parts = sorted({r.part for r in terms.collect()})
    plan = hits._jdf.queryExecution().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PartitionFilters: \[(.*?)\], PushedFilters", plan)
    scans = [filters for columns, filters in scans if "tf#" in columns]
    assert scans
    for filters in scans:
        assert re.search(r"category#\d+, \) = b", filters)
        assert all(str(p) in re.search(r"part#\d+ (?:IN|=) ([^,]*(?:,\d+)*)", filters)[1] for p in parts)
    read = postings.live_postings(index, F.col("part").isin(parts) & F.col("category").isin(["b"]))
    files = {r[0].split("/postings/")[1].rsplit("/", 1)[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert files == {f"category=b/part={p}" for p in parts}


def test_no_foreign_category_is_returned(spark, asked):
    rows = chunks_of(6, range(200))
    index = postings.build(spark.createDataFrame(rows, CHUNK), category="category", parts=8)
    label = {k: c or "" for k, _, c in rows}
    allowed = {r.query_id: r.allowed for r in asked.collect()}
    hits = found(postings.search(index, asked, 50, allowed="allowed"))
    assert hits and all(allowed[q] is None or label[k] in allowed[q] for q, k, _, _ in hits)


def test_empty_index(spark, asked):
    empty = spark.createDataFrame([], CHUNK)
    index = postings.build(empty, parts=4)
    postings.refresh(index, empty, spark.createDataFrame([("a", "word1 word2", "x")], CHUNK))
    assert {r[1] for r in found(postings.search(index, asked, 3))} <= {"a"}
    assert postings.sizes(index) == (1, 2)


def test_pairs_of_chunks_and_questions_are_never_rows(spark, monkeypatch):
    """Ties, copies, keys that repeat or are null: the same as the join of postings and questions."""
    rows = chunks_of(7, range(300)) + [(f"t{i:03d}", "word1 word2 tie", "a") for i in range(60)]
    rows += [(None, "word3 word1", "a"), (None, "word3 none", "b"), *chunks_of(8, range(20))]
    index = postings.build(spark.createDataFrame(rows, CHUNK), category="category", parts=4)
    asked = questions(spark, [(1, "word1 word2 tie", None), (1, "word2", ["b"]), (2, "word3 word5", ["a"]), (None, "word1 word9 word3", ["a", "b"]), (4, "absent", None)])
    ranked = lambda **how: sorted(map(repr, postings.search(index, asked, 8, **how).select("query_id", "chunk_id", "score", "rank").collect()))
    monkeypatch.setattr(postings, "_CELLS", 5)
    monkeypatch.setattr(postings, "_HITS", 7)
    for allowed in (None, "allowed"):
        assert ranked(allowed=allowed) == ranked(allowed=allowed, query_term_rows=0)
    plan = postings.search(index, asked, 8)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[[^\]]*query_id", plan)


def test_words_are_counted_inside_a_chunk(spark):
    """No row per word is grouped: the only shuffle before the last is that of the texts."""
    words = postings._words(spark.createDataFrame([("a", "x y x", "c"), ("a", "x y x", "c"), ("b", "", "c"), ("n", None, "c")], CHUNK), "chunk_id", "chunk_text", "category", placed=True)
    counted = postings._counts(words, "chunk_id")
    assert sorted(tuple(r) for r in counted.collect()) == [("a", "c", 3, "x", 4), ("a", "c", 3, "y", 2)]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[[^\]]*term#", plan)


def test_texts_are_split_into_words_once_and_stay_where_they_lie(spark, monkeypatch):
    """A segment calls for the words of its added chunks once; only rows whose key repeats are placed."""
    calls = []
    words = postings._words
    monkeypatch.setattr(postings, "_words", lambda *a, placed=False: (calls.append(placed), words(*a, placed=placed))[1])
    frame = lambda rows: spark.createDataFrame(rows, CHUNK)
    index = postings.build(frame([("a", "x y x", "c"), ("b", "x", "c"), ("c", None, "c")]))
    assert calls == [False]
    assert sorted(map(tuple, postings.frequencies(index).collect())) == [("x", 2), ("y", 1)] and postings.sizes(index) == (3, 4)
    twice = [("a", "x y x", "c"), ("a", "x y x", "c"), ("a", "x", "c"), (None, "x", "c"), (None, "x z", "d"), ("b", "y", "c"), ("n", "", "c")]
    calls.clear()
    index = postings.build(frame(twice), category="category")
    assert calls == [False, True]
    want = [("a", "c", "x", 1, 1), ("a", "c", "x", 4, 3), ("a", "c", "y", 2, 3), ("b", "c", "y", 1, 1), (None, "c", "x", 1, 1), (None, "d", "x", 1, 2), (None, "d", "z", 1, 2)]
    live = lambda: sorted(map(tuple, postings.live_postings(index).select("chunk_id", "category", "term", "tf", "n_terms").collect()), key=repr)
    assert live() == sorted(want, key=repr)
    assert sorted(map(tuple, postings.frequencies(index).collect())) == [("x", 5), ("y", 3), ("z", 1)] and postings.sizes(index) == (7, 11)
    first, monkeyed = live(), postings.within
    monkeypatch.setattr(postings, "within", lambda df, *n: False if "_place" in df.columns else monkeyed(df, *n))
    index = postings.build(frame(twice), category="category")
    assert live() == first and sorted(map(tuple, postings.frequencies(index).collect())) == [("x", 5), ("y", 3), ("z", 1)]


def test_the_number_of_an_interrupted_segment_is_not_used_again(spark):
    frame = lambda rows: spark.createDataFrame(rows, CHUNK)
    index = postings.build(frame([("a", "x y", "c")]))
    lost = postings._counts(postings._words(frame([("q", "x", "c")]), "chunk_id", "chunk_text", None), "chunk_id", rows=True)
    postings._append(lost.withColumn("part", index.part_of(F.col("term"))).withColumn("segment", F.lit(1).cast("long")), f"{index.path}/postings", "category", "part")
    postings.refresh(index, frame([]), frame([("b", "x", "c")]))
    assert index.segments() == [0, 2] and sorted(map(tuple, postings.frequencies(index).collect())) == [("x", 2), ("y", 1)]


def test_lists_of_a_block_are_stored_and_no_key_is_in_two_blocks(spark, asked, monkeypatch):
    """One row a term, category and block, not one a posting; blocks of any size give the same hits."""
    rows = chunks_of(11, range(300)) + [(f"d{i % 9}", f"word1 word2 again{i}", "abcd"[i % 4]) for i in range(40)] + [(None, "word3 word1", "a")] * 3
    frame = spark.createDataFrame(rows, CHUNK).coalesce(1)
    index = postings.build(frame, category="category", parts=4)
    assert index.read("postings").count() * 3 < postings.live_postings(index).count()
    known = lambda i: (sorted(map(tuple, postings.frequencies(i).collect())), postings.sizes(i))
    ranked = lambda i, **how: sorted(map(repr, found_rows(i, **how)))
    found_rows = lambda i, **how: postings.search(i, asked, 8, allowed="allowed", **how).select("query_id", "chunk_id", "score", "rank").collect()
    want = ranked(index, query_term_rows=0)
    assert ranked(index) == want
    monkeypatch.setattr(postings, "_BLOCK_WORDS", 50)
    small = postings.build(frame, category="category", parts=4)
    blocks = small.read("postings").select("block", F.explode_outer("keys").alias("k")).groupBy("k").agg(F.countDistinct("block").alias("n"))
    assert blocks.where("n > 1").isEmpty() and small.read("postings").select("block").distinct().count() > 20
    assert known(small) == known(index) and ranked(small) == want
