"""Tables, sessions, feedback, streams, ranks and searches under skew."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulmark.functions.ranking import bucketed_rank, nearest_rank, top_n
from haulmark.operators import feedback, search, sessions, tables, vectors
from haulmark.sources import files
from haulmark.sources.sizing import fresh_path, on_one_machine, shared_folder, within
from haulmark.streaming import intake

MESSAGE = "session_id string, role string, content string, user_id string, created_at timestamp"


def talk(spark, sizes):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (s, "user" if i % 2 == 0 else "assistant", f"{s}-{i:05d} " + "y" * 120, "u", start + dt.timedelta(minutes=7 * i))
        for s, n in sizes.items()
        for i in range(n)
    ]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, MESSAGE)


def test_compaction_of_short_and_hot_sessions(spark):
    out = sessions.compact(talk(spark, {"a": 19, "b": 20, "hot": 401}), part_messages=50).collect()
    by = lambda s, role=None: [r for r in out if r.session_id == s and (role is None or r.role == role)]
    assert len(by("a")) == 19
    assert len(by("b")) == 11 and len(by("b", "system")) == 1
    text = by("b", "system")[0].content
    assert text.startswith("Earlier conversation summary: [user] b-00000 ") and text.count("; ") == 9
    assert by("b", "system")[0].user_id == "system"
    # 200 of 401 are summarised in parts of 50, which end up in one summary in order.
    assert len(by("hot")) == 201 + 1
    lines = by("hot", "system")[0].content.removeprefix("Earlier conversation summary: ").split("; ")
    assert [l.split("] ")[1][:9] for l in lines] == [f"hot-{i:05d}" for i in range(200)]
    assert all(len(l.split("] ")[1]) == 100 for l in lines)


def test_compaction_keeps_messages_without_time_or_session(spark):
    rows = talk(spark, {"a": 5000, "b": 3}).collect()
    rows += [("b", "user", "no time", "u", None), (None, "user", "no session", "u", rows[0].created_at), (None, None, None, None, None)]
    out = sessions.compact(spark.createDataFrame(rows, MESSAGE), threshold=20).collect()
    assert sum(r.session_id == "a" and r.role == "system" for r in out) == 1
    assert len(out) == 2500 + 1 + 4 + 2
    assert {r.content for r in out if r.session_id is None} == {"no session", None}


def test_ranks_of_null_groups(spark):
    df = spark.createDataFrame([(None, None), (None, 3.0), ("g", 1.0), (None, 5.0)], "g string, v double")
    got = bucketed_rank(df, ["g"], F.floor(F.col("v")), [F.asc("v")], "r", "n").collect()
    assert sorted((r.g or "", r.v or 0.0, r.r, r.n) for r in got) == [("", 0.0, 1, 3), ("", 3.0, 2, 3), ("", 5.0, 3, 3), ("g", 1.0, 1, 1)]
    assert {r.g: r.p for r in nearest_rank(df, ["g"], "v", 0.5, "p").collect()} == {None: 5.0, "g": 1.0}


def test_history_modes(spark):
    df = talk(spark, {"a": 15, "b": 3})
    last = sessions.history(df, 10).where("session_id = 'a'").orderBy("position").collect()
    assert [r.content[:7] for r in last] == [f"a-{i:05d}" for i in range(5, 15)]
    assert [r.position for r in last] == list(range(1, 11))
    oldest = sessions.history(df, 10, "oldest").where("session_id = 'a'").orderBy("position").collect()
    assert [r.content[:7] for r in oldest] == [f"a-{i:05d}" for i in range(10)]
    with pytest.raises(ValueError):
        sessions.history(df, mode="newest")


def test_top_n_limits_before_the_shuffle(spark):
    df = talk(spark, {"a": 5})
    plan = top_n(df, ["session_id"], [F.desc("created_at")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_bucketed_rank_equals_row_number(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 9)}", i, rnd.randint(0, 500)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = bucketed_rank(df, ["k"], F.floor(F.col("v") / 40), [F.asc("v"), F.asc("id")], "r", "n").collect()
    want = {}
    for k, i, v in sorted(rows, key=lambda x: (x[2], x[1])):
        want.setdefault(k, []).append(i)
    assert {(r.k, r.id): (r.r, r.n) for r in got} == {
        (k, i): (p + 1, len(ids)) for k, ids in want.items() for p, i in enumerate(ids)
    }


def test_nearest_rank(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), round(rnd.random() * 30, 2)) for _ in range(2000)] + [("c", 4.0)]
    got = {r.g: r.p for r in nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 0.95, "p").collect()}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == values[int(len(values) * 0.95)]
    whole = nearest_rank(spark.createDataFrame(rows, "g string, v double"), [], "v", 0.95, "p").first().p
    values = sorted(v for _, v in rows)
    assert whole == values[int(len(values) * 0.95)]


def rows(spark, data, schema="k long, v string, h string"):
    return spark.createDataFrame(data, schema)


def test_upsert(spark):
    target = rows(spark, [(1, "a", "x"), (2, "b", "y"), (3, "c", None), (9, "z", "q")])
    source = rows(spark, [(1, "A", "x"), (2, "B", "new"), (3, "C", "n"), (4, "D", "d")])
    by = lambda df: {r.k: r.v for r in df.collect()}
    # Equal and NULL hashes leave the row alone.
    assert by(tables.upsert(target, source, "k", "h")) == {1: "a", 2: "B", 3: "c", 4: "D", 9: "z"}
    assert by(tables.upsert(target, source, "k")) == {1: "A", 2: "B", 3: "C", 4: "D", 9: "z"}
    assert by(tables.upsert(target.limit(0), source, "k", "h")) == {1: "A", 2: "B", 3: "C", 4: "D"}


def test_change_feed_replays_to_the_new_snapshot(spark):
    old = rows(spark, [(1, "a", "x"), (2, None, "y"), (3, "c", "z")])
    new = rows(spark, [(1, "a", "x"), (2, "b", "y"), (4, "d", "w")])
    assert {(r.k, r.change) for r in tables.snapshot_changes(old, new, "k").collect()} == {(2, "update"), (3, "delete"), (4, "insert")}


def test_deletes_updates_orphans(spark):
    df = rows(spark, [(1, "a", "x"), (2, None, "y")])
    assert tables.delete_where(df, F.col("v") == "a").count() == 1
    done = tables.update_keys(df, df.where("k = 1"), "k", {"v": F.lit("n")})
    assert {r.k: r.v for r in done.collect()} == {1: "n", 2: None}
    child = spark.createDataFrame([(1,), (5,), (5,), (None,)], "k long")
    orphans = tables.orphan_counts(child, df, "k").first()
    assert (orphans.n_rows, orphans.n_keys) == (2, 1)


def test_feedback_on_empty_table(spark):
    empty = spark.createDataFrame([], "feedback_id string, rating int, promoted_to_eval boolean")
    assert list(feedback.feedback_stats(empty).first()) == [0, 0, 0, 0.0, 0]
    assert spark.range(1).select(feedback.encode_rating(F.lit("other")).alias("r")).first().r == -1


def test_promotion_needs_five(spark):
    schema = "feedback_id string, created_at timestamp, user_id string, question string, answer string, rating int, comment string, intent_classification string, promoted_to_eval boolean"
    make = lambda n: spark.createDataFrame(
        [(f"f{i}", dt.datetime(2024, 1, 1, i), "u", "q", "a" * 300, -1, "why" if i else None, "sql", False) for i in range(n)], schema
    )
    assert feedback.promote_to_eval(make(4)).count() == 0
    got = {r.feedback_id: r.expected_facts for r in feedback.promote_to_eval(make(6)).collect()}
    assert len(got) == 6 and got["f1"] == "why"
    assert got["f0"] == "Previous response was rated negatively: " + "a" * 100


# ---- search -------------------------------------------------------------------


def corpus(spark):
    rnd = random.Random(4)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    return [(f"c{i:03d}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(200)] + [("c900", "INS-1002 the"), ("c901", "")]


def brute(docs, question, n):
    toks = {k: t.lower().split() for k, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    scores = {}
    for term in set(question.lower().split()):
        df = sum(term in t for t in toks.values())
        for k, t in toks.items():
            tf = t.count(term)
            if tf:
                idf = math.log(1 + (len(toks) - df + 0.5) / (df + 0.5))
                scores[k] = scores.get(k, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return sorted(((-round(s, 4), k) for k, s in scores.items()))[:n]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_bm25_against_brute_force_on_both_join_paths(spark, limit):
    docs = corpus(spark)
    asked = [(1, "the w1 w2"), (2, "ins-1002"), (3, "the"), (4, "nothing")]
    index = search.build_index(spark.createDataFrame(docs, "chunk_id string, chunk_text string"))
    queries = spark.createDataFrame(asked, "query_id long, question string")
    got = search.bm25_search(index, queries, 8, query_term_rows=limit).collect()
    for q, text in asked:
        mine = sorted((-r.score, r.chunk_id) for r in got if r.query_id == q)
        assert [k for _, k in mine] == [k for _, k in brute(docs, text, 8)]
        assert np.allclose([s for s, _ in mine], [s for s, _ in brute(docs, text, 8)], atol=1e-4)


def test_stored_index_is_read_without_a_shuffle_per_chunk(spark):
    docs = spark.createDataFrame(corpus(spark), "chunk_id string, chunk_text string")
    stored = search.store_index(search.build_index(docs, buckets=4), "chunk_id", 4)
    queries = spark.createDataFrame([(1, "the w1")], "query_id long, question string")
    plan = search.bm25_search(stored, queries, 8)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" not in plan and "hashpartitioning(query_id" in plan


@pytest.mark.parametrize("block", [4096, 2])
def test_vector_search_with_copies_and_zero_vectors(spark, block):
    rnd = np.random.default_rng(6)
    vecs = rnd.normal(size=(120, 8)).astype("float32")
    vecs[40:90] = vecs[40]  # one vector holds a third of all rows
    vecs[7] = 0
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>").repartition(5)
    queries = base.where("vec_id in (1, 41, 7, 99, 100)").withColumnRenamed("vec_id", "query_id")
    got = vectors.cosine_top_n(queries, base, 5, query_block=block).collect()
    norms = np.linalg.norm(vecs.astype("float64"), axis=1)
    unit = vecs / np.where(norms == 0, 1, norms)[:, None]
    for q in (1, 41, 7, 99, 100):
        sims = np.round(unit.astype("float64") @ unit[q].astype("float64"), 4)
        want = sorted(range(120), key=lambda i: (-sims[i], i))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


# ---- files and streams --------------------------------------------------------


def test_file_stream_sees_only_new_files(spark, tmp_path):
    folder = tmp_path / "in" / "01_claims"
    folder.mkdir(parents=True)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = files.stream_files(spark, str(tmp_path / "in"), "*.txt").select("path", "length")
        intake.run_available(stream, out, checkpoint)
        return spark.read.parquet(out).count()

    (folder / "a.txt").write_text("one")
    (folder / "skip.bin").write_text("no")
    assert run() == 1
    assert run() == 1
    (folder / "b.txt").write_text("two")
    assert run() == 2
    assert files.scan_files(spark, str(tmp_path / "in"), "*.txt").count() == 2


def test_intake_keeps_one_row_per_key_over_batches(spark, tmp_path):
    source = str(tmp_path / "src")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    deliver = lambda data: spark.createDataFrame(data, "k long, v string").write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("k long, v string").parquet(source)
        intake.intake_new(stream, out, checkpoint, "k")
        return sorted((r.k, r.v) for r in spark.read.parquet(out).collect())

    deliver([(1, "a"), (2, "b"), (2, "b")])
    assert run() == [(1, "a"), (2, "b")]
    deliver([(2, "changed"), (3, "c")])
    assert run() == [(1, "a"), (2, "b"), (3, "c")]


def test_append_with_new_columns_and_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append(spark.createDataFrame([(1, "a")], "k long, v string"), path)
    files.append(spark.createDataFrame([(2, 0.5)], "k long, w double"), path)
    assert {(r.k, r.v, r.w) for r in files.read_evolving(spark, path).collect()} == {(1, "a", None), (2, None, 0.5)}
    part = str(tmp_path / "p")
    files.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "k long, d string"), part, ["d"])
    files.overwrite(spark.createDataFrame([(9, "b")], "k long, d string"), part, ["d"])
    assert {(r.k, r.d) for r in spark.read.parquet(part).collect()} == {(1, "a"), (9, "b")}


def test_sizes_and_folders(spark):
    assert within(spark.range(10), 10) and not within(spark.range(11), 10)
    assert shared_folder(spark) == shared_folder(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_retention_keeps_rows_without_a_time(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01'), (2, TIMESTAMP '2024-03-31'), (3, NULL) AS t(id, ts)")
    kept = tables.purge_before(rows, "ts", F.lit("2024-04-10").cast("timestamp"), 90)
    assert sorted(r.id for r in kept.collect()) == [2, 3]


def test_a_temporary_folder_serves_one_machine_only():
    assert on_one_machine("local[8]") and on_one_machine("local-cluster[2,1,1024]")
    assert not on_one_machine("yarn") and not on_one_machine("spark://host:7077") and not on_one_machine("k8s://host")


@pytest.mark.parametrize("compare", [None, "h"])
def test_upsert_joins_the_rows_of_the_source_once(spark, compare, monkeypatch):
    monkeypatch.setattr(tables, "within", lambda df: False)
    schema = "k long, h string"
    old = [(1, "a"), (2, "b"), (2, "x"), (3, None), (4, "d"), (None, "n"), (7, "q")]
    new = [(1, "a"), (2, "b"), (3, "c"), (4, "e"), (5, "f"), (5, "g"), (None, "m"), (7, None)]
    keys = {k for k, _ in old if k} & {k for k, _ in new}
    changed = {k for k in keys if not compare or any(a != b for i, a in old for j, b in new if i == j == k and a and b)}
    want = [r for r in old if r[0] not in changed] + [r for r in new if r[0] in changed or r[0] not in keys]
    got = tables.upsert(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "k", compare)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("LeftAnti") <= 2
