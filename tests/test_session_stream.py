"""Compaction kept as state over several deliveries, and state that expires."""

import datetime as dt

from haulmark.operators import sessions as batch
from haulmark.streaming import sessions

MESSAGE = "session_id string, role string, content string, user_id string, created_at timestamp"
START = dt.datetime(2024, 1, 1)


def message(session, i, minutes=None):
    return (session, "user", f"{session}-{i:04d} " + "y" * 120, "u", START + dt.timedelta(minutes=i if minutes is None else minutes))


def run(spark, tmp_path, rows, **options):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(source)
    with sessions.rocksdb(spark):
        stream = spark.readStream.schema(MESSAGE).parquet(source)
        sessions.store_updates(sessions.compacted_sessions(stream, 6, **options), path, checkpoint)
    last = {}
    for r in spark.read.parquet(path).orderBy("batch_id").collect():
        last[r.session_id] = r
    return last


def test_several_deliveries_equal_the_batch_operator(spark, tmp_path):
    every = [message("a", i) for i in range(23)] + [message("b", i) for i in range(5)] + [message("c", i) for i in range(60)]
    got = {}
    for low, high in ((0, 4), (4, 9), (9, 60)):
        got = run(spark, tmp_path, [m for m in every if low <= int(m[2][2:6]) < high], idle_s=10**6)
    out = batch.compact(spark.createDataFrame(every, MESSAGE), threshold=6).collect()
    for s in "abc":
        summary = [r.content for r in out if r.session_id == s and r.role == "system"]
        kept = sorted((r.created_at, r.content) for r in out if r.session_id == s and r.role != "system")
        assert ([got[s].summary] if got[s].summary else []) == summary
        assert got[s].kept == "\n".join(f"[user] {c}" for _, c in kept)
        assert got[s].n_messages == sum(m[0] == s for m in every)


def test_an_idle_session_is_forgotten(spark, tmp_path):
    run(spark, tmp_path, [message("a", i) for i in range(8)], idle_s=600, delay="1 minute")
    # Another session moves the event time far beyond the idle limit of the first.
    run(spark, tmp_path, [message("z", 0, 5000)], idle_s=600, delay="1 minute")
    run(spark, tmp_path, [message("z", 1, 5001)], idle_s=600, delay="1 minute")
    got = run(spark, tmp_path, [message("a", 9, 5002)], idle_s=600, delay="1 minute")
    assert (got["a"].n_messages, got["a"].summary) == (1, None)
    assert got["z"].n_messages == 2
