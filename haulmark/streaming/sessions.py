"""Conversation history kept as keyed state while messages arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from haulmark import fixed_values as fv

_MESSAGE = T.StructType(
    [
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("n_messages", T.LongType()),
        T.StructField("history", T.StringType()),
    ]
)


class RecentMessages(StatefulProcessor):
    """Holds the last ``n`` messages of a session and how many it has had."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", _MESSAGE)
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [tuple(m) for m in self.recent.get()] if self.recent.exists() else []
        seen = self.count.get()[0] if self.count.exists() else 0
        for row in rows:
            seen += 1
            kept.append((row.turn, row.role, row.content))
            if len(kept) > 2 * self.n:
                kept = sorted(kept)[-self.n :]
        kept = sorted(kept)[-self.n :]
        self.recent.put(kept)
        self.count.update((seen,))
        text = "\n".join(f"[{role}] {content}" for _, role, content in kept)
        yield Row(session_id=key[0], n_messages=seen, history=text)

    def close(self) -> None:
        pass


def recent_messages(messages: DataFrame, n: int = fv.HISTORY_MESSAGES) -> DataFrame:
    """Latest history of every session that got messages, in update mode.

    ``messages`` carry session_id, turn, role and content.  The state of a session is ``n``
    messages whatever its length.  Needs the RocksDB state store.
    """
    return messages.groupBy("session_id").transformWithState(
        statefulProcessor=RecentMessages(n),
        outputStructType=HISTORY,
        outputMode="Update",
        timeMode="None",
    )


_OPEN = T.StructType([T.StructField("created_at", T.TimestampType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
_DONE = T.StructType([T.StructField("lines", T.StringType()), T.StructField("n", T.LongType())])
COMPACTED = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("n_messages", T.LongType()),
        T.StructField("n_summarised", T.LongType()),
        T.StructField("summary", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)


class CompactedSession(StatefulProcessor):
    """Holds one summary of the oldest half of a session and the messages of the other half.

    A timer set ``idle_s`` after the last message removes the state of the session.
    """

    def __init__(self, threshold: int, preview: int, idle_s: int) -> None:
        self.threshold, self.preview, self.idle_s = threshold, preview, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)
        self.done = handle.getValueState("done", _DONE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(m) for m in self.open.get()] if self.open.exists() else [], columns=_OPEN.names)
        lines, n = tuple(self.done.get()) if self.done.exists() else ("", 0)
        held = pd.concat([held, *[r[_OPEN.names] for r in rows]]) if len(held) else pd.concat([r[_OPEN.names] for r in rows])
        held = held.sort_values(["created_at", "content"], kind="stable")
        total = n + len(held)
        if total >= self.threshold:
            # The half grows with the session, so the summary only ever gets longer.
            old = held.iloc[: total // 2 - n]
            told = ["[" + r + "] " + c[: self.preview] for r, c in zip(old.role.fillna(""), old.content.fillna(""))]
            lines, n, held = "; ".join([lines, *told] if n else told), n + len(old), held.iloc[len(old) :]
            self.done.update((lines, n))
        self.open.put([(t.to_pydatetime(), r, c) for t, r, c in held.itertuples(index=False)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = held.created_at.max()
        self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle_s * 1000)
        summary = "Earlier conversation summary: " + lines if n else None
        kept = "\n".join("[" + held.role.fillna("") + "] " + held.content.fillna(""))
        yield pd.DataFrame([(key[0], total, n, summary, kept)], columns=COMPACTED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        self.done.clear()
        yield pd.DataFrame([], columns=COMPACTED.names)

    def close(self) -> None:
        pass


def compacted_sessions(
    messages: DataFrame, threshold: int = fv.COMPACTION_THRESHOLD, preview: int = 100, idle_s: int = 86_400, delay: str = "1 hour"
) -> DataFrame:
    """Sessions that got messages, as the batch compaction of all their messages would leave them.

    ``messages`` carry session_id, role, content and created_at and arrive in order within a
    session; one that is older than the summary joins its end.  A session that is idle for
    ``idle_s`` seconds of event time is forgotten and begins anew.  Update mode, RocksDB store.
    """
    timed = messages.where("created_at IS NOT NULL").withWatermark("created_at", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=CompactedSession(threshold, preview, idle_s), outputStructType=COMPACTED, outputMode="Update", timeMode="EventTime"
    )


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def store_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an update-mode stream over what has arrived; each batch replaces its own partition."""

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(number).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    query = stream.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
