"""Structured Streaming: logs, queues and feeds kept up to date as files or topics grow.

Every job has a batch twin in this package, and tests hold that a stream that has
read everything shows what the twin computes.  State lives in the state store of the
query's checkpoint, one entry for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha1

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.topics import is_wildcard, topic_regex
from .queues import RESULTS, Limits, Queue


def read_log(spark, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def assign_offsets(events: DataFrame, by: list[str], key: str = "room") -> DataFrame:
    """Dense offsets from 0 in each room, in order of arrival and of ``by`` within a batch."""
    fields = [f for f in events.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", offset long"

    def run(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts), ignore_index=True).sort_values(by, kind="stable")
        rows["offset"] = range(following, following + len(rows))
        state.update((following + len(rows),))
        yield rows

    return events.groupBy(key).applyInPandasWithState(run, schema, "following long", "append", GroupStateTimeout.NoTimeout)


def _records(part: pd.DataFrame) -> Iterator[dict]:
    """Rows as dicts in which absent values are None."""

    def values(column: pd.Series) -> list:
        absent = column.isna()
        if absent.all():
            return [None] * len(column)
        return column.astype(object).where(~absent, None).tolist() if absent.any() else column.tolist()

    names = list(part.columns)
    return (dict(zip(names, row)) for row in zip(*(values(part[name]) for name in names)))


class _QueueFold(StatefulProcessor):
    """A queue's messages as entries of up to a segment of them: a batch rewrites only those it touched."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one entry for each segment of messages
        self.entries = handle.getMapState("entries", "id string", "entry binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        entries = {k[0]: bytes(v[0]) for k, v in self.entries.iterator()}
        before = {name: sha1(entry).digest() for name, entry in entries.items()}
        queue = Queue.unpacked(entries, self.limits)
        del entries
        columns = [part.split()[0] for part in RESULTS.split(", ")]
        for part in rows:  # a batch of a key's rows comes in order of seq where its files do
            out = []
            for row in _records(part.sort_values("seq", kind="stable")):
                message, outcome, retries = queue.apply(row)
                out.append((key[0], row["seq"], row["op"], message, outcome, retries))
            yield pd.DataFrame(out, columns=columns).astype({"retry_count": "Int32"})
        for name, entry in queue.entries():
            if before.pop(name, None) != sha1(entry).digest():
                self.entries.updateValue((name,), (entry,))
        for name in before:
            self.entries.removeKey((name,))

    def close(self) -> None:
        pass


def fold_queues(operations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Outcomes of queue operations as they arrive; a segment of messages is an entry of the queue's state.

    Needs the RocksDB state store, ``spark.sql.streaming.stateStore.providerClass``.
    """
    return operations.groupBy("queue").transformWithStateInPandas(_QueueFold(limits), RESULTS, "append", "none")


def counters(deltas: DataFrame) -> DataFrame:
    """INCR as a running sum of each key."""
    return deltas.groupBy("key").agg(F.sum("num").alias("counter"))


def windowed_counts(events: DataFrame, width: str, late: str, key: str, ts: str = "ts") -> DataFrame:
    """Counts by event-time window; events later than ``late`` are dropped, as any log's retention would."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("started"), key, "n")


def observe_events(events: DataFrame, room: str, event: str | None = None, from_offset: int = 0) -> DataFrame:
    """A room's events from an offset on as they arrive, of one type if it is named."""
    found = events.filter((F.col("room") == room) & (F.col("offset") >= from_offset))
    return found.filter(F.col("event") == event) if event is not None else found


def observe_topics(messages: DataFrame, patterns: list[str], topic: str = "topic") -> DataFrame:
    """Messages of the topics that any of a subscriber's patterns matches, as they arrive."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | (F.col(topic).rlike(topic_regex(pattern)) if is_wildcard(pattern) else F.col(topic) == pattern)
    return messages.filter(found)


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One stream for several sinks: each batch is computed once and handed to all, in order.

    A sink that fails fails the batch; the query starts again from its checkpoint with the
    same batch, so a sink should write a batch under its number.
    """

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, number)
        finally:
            kept.unpersist()

    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def retried(run: Callable[[], None], times: int) -> int:
    """Runs a job again, from its checkpoint, until it ends without an error; how often it failed."""
    for failed in range(times + 1):
        try:
            run()
            return failed
        except StreamingQueryException:
            if failed == times:
                raise
    return times


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Reads what there is, writes it exactly once to a folder of Parquet files, and stops."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
