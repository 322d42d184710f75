"""Event logs ("rooms") and partitioned topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import placed, running_within


class OffsetOutOfRange(LookupError):
    """The offset asked for has been evicted."""


def _seconds(ts: Column | str) -> Column:
    """Whole epoch seconds of a timestamp with or without a zone."""
    return F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def with_offsets(events: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Dense offsets from 0 in each room (or topic and partition), in a total order.

    A room may hold any share of all events: they are dealt out by range, not by room.
    """
    return placed(events, key, [F.col(b) for b in by], "offset")


def consume(events: DataFrame, room: str, from_offset: int, limit: int, to_offset: int | None = None) -> DataFrame:
    """Events of a room from an offset on; reading moves no cursor."""
    found = events.filter((F.col("room") == room) & (F.col("offset") >= from_offset))
    if to_offset is not None:
        found = found.filter(F.col("offset") <= to_offset)
    return found.orderBy("offset").limit(limit)


def check_offset(events: DataFrame, room: str, from_offset: int) -> None:
    """Raises OffsetOutOfRange if the room has lost what the offset asks for."""
    first = events.filter(F.col("room") == room).agg(F.min("offset")).first()[0]
    if first and from_offset < first:
        raise OffsetOutOfRange(f"{from_offset} was asked for, {first} is the earliest")


def next_cursor(events: DataFrame, reads: DataFrame) -> DataFrame:
    """Where each read(room, subscriber, from_offset, max_events) leaves its subscriber."""
    joined = reads.join(events.select("room", "offset"), "room", "left")
    read = (F.col("offset") >= F.col("from_offset")) & (F.col("offset") < F.col("from_offset") + F.col("max_events"))
    return joined.groupBy("room", "subscriber").agg(F.coalesce(F.max(F.when(read, F.col("offset") + 1)), F.max("from_offset")).alias("last_offset"))


def rooms(events: DataFrame, column: str = "room") -> DataFrame:
    return events.select(column).distinct()


def room_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("room").agg(F.count(F.lit(1)).alias("message_count"), F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"))


def keep_recent(events: DataFrame, now: Column, retention_secs: int) -> DataFrame:
    """Time retention: strictly younger than ``retention_secs``; 0 keeps everything."""
    if retention_secs == 0:
        return events
    return events.filter(_seconds("ts") > _seconds(now) - retention_secs)


def capped(events: DataFrame, cap: int, hard_cap: int | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """What a room keeps once all its events have arrived and the cursors stand where they do.

    The newest ``cap`` events, and of those before that the slowest cursor of the room
    has not read, as many as ``hard_cap`` allows.  Offsets are dense, so the count of
    newer events is a subtraction from the last offset: no window over the log.
    """
    ends = events.groupBy("room").agg(F.max("offset").alias("__last"))
    if cursors is not None:
        slowest = cursors.groupBy("room").agg(F.min("last_offset").alias("__slowest"))
        ends = ends.join(slowest, "room", "left")
    else:
        ends = ends.withColumn("__slowest", F.lit(None).cast("long"))
    newer = F.col("__last") - F.col("offset")
    unread = F.coalesce(F.col("offset") >= F.col("__slowest"), F.lit(False))
    keep = (newer < cap) | (unread & (newer < max(hard_cap or cap, cap)))
    return events.join(ends, "room").filter(keep).drop("__last", "__slowest")


def partition_by_crc32(key: Column, partitions: int) -> Column:
    return F.pmod(F.crc32(key), F.lit(partitions)).cast("int")


def partition_by_md5(key: Column, partitions: int) -> Column:
    """The same idea on the first 32 bits of an MD5, for engines without CRC32."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(partitions)).cast("int")


def to_topic(events: DataFrame, partitions: int, by: list[str], partition: Column | None = None) -> DataFrame:
    """partition_id and offset for keyed events."""
    dealt = events.withColumn("partition_id", partition_by_crc32(F.col("key"), partitions) if partition is None else partition)
    return with_offsets(dealt, ["topic", "partition_id"], by)


def round_robin(events: DataFrame, partitions: int, by: list[str]) -> DataFrame:
    """Events without a key go to the shortest partition, the first of equals: in turn, if all are keyless."""
    dealt = placed(events, ["topic"], [F.col(b) for b in by], "__place").withColumn("partition_id", F.pmod("__place", F.lit(partitions)).cast("int"))
    return dealt.withColumn("offset", F.floor(F.col("__place") / partitions)).drop("__place")


def consume_partition(topic: DataFrame, name: str, partition_id: int, from_offset: int, limit: int) -> DataFrame:
    here = (F.col("topic") == name) & (F.col("partition_id") == partition_id) & (F.col("offset") >= from_offset)
    return topic.filter(here).orderBy("offset").limit(limit)


def consume_all(topic: DataFrame, name: str, from_offset: int, limit: int) -> DataFrame:
    """Up to ``limit`` of each partition from the same offset, then the earliest ``limit`` of them.

    Offsets are dense, so the first ``limit`` from an offset on are a range of offsets.
    """
    first = topic.filter(F.col("topic") == name).filter((F.col("offset") >= from_offset) & (F.col("offset") < from_offset + limit))
    return first.orderBy(_seconds("ts"), "partition_id", "offset").limit(limit)


def event_size(df: DataFrame) -> Column:
    parts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("data", "key", "topic", "event") if c in df.columns]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total.cast("long")


def retain(topic: DataFrame, *, now: Column | None = None, retention_secs: int | None = None, max_bytes: int | None = None, max_messages: int | None = None) -> DataFrame:
    """Retention by time, then size, then count of each partition; none given keeps all."""
    if retention_secs is not None:
        topic = topic.filter(_seconds("ts") > _seconds(now) - retention_secs)
    sums = {}
    if max_bytes is not None:
        sums["__bytes"] = F.col("size_bytes")
    if max_messages is not None:
        sums["__n"] = F.lit(1).cast("long")
    if not sums:
        return topic
    # both keep the newest, so what is newer than an event decides on both at once
    newer = running_within(topic, ["topic", "partition_id"], [F.col("offset").desc()], sums)
    if max_bytes is not None:
        newer = newer.filter(F.col("__bytes") <= max_bytes)
    if max_messages is not None:
        newer = newer.filter(F.col("__n") <= max_messages)
    return newer.drop(*sums)


def topic_stats(topic: DataFrame) -> DataFrame:
    return topic.groupBy("topic", "partition_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.sum("size_bytes").alias("total_bytes"), F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset")
    )


def restore(events: DataFrame, by: list[str]) -> DataFrame:
    """Events published again: offsets start anew from 0."""
    return with_offsets(events.drop("offset"), ["room"], by)
