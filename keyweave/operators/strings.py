"""Strings and counters: kv(key, value, expires_at_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.glob import glob_match
from ..functions.ttl import is_live, ttl_millis, ttl_seconds
from .paging import requested


def live(kv: DataFrame, now_ms: int) -> DataFrame:
    return kv.filter(is_live(F.col("expires_at_ms"), now_ms))


def get(kv: DataFrame, key: str, now_ms: int) -> DataFrame:
    return live(kv, now_ms).filter(F.col("key") == key)


def mget(kv: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    """A row for each key asked for, in order; null where it is absent or expired."""
    return requested(live(kv, now_ms), keys, "key", "value")


def exists(kv: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """Those of ``keys`` that are there."""
    return keys.join(live(kv, now_ms).select("key"), "key", "left_semi")


def scan(kv: DataFrame, now_ms: int, prefix: str | None = None, limit: int | None = None, pattern: str | None = None) -> DataFrame:
    """Keys in order; the prefix reaches the file scan."""
    found = live(kv, now_ms).select("key")
    if prefix:
        found = found.filter(F.col("key").startswith(prefix))
    if pattern:
        found = found.filter(glob_match(F.col("key"), pattern))
    return found.orderBy("key").limit(limit) if limit is not None else found


def keys(kv: DataFrame, now_ms: int, pattern: str = "*") -> DataFrame:
    return scan(kv, now_ms, pattern=None if pattern == "*" else pattern)


def dbsize(kv: DataFrame, now_ms: int) -> DataFrame:
    return live(kv, now_ms).agg(F.count(F.lit(1)).alias("n"))


def stats(kv: DataFrame, now_ms: int) -> DataFrame:
    size = F.octet_length("key") + F.octet_length("value")
    return live(kv, now_ms).agg(
        F.count(F.lit(1)).alias("total_keys"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"),
        F.count("expires_at_ms").alias("volatile_keys"),
    )


def strlen(kv: DataFrame, now_ms: int) -> DataFrame:
    return live(kv, now_ms).select("key", F.octet_length("value").cast("long").alias("length"))


def get_range(value: Column, start: int, end: int) -> Column:
    """Bytes ``start`` to ``end`` inclusive; negative places count from the end."""
    size = F.octet_length(value)
    first = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    last = F.least(F.lit(end), size - 1) if end >= 0 else size + end
    return F.when(last >= first, F.substring(value, first + 1, last - first + 1)).otherwise(F.expr("X''"))


def set_range(value: Column, offset: int, new: bytes) -> Column:
    """``new`` written at ``offset``, a gap filled with zero bytes."""
    old = F.coalesce(value, F.expr("X''"))
    size = F.octet_length(old)
    gap = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(offset) - size, F.lit(0))))
    head = F.substring(old, F.lit(1), F.least(size, F.lit(offset)))
    tail = F.substring(old, F.lit(offset + len(new) + 1), F.greatest(size - offset - len(new), F.lit(0)))
    return F.concat(head, gap, F.lit(new), tail)


def append(value: Column, more: bytes) -> Column:
    return F.concat(F.coalesce(value, F.expr("X''")), F.lit(more))


def as_integer(value: Column) -> Column:
    """Text that is exactly a 64-bit integer; else null."""
    text = F.decode(value, "UTF-8")
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))


def ttl(kv: DataFrame, now_ms: int) -> DataFrame:
    """Whole seconds left (0 once expired), null if a key never expires."""
    at = F.col("expires_at_ms")
    return kv.select("key", ttl_seconds(at, now_ms).alias("ttl"), ttl_millis(at, now_ms).alias("pttl"))


def expire(kv: DataFrame, keys: list[str], ttl_secs: int, now_ms: int) -> DataFrame:
    """The live keys, those named expiring ``ttl_secs`` from now."""
    at = F.when(F.col("key").isin(keys), F.lit(now_ms + ttl_secs * 1000)).otherwise(F.col("expires_at_ms"))
    return live(kv, now_ms).withColumn("expires_at_ms", at.cast("long"))


def persist(kv: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    at = F.when(~F.col("key").isin(keys), F.col("expires_at_ms"))
    return live(kv, now_ms).withColumn("expires_at_ms", at)


def incremented(deltas: DataFrame) -> DataFrame:
    """Counters after all increments (key, num): an overflow raises, as sums of longs do in ANSI mode."""
    return deltas.groupBy("key").agg(F.sum(F.col("num").cast("long")).alias("counter"))


def decremented(deltas: DataFrame) -> DataFrame:
    return incremented(deltas.withColumn("num", -F.col("num")))


def set_latest(writes: DataFrame) -> DataFrame:
    """SET and MSET: the last write of each key by seq wins, its expiry with it."""
    last = F.max_by(F.struct("value", "expires_at_ms"), "seq")
    return writes.groupBy("key").agg(last.alias("w")).select("key", "w.value", "w.expires_at_ms")


def get_set(writes: DataFrame) -> DataFrame:
    """Each write with the value it replaced (null for the first)."""
    return writes.withColumn("old", F.lag("value").over(W.partitionBy("key").orderBy("seq")))


def mset_nx(kv: DataFrame, pairs: DataFrame, now_ms: int) -> DataFrame:
    """All of ``pairs`` (key, value) added, or, if any key is there, none."""
    there = live(kv, now_ms)
    clash = pairs.select("key").join(there.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("clashes"))
    added = pairs.crossJoin(F.broadcast(clash)).filter("clashes = 0").select("key", "value", F.lit(None).cast("long").alias("expires_at_ms"))
    return there.select("key", "value", "expires_at_ms").unionByName(added)


def delete(kv: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    return live(kv, now_ms).filter(~F.col("key").isin(keys))


def flush(kv: DataFrame) -> DataFrame:
    return kv.limit(0)


def random_key(kv: DataFrame, now_ms: int, seed: int = 0) -> DataFrame:
    """One key, the same for a seed: the smallest by seeded hash."""
    return live(kv, now_ms).select("key").orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(1)
