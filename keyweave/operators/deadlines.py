"""Expiry of whole collections: deadlines(key, expires_at_ms) beside any relation with a key.

Sets, lists, hashes, sorted sets, bitmaps and sketches are many rows a key; when the
key ends is one row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live(relation: DataFrame, deadlines: DataFrame, now_ms: int) -> DataFrame:
    """The rows of keys that have not ended: what a sweep would leave, and what every read sees."""
    ended = deadlines.filter(F.col("expires_at_ms") <= now_ms).select("key").distinct()
    return relation.join(ended, "key", "left_anti")


def expire(relation: DataFrame, deadlines: DataFrame, keys: list[str], seconds: int, now_ms: int) -> DataFrame:
    """The deadlines after EXPIRE: those of live keys that are there, counted from now."""
    there = live(relation, deadlines, now_ms).filter(F.col("key").isin(keys)).select("key").distinct()
    new = there.withColumn("expires_at_ms", F.lit(now_ms + seconds * 1000).cast("long"))
    return deadlines.join(new.select("key"), "key", "left_anti").unionByName(new)


def persist(deadlines: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    """Live keys among those named end no more."""
    return deadlines.filter(~F.col("key").isin(keys) | (F.col("expires_at_ms") <= now_ms))


def ttl(relation: DataFrame, deadlines: DataFrame, now_ms: int) -> DataFrame:
    """key, ttl in whole seconds: null for keys that never end, negative once overdue and not swept yet."""
    keys = relation.select("key").distinct()
    left = F.floor((F.col("expires_at_ms") - now_ms) / 1000).cast("long")
    return keys.join(deadlines, "key", "left").select("key", left.alias("ttl"))


def restarted(deadlines: DataFrame, writes: DataFrame) -> DataFrame:
    """The deadlines after writes(key, seq, ts_ms, ttl_secs): a write with a time to live starts the clock anew, one without leaves it."""
    old = deadlines.select("key", F.lit(-1).cast("long").alias("seq"), "expires_at_ms")
    new = writes.filter("ttl_secs IS NOT NULL").select("key", F.col("seq").cast("long").alias("seq"), (F.col("ts_ms") + F.col("ttl_secs") * 1000).cast("long").alias("expires_at_ms"))
    return old.unionByName(new).groupBy("key").agg(F.max_by("expires_at_ms", "seq").alias("expires_at_ms"))
