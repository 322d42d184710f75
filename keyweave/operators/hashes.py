"""Hashes: hash(key, field, value), one row for each field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paging import page


def nested(hashes: DataFrame) -> DataFrame:
    """HGETALL: key, fields (a map)."""
    return hashes.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hget(hashes: DataFrame, field: str, keys: list[str] | None = None) -> DataFrame:
    found = hashes.filter(F.col("field") == field)
    return (found.filter(F.col("key").isin(keys)) if keys else found).select("key", "value")


def hmget(hashes: DataFrame, fields: list[str]) -> DataFrame:
    """A column for each field asked for, null where a key lacks it: one pass, one shuffle."""
    return hashes.groupBy("key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def hkeys(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "field")


def hvals(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "value")


def hexists(hashes: DataFrame, field: str) -> DataFrame:
    return hashes.groupBy("key").agg(F.max(F.col("field") == field).alias("found"))


def hlen(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count(F.lit(1)).alias("n_fields"))


def hset(hashes: DataFrame, writes: DataFrame) -> DataFrame:
    """HSET and HMSET: ``writes`` (key, field, value, seq) over what is there; the last wins."""
    old = hashes.select("key", "field", "value", F.lit(-1).cast("long").alias("seq"))
    both = old.unionByName(writes.select("key", "field", "value", F.col("seq").cast("long").alias("seq")))
    return both.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def hsetnx(hashes: DataFrame, writes: DataFrame) -> DataFrame:
    """Only fields that are not there yet; the first write wins."""
    old = hashes.select("key", "field", "value", F.lit(-1).cast("long").alias("seq"))
    both = old.unionByName(writes.select("key", "field", "value", F.col("seq").cast("long").alias("seq")))
    return both.groupBy("key", "field").agg(F.min_by("value", "seq").alias("value"))


def hdel(hashes: DataFrame, fields: list[str]) -> DataFrame:
    return hashes.filter(~F.col("field").isin(fields))


def hincrby(hashes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Integer fields after all increments (key, field, num); text that is no integer raises."""
    old = hashes.join(deltas.select("key", "field").distinct(), ["key", "field"], "left_semi")
    old = old.select("key", "field", F.decode("value", "UTF-8").cast("long").alias("num"))
    both = old.unionByName(deltas.select("key", "field", F.col("num").cast("long").alias("num")))
    return both.groupBy("key", "field").agg(F.sum("num").alias("value"))


def hincrbyfloat(hashes: DataFrame, deltas: DataFrame) -> DataFrame:
    old = hashes.join(deltas.select("key", "field").distinct(), ["key", "field"], "left_semi")
    old = old.select("key", "field", F.decode("value", "UTF-8").cast("double").alias("num"))
    both = old.unionByName(deltas.select("key", "field", F.col("num").cast("double").alias("num")))
    return both.groupBy("key", "field").agg(F.sum("num").alias("value"))


def hscan(hashes: DataFrame, cursor: int, count: int, pattern: str | None = None) -> DataFrame:
    return page(hashes, F.col("field"), F.col("field"), cursor, count, pattern)


def stats(hashes: DataFrame) -> DataFrame:
    size = F.octet_length("field") + F.octet_length("value")
    return hashes.agg(F.countDistinct("key").alias("total_hashes"), F.count(F.lit(1)).alias("total_fields"), F.sum(size).cast("long").alias("total_bytes"))
