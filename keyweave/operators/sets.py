"""Sets: set(key, member), unique rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paging import first_ranks, page


def _of(sets: DataFrame, keys: list[str]) -> DataFrame:
    return sets.filter(F.col("key").isin(keys))


def sismember(sets: DataFrame, member: bytes) -> DataFrame:
    return sets.groupBy("key").agg(F.max(F.col("member") == F.lit(member)).alias("found"))


def smembers(sets: DataFrame, key: str) -> DataFrame:
    return sets.filter(F.col("key") == key).select("member")


def scard(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def sinter(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Members of all the sets; a key that is missing holds nothing, so nothing is left.

    One pass and one shuffle however many keys there are.
    """
    names = sorted(set(keys))
    return _of(sets, names).groupBy("member").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(names)).select("member")


def sunion(sets: DataFrame, keys: list[str]) -> DataFrame:
    return _of(sets, keys).select("member").distinct()


def sdiff(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first set that no other has."""
    first, others = keys[0], keys[1:]
    flags = F.max((F.col("key") == first).cast("int")).alias("own"), F.max(F.col("key").isin(others).cast("int") if others else F.lit(0)).alias("other")
    return _of(sets, keys).groupBy("member").agg(*flags).filter("own = 1 AND other = 0").select("member")


def stored(sets: DataFrame, destination: str, members: DataFrame) -> DataFrame:
    """SINTERSTORE, SUNIONSTORE, SDIFFSTORE: the destination holds ``members`` alone."""
    rest = sets.filter(F.col("key") != destination)
    return rest.unionByName(members.select(F.lit(destination).alias("key"), "member"))


def sadd(sets: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many members were new in each key, and the sets after."""
    given = new.select("key", "member").distinct()
    added = given.join(sets, ["key", "member"], "left_anti")
    counts = given.select("key").distinct().join(added.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left")
    return counts.select("key", F.coalesce("n", F.lit(0)).alias("added")), sets.unionByName(added)


def srem(sets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    given = gone.select("key", "member").distinct()
    found = sets.join(given, ["key", "member"], "left_semi")
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("removed")), sets.join(given, ["key", "member"], "left_anti")


def smove(sets: DataFrame, source: str, destination: str, member: bytes) -> DataFrame:
    """Moves the member if the source has it; the destination holds it once."""
    it = (F.col("key") == source) & (F.col("member") == F.lit(member))
    return sets.withColumn("key", F.when(it, F.lit(destination)).otherwise(F.col("key"))).distinct()


def spop(sets: DataFrame, count: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first ``count`` members of every set in byte order, and the sets after."""
    popped = first_ranks(sets, [F.col("member")], count).select("key", "member")
    return popped, sets.join(popped, ["key", "member"], "left_anti")


def srandmember(sets: DataFrame, count: int = 1, seed: int = 0) -> DataFrame:
    """``count`` different members of every set in a seeded order; all if there are fewer."""
    by = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("member").cast("string"))), F.col("member")]
    return first_ranks(sets, by, count).select("key", "member")


def sscan(sets: DataFrame, cursor: int, count: int, pattern: str | None = None) -> DataFrame:
    return page(sets, F.col("member"), F.decode("member", "UTF-8"), cursor, count, pattern)


def delete(sets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The keys that were there and are dropped, and the sets after."""
    gone = F.col("key").isin(keys)
    return sets.filter(gone).select("key").distinct(), sets.filter(~gone)


def nested(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.sort_array(F.collect_set("member")).alias("members"))


def stats(sets: DataFrame) -> DataFrame:
    per = sets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("member")).alias("b"))
    return per.agg(F.count(F.lit(1)).alias("total_sets"), F.sum("n").alias("total_members"), F.avg("n").alias("avg_members"), F.sum("b").alias("total_bytes"))
