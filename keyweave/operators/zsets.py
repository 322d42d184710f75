"""Sorted sets: zset(key, member, score), ordered by score and then member bytes; NaN comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import first_ranks, page, ranked, requested, sliced


def order() -> list[Column]:
    return [(~F.isnan("score")).asc(), F.col("score").asc(), F.col("member").asc()]


def reverse() -> list[Column]:
    return [(~F.isnan("score")).desc(), F.col("score").desc(), F.col("member").desc()]


def zrank(zsets: DataFrame) -> DataFrame:
    return ranked(zsets, order())


def zrevrank(zsets: DataFrame) -> DataFrame:
    return ranked(zsets, reverse())


def zrange(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    return sliced(zsets, order(), reverse(), start, stop)


def zrevrange(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    return sliced(zsets, reverse(), order(), start, stop)


def zrangebyscore(zsets: DataFrame, low: float, high: float) -> DataFrame:
    """Both bounds belong to the range; the filter reaches the file scan."""
    return zsets.filter(F.col("score").between(low, high))


def zcount(zsets: DataFrame, low: float, high: float) -> DataFrame:
    return zrangebyscore(zsets, low, high).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def zcard(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def zscore(zsets: DataFrame, member: bytes) -> DataFrame:
    return zsets.filter(F.col("member") == F.lit(member)).select("key", "score")


def zmscore(zsets: DataFrame, key: str, members: list[bytes]) -> DataFrame:
    return requested(zsets.filter(F.col("key") == key), members, "member", "score")


def zpopmin(zsets: DataFrame, count: int = 1) -> tuple[DataFrame, DataFrame]:
    popped = first_ranks(zsets, order(), count)
    return popped, zrem(zsets, popped)


def zpopmax(zsets: DataFrame, count: int = 1) -> tuple[DataFrame, DataFrame]:
    popped = first_ranks(zsets, reverse(), count)
    return popped, zrem(zsets, popped)


def bzpop(zsets: DataFrame, keys: list[str], *, largest: bool = False) -> DataFrame:
    """BZPOPMIN and BZPOPMAX of what is there: the first key in argument order that has members."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    by = reverse() if largest else order()
    return zsets.filter(F.col("key").isin(keys)).withColumn("__place", place).orderBy("__place", *by).limit(1).drop("__place")


def zremrangebyrank(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    gone = zrange(zsets, start, stop).select("key", "member")
    return zsets.join(gone, ["key", "member"], "left_anti")


def zremrangebyscore(zsets: DataFrame, low: float, high: float) -> DataFrame:
    return zsets.filter(~F.col("score").between(low, high))


def zrem(zsets: DataFrame, gone: DataFrame) -> DataFrame:
    return zsets.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def zincrby(zsets: DataFrame, deltas: DataFrame) -> DataFrame:
    """All increments (key, member, num) added; members that are new start at 0."""
    both = zsets.select("key", "member", "score").unionByName(deltas.select("key", "member", F.col("num").cast("double").alias("score")))
    return both.groupBy("key", "member").agg(F.sum("score").alias("score"))


def zadd(zsets: DataFrame, new: DataFrame, *, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, incr: bool = False) -> DataFrame:
    """One ZADD of ``new`` (key, member, score; members unique): the sets after, with ``added`` and ``changed``.

    An option that refuses a member leaves it as it was.  A sequence of ZADDs is folded
    from the operation log.
    """
    old, given = F.col("o.score"), F.col("n.score")
    joined = zsets.alias("o").join(new.alias("n"), (F.col("o.key") == F.col("n.key")) & (F.col("o.member") == F.col("n.member")), "full")
    here, there = F.col("n.key").isNotNull(), F.col("o.key").isNotNull()
    refused = F.lit(False)
    if nx:
        refused = refused | there
    if xx:
        refused = refused | ~there
    if gt:
        refused = refused | (there & (given <= old))
    if lt:
        refused = refused | (there & (given >= old))
    score = F.when(here & ~refused, F.when(there, old + given).otherwise(given) if incr else given).otherwise(old)
    out = joined.select(
        F.coalesce("o.key", "n.key").alias("key"),
        F.coalesce("o.member", "n.member").alias("member"),
        score.alias("score"),
        (here & ~refused & ~there).alias("added"),
        (here & ~refused & (~there | (score != old))).alias("changed"),
    )
    return out.filter(F.col("score").isNotNull())


AGGREGATES = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def _weighted(zsets: DataFrame, keys: list[str], weights: list[float] | None) -> DataFrame:
    weights = weights or [1.0] * len(keys)
    given = zsets.sparkSession.createDataFrame([(k, float(w)) for k, w in zip(keys, weights)], "key string, weight double")
    # the keys are arguments of the command, so their table is broadcast
    picked = zsets.filter(F.col("key").isin(keys)).join(F.broadcast(given), "key")
    return picked.select("key", "member", (F.col("score") * F.col("weight")).alias("score"))


def zunion(zsets: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    return _weighted(zsets, keys, weights).groupBy("member").agg(AGGREGATES[aggregate.upper()]("score").alias("score"))


def zinter(zsets: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """One shuffle on the member, however many keys."""
    grouped = _weighted(zsets, keys, weights).groupBy("member")
    found = grouped.agg(AGGREGATES[aggregate.upper()]("score").alias("score"), F.count(F.lit(1)).alias("__n"))
    return found.filter(F.col("__n") == len(keys)).drop("__n")


def zdiff(zsets: DataFrame, keys: list[str]) -> DataFrame:
    """The first set's members, with its scores, that no other has."""
    own = F.col("key") == keys[0]
    grouped = zsets.filter(F.col("key").isin(keys)).groupBy("member")
    found = grouped.agg(F.max(F.when(own, F.col("score"))).alias("score"), F.max((~own).cast("int")).alias("__other"))
    return found.filter((F.col("__other") == 0) & F.col("score").isNotNull()).drop("__other")


def stored(zsets: DataFrame, destination: str, result: DataFrame) -> DataFrame:
    """Z*STORE: the destination holds the result alone, even an empty one."""
    return zsets.filter(F.col("key") != destination).unionByName(result.select(F.lit(destination).alias("key"), "member", "score"))


def zscan(zsets: DataFrame, cursor: int, count: int, pattern: str | None = None) -> DataFrame:
    """Pages in the order of members, not of scores."""
    return page(zsets, F.col("member"), F.decode("member", "UTF-8"), cursor, count, pattern)


def stats(zsets: DataFrame) -> DataFrame:
    per = zsets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("total_keys"), F.sum("n").alias("total_members"), F.avg("n").alias("avg_members"))


def zttl(expires_at: Column, now: int) -> Column:
    """Seconds left of a sorted set, negative once overdue."""
    return expires_at - F.lit(now)


def top(zsets: DataFrame, count: int) -> DataFrame:
    """ZREVRANGE 0 count-1 of every key with the rank limit where Spark can use it."""
    return first_ranks(zsets, reverse(), count)
