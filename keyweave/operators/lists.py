"""Lists: list(key, idx, value), dense indexes from 0; and the same over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import within
from ..plans.staging import placed
from .paging import first_ranks


def _sized(lists: DataFrame) -> DataFrame:
    """The size of each list beside its rows: an aggregate joined back, so a long list is not one task's."""
    sizes = lists.groupBy("key").agg((F.max("idx") + 1).alias("__size"))
    return lists.join(sizes, "key")


def llen(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements ``start`` to ``stop`` inclusive; indexes are stored, so none is computed."""
    if start >= 0 and stop >= 0:
        return lists.filter((F.col("idx") >= start) & (F.col("idx") <= stop))
    return _sized(lists).filter(within(F.col("idx"), F.col("__size"), start, stop)).select("key", "idx", "value")


def lindex(lists: DataFrame, index: int) -> DataFrame:
    if index >= 0:
        return lists.filter(F.col("idx") == index).select("key", "value")
    return _sized(lists).filter(F.col("idx") == F.col("__size") + index).select("key", "value")


def lpos(lists: DataFrame, value: bytes | str) -> DataFrame:
    """The first index of the value in each list that has it."""
    wanted = F.lit(value.encode() if isinstance(value, str) else value)
    return lists.filter(F.col("value") == wanted).groupBy("key").agg(F.min("idx").alias("pos"))


def ltrim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Indexes are dense, so what is left moves down by what went before it."""
    kept = lrange(lists, start, stop)
    first = kept.groupBy("key").agg(F.min("idx").alias("__first"))
    return kept.join(first, "key").select("key", (F.col("idx") - F.col("__first")).alias("idx"), "value")


def push(lists: DataFrame, values: DataFrame, *, left: bool = False, only_existing: bool = False) -> DataFrame:
    """LPUSH, RPUSH and their X forms: ``values`` (key, value, seq), one after the other.

    Pushed on the left, the last pushed comes first.  Only what is pushed is numbered;
    what is there stays, or moves up by their number.
    """
    new = values.select("key", "value", F.col("seq").cast("long").alias("seq"))
    if only_existing:
        new = new.join(lists.select("key").distinct(), "key", "left_semi")
    at = placed(new, ["key"], [F.col("seq").desc() if left else F.col("seq").asc()], "idx")
    if left:
        many = new.groupBy("key").agg(F.count(F.lit(1)).alias("__many"))
        old = lists.join(many, "key", "left").select("key", (F.col("idx") + F.coalesce("__many", F.lit(0))).alias("idx"), "value")
        return old.unionByName(at.select("key", "idx", "value"))
    sizes = lists.groupBy("key").agg((F.max("idx") + 1).alias("__size"))
    added = at.join(sizes, "key", "left").select("key", (F.col("idx") + F.coalesce("__size", F.lit(0))).alias("idx"), "value")
    return lists.select("key", "idx", "value").unionByName(added)


def pop(lists: DataFrame, count: int = 1, *, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is popped (with its order ``at``), and the lists after."""
    sized = _sized(lists)
    at = (F.col("__size") - 1 - F.col("idx")) if right else F.col("idx")
    sized = sized.withColumn("at", at)
    popped = sized.filter(F.col("at") < count).select("key", "at", "value")
    rest = sized.filter(F.col("at") >= count).select("key", (F.col("idx") if right else F.col("idx") - count).alias("idx"), "value")
    return popped, rest


def lset(lists: DataFrame, index: int, value: bytes) -> DataFrame:
    """An index out of range changes nothing."""
    sized = _sized(lists)
    at = F.lit(index) if index >= 0 else F.col("__size") + index
    return sized.select("key", "idx", F.when(F.col("idx") == at, F.lit(value)).otherwise(F.col("value")).alias("value"))


def lrem(lists: DataFrame, count: int, value: bytes) -> tuple[DataFrame, DataFrame]:
    """How many equal elements were removed from each list, and the lists after.

    A positive count removes from the head, a negative one from the tail, 0 all.
    """
    same = lists.filter(F.col("value") == F.lit(value)).select("key", "idx")
    if count:
        gone = first_ranks(same, [F.col("idx").desc() if count < 0 else F.col("idx").asc()], abs(count), "__nth").select("key", "idx")
    else:
        gone = same
    removed = lists.select("key").distinct().join(gone.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left")
    removed = removed.select("key", F.coalesce("n", F.lit(0)).alias("removed"))
    if count:  # few of each list: what is left moves down by those before it
        few = gone.groupBy("key").agg(F.collect_list("idx").alias("__gone"))
        marked = lists.join(few, "key", "left").filter(~F.coalesce(F.array_contains("__gone", F.col("idx")), F.lit(False)))
        before = F.coalesce(F.size(F.filter("__gone", lambda i: i < F.col("idx"))), F.lit(0))
        return removed, marked.select("key", (F.col("idx") - before).alias("idx"), "value")
    rest = lists.filter(F.col("value") != F.lit(value)).select("key", "value", F.col("idx").alias("__was"))
    return removed, placed(rest, ["key"], [F.col("__was")], "idx").select("key", "idx", "value")


def linsert(lists: DataFrame, pivot: bytes, value: bytes, *, before: bool = True) -> DataFrame:
    """Beside the first pivot of each list that has one."""
    at = lpos(lists, pivot).select("key", (F.col("pos") + (0 if before else 1)).alias("__at"))
    moved = lists.join(at, "key", "left").select("key", (F.col("idx") + F.coalesce((F.col("idx") >= F.col("__at")).cast("int"), F.lit(0))).alias("idx"), "value")
    return moved.unionByName(at.select("key", F.col("__at").alias("idx"), F.lit(value).alias("value")))


def rpoplpush(lists: DataFrame, source: str, destination: str) -> DataFrame:
    """The last element of one list becomes the first of another (or of itself)."""
    last = _sized(lists.filter(F.col("key") == source)).filter(F.col("idx") == F.col("__size") - 1)
    moved = last.select(F.lit(destination).alias("key"), F.lit(0).cast("long").alias("idx"), "value")
    # one row at most: whether there is anything to move, and from where
    found = last.select(F.col("idx").alias("__last"))
    marked = lists.join(F.broadcast(found), F.lit(True), "left")
    rest = marked.filter(~((F.col("key") == source) & F.coalesce(F.col("idx") == F.col("__last"), F.lit(False))))
    up = ((F.col("key") == destination) & F.col("__last").isNotNull()).cast("int")
    return rest.select("key", (F.col("idx") + up).alias("idx"), "value").unionByName(moved)


def bpop(lists: DataFrame, keys: list[str], *, right: bool = False) -> DataFrame:
    """BLPOP and BRPOP of what is there: the first key in argument order that has elements.

    One row at most; a stream's trigger stands for waiting.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    at = F.col("idx").desc() if right else F.col("idx").asc()
    return lists.filter(F.col("key").isin(keys)).withColumn("__order", order).orderBy("__order", at).limit(1).select("key", "value")


def delete(lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The keys that were there and are dropped, and the lists after."""
    gone = F.col("key").isin(keys)
    return lists.filter(gone).select("key").distinct(), lists.filter(~gone)


def exists(lists: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(lists.select("key"), "key", "left_semi")


def nested(lists: DataFrame) -> DataFrame:
    """key, values (an array in order)."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "value")))
    return lists.groupBy("key").agg(F.transform(rows, lambda x: x["value"]).alias("values"))


def stats(lists: DataFrame) -> DataFrame:
    return lists.agg(F.countDistinct("key").alias("total_lists"), F.count(F.lit(1)).alias("total_elements"), F.sum(F.octet_length("value")).cast("long").alias("total_bytes"))
