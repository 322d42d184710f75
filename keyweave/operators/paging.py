"""Ranks, slices and cursor pages within a key, shared by lists, sets, hashes and sorted sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.glob import glob_match
from ..functions.ranges import within
from ..plans.staging import placed


def ranked(df: DataFrame, by: list[Column], name: str = "rank", key: str = "key") -> DataFrame:
    """A 0-based rank within each key, however large one is."""
    return placed(df, [key], by, name)


def first_ranks(df: DataFrame, by: list[Column], count: int, name: str = "rank", key: str = "key") -> DataFrame:
    """The first ``count`` of each key with their ranks: Spark keeps no more than these of a key in each task before it shuffles."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*by))
    return df.withColumn(name, (rank - 1).cast("long")).filter(F.col(name) < count)


def sizes(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__size"))


def sliced(df: DataFrame, by: list[Column], back: list[Column], start: int, stop: int, name: str = "rank", key: str = "key") -> DataFrame:
    """Rows of rank ``start`` to ``stop`` in each key; negative ranks count from the end.

    Slices near the beginning, or near the end (``back`` is the reverse order), rank no
    more than the rows up to there; only those across a key rank all of it.
    """
    rank = F.col(name)
    if start >= 0 and stop >= 0:
        return first_ranks(df, by, stop + 1, name, key).filter(rank >= start)
    if start < 0 and stop < 0:
        near = first_ranks(df, back, -start, name, key).filter(rank >= -stop - 1)
        return near.join(sizes(df, key), key).withColumn(name, F.col("__size") - 1 - rank).drop("__size")
    sized = ranked(df, by, name, key).join(sizes(df, key), key)
    return sized.filter(within(rank, F.col("__size"), start, stop)).drop("__size")


def page(df: DataFrame, by: Column, text: Column, cursor: int, count: int, pattern: str | None = None, key: str = "key") -> DataFrame:
    """One page of every key, with ``next_cursor`` (0: done).

    The window is cut first and the pattern applied within it, so a page may hold fewer
    rows than ``count``, or none, and not be the last.
    """
    cut = first_ranks(df, [by], cursor + count, "__at", key).filter(F.col("__at") >= cursor).join(sizes(df, key), key)
    after = F.when(F.col("__size") > cursor + count, F.lit(cursor + count)).otherwise(F.lit(0)).cast("long")
    cut = cut.withColumn("next_cursor", after).sortWithinPartitions(key, "__at").drop("__at", "__size")
    return cut.filter(glob_match(text, pattern)) if pattern else cut


def requested(df: DataFrame, names: list, column: str, value: str) -> DataFrame:
    """The values of the names asked for, in order, null where there is none.

    The request is a literal list of the caller's, so its side of the join is broadcast.
    """
    spark = df.sparkSession
    kind = df.schema[column].dataType.simpleString()
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"pos int, {column} {kind}")
    wanted = df.filter(F.col(column).isin(list(names))) if kind == "string" else df
    found = wanted.select(column, value)
    return asked.join(found, column, "left").select("pos", column, value)
