"""Approximate distinct counts: mergeable sketches of 2**14 registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 14


def pfadd(elements: DataFrame, column: str = "element") -> DataFrame:
    """sketch(key, sketch) of elements(key, element)."""
    return elements.groupBy("key").agg(F.hll_sketch_agg(column, F.lit(PRECISION)).alias("sketch"))


def pfcount(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The estimate of each key, or of all ``keys`` together."""
    if keys is None:
        return sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
    return sketches.filter(F.col("key").isin(keys)).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def pfmerge(sketches: DataFrame, destination: str, sources: list[str]) -> DataFrame:
    """The destination's own elements stay in its sketch."""
    merged = sketches.filter(F.col("key").isin([destination, *sources])).agg(F.hll_union_agg("sketch").alias("sketch"))
    rest = sketches.filter(F.col("key") != destination)
    return rest.unionByName(merged.select(F.lit(destination).alias("key"), "sketch"))


def stats(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.count(F.lit(1)).alias("total_sketches"), F.sum(F.octet_length("sketch")).cast("long").alias("total_bytes"))
