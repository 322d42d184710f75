"""Bitmaps as rows: bitmap(key, offset) holds the set bits; lengths(key, bytes) the sizes.

Offsets are numbered from 0 in the order of a byte's most significant bit first.
Ranges are in bits and inclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import placed


def setbit(bits: DataFrame, writes: DataFrame) -> DataFrame:
    """``writes`` (key, offset, bit, seq) over the bits that are set; the last write of a bit wins."""
    old = bits.select("key", "offset", F.lit(1).alias("bit"), F.lit(-1).cast("long").alias("seq"))
    both = old.unionByName(writes.select("key", "offset", F.col("bit").cast("int").alias("bit"), F.col("seq").cast("long").alias("seq")))
    return both.groupBy("key", "offset").agg(F.max_by("bit", "seq").alias("bit")).filter("bit = 1").select("key", "offset")


def getbit(bits: DataFrame, offset: int) -> DataFrame:
    """0 for keys whose bit is not set or beyond the end."""
    return bits.groupBy("key").agg(F.max((F.col("offset") == offset).cast("int")).alias("bit"))


def bitcount(bits: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    inside = F.col("offset") >= start
    if end is not None:
        inside = inside & (F.col("offset") <= end)
    return bits.groupBy("key").agg(F.count(F.when(inside, 1)).alias("bits"))


def byte_length(bits: DataFrame) -> DataFrame:
    return bits.groupBy("key").agg(F.floor(F.max("offset") / 8 + 1).alias("bytes"))


def bitpos(bits: DataFrame, value: int, start: int = 0, end: int | None = None) -> DataFrame:
    """The first place from ``start`` whose bit is ``value``; null if there is none up to the end.

    The first clear bit is where the set bits stop being as many as their places say:
    found by ranks, without a row for every place.
    """
    last = F.lit(end).cast("long") if end is not None else None
    sizes = byte_length(bits).select("key", (F.col("bytes") * 8 - 1).alias("__last"))
    inside = bits.filter(F.col("offset") >= start)
    if value == 1:
        found = inside.groupBy("key").agg(F.min("offset").alias("pos"))
    else:
        run = placed(inside, ["key"], [F.col("offset")], "__run").filter(F.col("offset") == F.col("__run") + start)
        found = run.groupBy("key").agg((F.max("offset") + 1).alias("pos"))
        found = bits.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("pos", F.lit(start).cast("long")).alias("pos"))
    limit = F.least(F.col("__last"), last) if last is not None else F.col("__last")
    return sizes.join(found, "key", "left").select("key", F.when(F.col("pos") <= limit, F.col("pos")).alias("pos"))


def bitop(bits: DataFrame, operation: str, keys: list[str]) -> DataFrame:
    """Offsets of the result. AND and XOR take two keys or more, NOT one; a bit beyond a source is 0."""
    operation = operation.upper()
    if operation == "NOT":
        if len(keys) != 1:
            raise ValueError("NOT takes one key")
        own = bits.filter(F.col("key") == keys[0])
        ends = byte_length(own)
        places = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") * 8 - 1)).alias("offset"))
        return places.join(own.select("offset"), "offset", "left_anti")
    if operation in ("AND", "XOR") and len(keys) < 2:
        raise ValueError(f"{operation} takes two keys or more")
    counted = bits.filter(F.col("key").isin(keys)).groupBy("offset").agg(F.count(F.lit(1)).alias("n"))
    wanted = {"AND": F.col("n") == len(keys), "OR": F.lit(True), "XOR": F.col("n") % 2 == 1}[operation]
    return counted.filter(wanted).select("offset")


def dense(bits: DataFrame) -> DataFrame:
    """key, bucket, bits: Spark's bitmaps, one for each 32768 offsets."""
    at = F.col("offset") + 1
    return bits.groupBy("key", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def dense_count(dense_bits: DataFrame) -> DataFrame:
    return dense_bits.groupBy("key").agg(F.sum(F.bitmap_count("bits")).alias("bits"))


def stats(bits: DataFrame) -> DataFrame:
    return bits.agg(F.countDistinct("key").alias("total_bitmaps"), F.count(F.lit(1)).alias("total_bits"), F.max("offset").alias("highest"))
