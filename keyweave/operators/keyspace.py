"""Commands on keys of any type; the five types that have a TYPE, by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECEDENCE = ("zset", "set", "list", "hash", "string")


def all_keys(stores: dict[str, DataFrame]) -> DataFrame:
    """key, type: the first type in precedence that has the key."""
    parts = [df.select("key", F.lit(PRECEDENCE.index(name)).alias("__place")) for name, df in stores.items()]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    names = F.array(*[F.lit(n) for n in PRECEDENCE])
    return both.groupBy("key").agg(F.min("__place").alias("__place")).select("key", F.get(names, F.col("__place")).alias("type"))


def key_type(stores: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """The type of each of ``keys``; ``none`` if no store has it."""
    return keys.join(all_keys(stores), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def exists(stores: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    return keys.join(all_keys(stores), "key", "left_semi")


def rename(store: DataFrame, source: str, destination: str, *, only_new: bool = False) -> DataFrame:
    """All rows of the source under the destination's name, expiry included; the destination's own go.

    RENAMENX changes nothing if the destination is there; a missing source never does.
    """
    there = store.agg(
        F.coalesce(F.max(F.col("key") == source), F.lit(False)).alias("__source"),
        F.coalesce(F.max(F.col("key") == destination), F.lit(False)).alias("__taken"),
    )
    go = F.col("__source") & ~F.col("__taken") if only_new else F.col("__source")
    marked = store.crossJoin(F.broadcast(there)).filter(~go | (F.col("key") != destination))
    return marked.withColumn("key", F.when(go & (F.col("key") == source), F.lit(destination)).otherwise(F.col("key"))).drop("__source", "__taken")


def copy(store: DataFrame, source: str, destination: str, *, replace: bool = False) -> DataFrame:
    there = store.agg(F.coalesce(F.max(F.col("key") == destination), F.lit(False)).alias("__taken"), F.coalesce(F.max(F.col("key") == source), F.lit(False)).alias("__source"))
    marked = store.crossJoin(F.broadcast(there))
    go = F.col("__source") if replace else F.col("__source") & ~F.col("__taken")
    kept = marked.filter(~go | (F.col("key") != destination))
    copied = marked.filter(go & (F.col("key") == source)).withColumn("key", F.lit(destination))
    return kept.unionByName(copied).drop("__taken", "__source")


def random_key(stores: dict[str, DataFrame], seed: int = 0) -> DataFrame:
    return all_keys(stores).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "key")), "key").limit(1).select("key")


def memory_usage(stores: dict[str, DataFrame]) -> DataFrame:
    """key, type, bytes: octets of keys, names and values a store holds for each key."""
    parts = []
    for name, df in stores.items():
        held = F.lit(0)
        for field in df.schema.fields:
            kind = field.dataType.simpleString()
            if field.name != "key":
                held = held + (F.coalesce(F.octet_length(field.name), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
        parts.append(df.groupBy("key").agg((F.sum(held) + F.octet_length("key")).cast("long").alias("bytes")).withColumn("type", F.lit(name)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.select("key", "type", "bytes")
