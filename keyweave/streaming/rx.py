"""Dataflow operators of client observables, over timestamped rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def map_items(df: DataFrame, **columns: Column) -> DataFrame:
    """Each item as the given columns; of a stream as of a table."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def filter_items(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def take(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    return df.orderBy(*by).limit(n)


def skip(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    return df.orderBy(*by).offset(n)


def take_while(df: DataFrame, condition: Column, by: list[str], key: str) -> DataFrame:
    """The rows of each key before the first that fails.

    The first failure is a minimum joined back; no key's rows are ordered.
    """
    order = F.struct(*by)
    failed = df.filter(~F.coalesce(condition, F.lit(False))).groupBy(key).agg(F.min(order).alias("__first"))
    joined = df.join(failed, key, "left")
    return joined.filter(F.col("__first").isNull() | (order < F.col("__first"))).drop("__first")


def debounce(df: DataFrame, seconds: float, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Items after which their key is quiet for ``seconds``: the last of each burst."""
    following = F.lead(ts).over(W.partitionBy(key).orderBy(ts, tie))
    gap = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") > int(seconds * 1e6))).drop("__gap")


def buffer_time(df: DataFrame, seconds: int, key: str, ts: str = "ts") -> DataFrame:
    """Items gathered until their key is quiet for ``seconds``: session windows, also in a stream."""
    session = F.session_window(ts, f"{seconds} seconds")
    return df.groupBy(key, session.alias("session")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "n")


def merge(*dfs: DataFrame) -> DataFrame:
    """One sequence after another, told apart by ``source``; streams are interleaved as they arrive."""
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(i)) for i, df in enumerate(dfs)])


def process(messages: DataFrame, handler, batch: int):
    """For ``foreachBatch``: the handler gets each row; its answer becomes an ack or a nack.

    Returns (id, outcome) rows; the handler runs where the rows are.
    """
    import pandas as pd

    def run(parts):
        for part in parts:
            answers = []
            for row in part.to_dict("records"):
                try:
                    handler(row)
                    answers.append("ack")
                except Exception:  # whatever the handler raises is its refusal
                    answers.append("nack")
            yield pd.DataFrame({"id": part["id"], "outcome": answers})

    return messages.limit(batch).mapInPandas(run, "id string, outcome string") if batch else messages.mapInPandas(run, "id string, outcome string")
