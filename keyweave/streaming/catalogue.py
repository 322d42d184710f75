"""What exists: logs, topics, queues and groups, by the commands that made and dropped them.

Commands are rows (seq, name, op, config), op being create, ensure (create or get) or
delete.  Whether one succeeds depends on the one before it of the same name alone, so no
state is carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAKES = ("create", "ensure")


def outcomes(commands: DataFrame) -> DataFrame:
    """Each command's outcome: created, exists (an error for create alone), deleted or not found."""
    before = F.lag("op").over(W.partitionBy("name").orderBy("seq"))
    there = F.coalesce(before.isin(*MAKES), F.lit(False))
    made = F.col("op").isin(*MAKES)
    outcome = F.when(made & there, "exists").when(made, "created").when(there, "deleted").otherwise("not found")
    return commands.withColumn("outcome", outcome).withColumn("ok", ~((F.col("op") == "create") & (F.col("outcome") == "exists")) & (F.col("outcome") != "not found"))


def existing(commands: DataFrame) -> DataFrame:
    """name, seq, config of what is there: of the first creation since the last deletion; later configs are ignored."""
    gone = commands.groupBy("name").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("__gone"))
    since = commands.filter(F.col("op").isin(*MAKES)).join(gone, "name").filter(F.col("__gone").isNull() | (F.col("seq") > F.col("__gone")))
    first = since.groupBy("name").agg(F.min("seq").alias("seq"), F.min_by("config", "seq").alias("config"))
    return first.select("name", "seq", "config")


def accepted(rows: DataFrame, there: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose log, topic or queue is there, and those that are refused: nothing is made by being written to."""
    known = there.select(F.col("name").alias(name))
    return rows.join(known, name, "left_semi"), rows.join(known, name, "left_anti")


def dropped(rows: DataFrame, there: DataFrame, name: str) -> DataFrame:
    """What is left of rows once what is no longer there has been dropped with all it held."""
    return accepted(rows, there, name)[0]
