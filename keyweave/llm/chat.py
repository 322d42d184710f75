"""Multi-party perspective rotation of dialogues (DataFrame functions only).

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users.  A row is one turn as one
participant sees it; the characters ``start`` to ``end`` are its place in that
participant's rendering, and ``mask`` says whether a model should learn it.

Places are running sums over the turns before.  They are summed within blocks of
turns and then over the blocks, and turns meet their speakers block by block, so a
conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Turns that are summed in one task.
BLOCK = 256
#: Speaker of a turn whose role is null or empty.
NOBODY = "unknown"
#: Speakers who only set the scene: they get no perspective of their own.
SCENE = ("system",)


def rotate(turns: DataFrame, *, scene: tuple[str, ...] = SCENE, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, turn, role, name, rendered, mask, start, end.

    Needs conv_id, turn, role, text; other columns are ignored.  Null text renders as
    empty, a null or empty role as ``unknown``; null turns come first, and turns that
    tie are taken by role and text (equal rows are equal turns, each kept).  Null
    conv_ids are one conversation.  A conversation of scene speakers alone has no
    participant and so no rows; an empty table gives none.
    """
    speaker = F.when(F.coalesce(F.col("role"), F.lit("")) == "", NOBODY).otherwise(F.col("role"))
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("name"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sceneries = F.col("name").isin(list(scene)) if scene else F.lit(False)
    body = F.concat("text", F.lit("\n"))
    said = said.select(
        "*",
        F.when(sceneries, F.concat(F.lit("<|"), "name", F.lit("|>\n"), body)).otherwise(F.concat(F.lit("<|user name="), "name", F.lit("|>\n"), body)).alias("as_other"),
        F.concat(F.lit("<|assistant|>\n"), body).alias("as_self"),
        F.floor(F.coalesce("turn", F.lit(-1)) / block).alias("block"),
    )
    people = said.filter(~sceneries).select(F.col("conv_id").alias("c"), F.col("name").alias("perspective")).distinct()
    # the speakers go to every block of their conversation: its turns need not meet in one task
    blocks = said.select(F.col("conv_id").alias("c2"), F.col("block").alias("b2")).distinct()
    people = people.join(blocks, F.col("c").eqNullSafe(F.col("c2"))).drop("c2")
    seen = said.join(people, said["conv_id"].eqNullSafe(people["c"]) & (said["block"] == people["b2"])).drop("c", "b2")
    own = F.col("name") == F.col("perspective")
    seen = seen.withColumn("rendered", F.when(own, F.col("as_self")).otherwise(F.col("as_other"))).withColumn("mask", own)
    seen = seen.withColumn("long", F.length("rendered").cast("long"))
    view = ["conv_id", "perspective"]
    blocks = seen.groupBy(*view, "block").agg(F.sum("long").alias("n"))
    before = W.partitionBy(*view).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy(*view, "block").orderBy(F.col("turn").asc_nulls_first(), "name", "text").rowsBetween(W.unboundedPreceding, 0)
    seen = seen.withColumn("upto", F.sum("long").over(inside))
    placed = seen.join(blocks, seen["conv_id"].eqNullSafe(F.col("c")) & (seen["perspective"] == F.col("p")) & (seen["block"] == F.col("b")))
    role = F.when(F.col("mask"), "assistant").when(sceneries, F.col("name")).otherwise("user")
    end = F.col("offset") + F.col("upto")
    return placed.select("conv_id", "perspective", "turn", role.alias("role"), "name", "rendered", "mask", (end - F.col("long")).alias("start"), end.alias("end"))
