"""Readers of a log in groups: each event goes to one consumer of a group, and is pending until acknowledged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.staging import placed


def without(events: DataFrame, deleted: DataFrame) -> DataFrame:
    """XDEL: events(room, offset) but the deleted ones; offsets stay as they are."""
    return events.join(deleted.select("room", "offset").distinct(), ["room", "offset"], "left_anti")


def removed(events: DataFrame, deleted: DataFrame) -> DataFrame:
    """How many of the named events of each room were there."""
    there = deleted.select("room", "offset").distinct().join(events.select("room", "offset"), ["room", "offset"], "left_semi")
    return there.groupBy("room").agg(F.count(F.lit(1)).alias("removed"))


def deliveries(events: DataFrame, reads: DataFrame) -> DataFrame:
    """XREADGROUP: room, group_id, consumer_id, seq, offset of what reads(room, group_id, consumer_id, seq, max_events) get.

    A group's reads take the room's events in turn, each as many as it asks for, so what a
    read gets is a range of places; events meet it by an equality on their place.
    """
    order = W.partitionBy("room", "group_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    asked = reads.withColumn("__from", F.coalesce(F.sum("max_events").over(order), F.lit(0))).filter("max_events > 0")
    size = events.groupBy("room").agg(F.count(F.lit(1)).alias("__size"))
    # no place beyond the end is made, however many events a read asks for
    within = asked.join(size, "room").filter(F.col("__from") < F.col("__size"))
    last = F.least(F.col("__from") + F.col("max_events"), F.col("__size")) - 1
    each = within.select("room", "group_id", "consumer_id", "seq", F.explode(F.sequence(F.col("__from"), last)).alias("__place"))
    at = placed(events.select("room", "offset"), ["room"], [F.col("offset")], "__place")
    return each.join(at, ["room", "__place"]).select("room", "group_id", "consumer_id", "seq", "offset")


def pending(delivered: DataFrame, acks: DataFrame) -> DataFrame:
    """XPENDING: what was delivered and not acknowledged, by acks(room, group_id, offset)."""
    return delivered.join(acks.select("room", "group_id", "offset").distinct(), ["room", "group_id", "offset"], "left_anti")


def acknowledged(delivered: DataFrame, acks: DataFrame) -> DataFrame:
    """XACK: how many of the named events of each room and group were pending."""
    named = acks.select("room", "group_id", "offset").distinct()
    found = named.join(delivered.select("room", "group_id", "offset"), ["room", "group_id", "offset"], "left_semi")
    return found.groupBy("room", "group_id").agg(F.count(F.lit(1)).alias("acknowledged"))


def group_positions(delivered: DataFrame) -> DataFrame:
    """How far each group of a room has read, and how many consumers it has."""
    return delivered.groupBy("room", "group_id").agg(F.max("offset").alias("last_delivered"), F.countDistinct("consumer_id").alias("consumers"))
