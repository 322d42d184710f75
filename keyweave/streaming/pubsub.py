"""Publish/subscribe routing, keyspace events and the change feed of watched keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.topics import is_wildcard, topic_regex
from ..operators.paging import first_ranks

#: Longer values are not carried in a change feed.
INLINE = 64 * 1024


ANCHORED = "subscriber_id string, regex string, level int, literal string"


def _anchored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each wildcard pattern's regular expression, and the first of its levels that is plain text."""
    for part in parts:
        rows = []
        for subscriber, pattern in zip(part["subscriber_id"], part["pattern"]):
            plain = next(((i, x) for i, x in enumerate(pattern.split(".")) if "*" not in x and x != "#"), (-1, ""))
            rows.append((subscriber, topic_regex(pattern), *plain))
        yield pd.DataFrame(rows, columns=["subscriber_id", "regex", "level", "literal"])


def route_table(messages: DataFrame, subscriptions: DataFrame, topic: str = "topic") -> DataFrame:
    """Messages with the subscribers they reach, each once, by subscriptions(subscriber_id, pattern).

    Exact topics hash-join.  A wildcard is filed under its first level of plain text and
    that level's place, a message looks under each of its own levels, and only patterns
    found there run their regular expression; so any number of them is a join by
    equality.  Patterns of wildcards alone are found by every message.  Messages need a
    column ``id``.
    """
    wildcard = F.col("pattern").contains("*") | F.col("pattern").contains("#")
    exact = subscriptions.filter(~wildcard).select("subscriber_id", F.col("pattern").alias(topic)).distinct()
    direct = messages.join(exact, topic).select(*messages.columns, "subscriber_id")
    wild = subscriptions.filter(wildcard).select("subscriber_id", "pattern").distinct().mapInPandas(_anchored, ANCHORED)
    levels = F.transform(F.split(topic, r"\."), lambda x, i: F.struct(i.alias("level"), x.alias("literal")))
    anywhere = F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("literal")))
    looking = messages.select("*", F.inline(F.concat(anywhere, levels)))
    reached = looking.join(wild, ["level", "literal"]).filter(F.rlike(topic, F.col("regex")))
    return direct.unionByName(reached.select(*messages.columns, "subscriber_id")).dropDuplicates(["id", "subscriber_id"])


def route(messages: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]], topic: str = "topic") -> DataFrame:
    """The same by exact(subscriber_id, topic) and a list of (subscriber_id, pattern)."""
    for _, pattern in patterns:
        topic_regex(pattern)
    given = messages.sparkSession.createDataFrame(list(patterns), "subscriber_id string, pattern string")
    return route_table(messages, exact.select("subscriber_id", F.col("topic").alias("pattern")).unionByName(given), topic)


def delivered(routed: DataFrame, connected: DataFrame, buffer: int = 1024) -> tuple[DataFrame, DataFrame]:
    """What reaches connected(subscriber_id), and the subscribers whose buffer ran over.

    A subscriber that reads nothing holds ``buffer`` messages; the next one disconnects it
    and is lost with all later ones.
    """
    here = routed.join(connected.select("subscriber_id").distinct(), "subscriber_id")
    placed = first_ranks(here, [F.col("id")], buffer, "place", "subscriber_id")
    over = here.groupBy("subscriber_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > buffer)
    return placed, over.select("subscriber_id", (F.col("n") - buffer).alias("lost"))


def stats(subscriptions: DataFrame, routed: DataFrame) -> DataFrame:
    """topics, subscribers, wildcards, deliveries, messages that reached anyone."""
    wildcard = F.col("pattern").contains("*") | F.col("pattern").contains("#")
    one = subscriptions.agg(
        F.countDistinct(F.when(~wildcard, F.col("pattern"))).alias("topics"),
        F.countDistinct("subscriber_id").alias("subscribers"),
        F.countDistinct(F.when(wildcard, F.struct("subscriber_id", "pattern"))).alias("wildcards"),
    )
    two = routed.agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("id").alias("messages"))
    return one.join(two)  # one row each


def subscribe(subscriptions: DataFrame, subscriber: str, patterns: list[str]) -> DataFrame:
    """The caller names the subscriber; a pattern is held once. Patterns that can't match raise ValueError."""
    for pattern in patterns:
        topic_regex(pattern)
    new = subscriptions.sparkSession.createDataFrame([(subscriber, p) for p in patterns], "subscriber_id string, pattern string")
    return subscriptions.select("subscriber_id", "pattern").unionByName(new).distinct()


def unsubscribe(subscriptions: DataFrame, subscriber: str, patterns: list[str] | None = None) -> DataFrame:
    gone = F.col("subscriber_id") == subscriber
    return subscriptions.filter(~(gone & F.col("pattern").isin(patterns) if patterns is not None else gone))


def topics(subscriptions: DataFrame) -> DataFrame:
    """Exact topics that are known."""
    return subscriptions.filter(~(F.col("pattern").contains("*") | F.col("pattern").contains("#"))).select(F.col("pattern").alias("topic")).distinct()


def topic_info(routed: DataFrame, topic: str = "topic") -> DataFrame:
    return routed.groupBy(topic).agg(F.countDistinct("subscriber_id").alias("subscribers"), F.countDistinct("id").alias("messages"))


def has_subscriber(subscriptions: list[tuple[str, str]], topic: Column) -> Column:
    """Whether any subscription, exact or wildcard, matches."""
    found = F.lit(False)
    for _, pattern in subscriptions:
        found = found | (topic.rlike(topic_regex(pattern)) if is_wildcard(pattern) else topic == pattern)
    return found


# Flags of a notification setting and the event class each enables.
CLASSES = {"g": "generic", "$": "string", "l": "list", "s": "set", "h": "hash", "z": "zset", "x": "expired", "e": "evicted"}


def parse_flags(spec: str) -> dict[str, bool | set[str]]:
    """K keyspace, E keyevent, a letter for each class, A for all; others are ignored."""
    classes = set(CLASSES.values()) if "A" in spec else {CLASSES[c] for c in spec if c in CLASSES}
    return {"keyspace": "K" in spec, "keyevent": "E" in spec, "classes": classes}


def keyspace_events(changes: DataFrame, spec: str = "KEA", db: int = 0) -> DataFrame:
    """topic, payload for changes(class, event, key): up to two messages for each."""
    flags = parse_flags(spec)
    messages = []
    if flags["keyspace"]:
        messages.append(F.struct(F.concat(F.lit(f"__keyspace@{db}__:"), "key").alias("topic"), F.col("event").alias("payload")))
    if flags["keyevent"]:
        messages.append(F.struct(F.concat(F.lit(f"__keyevent@{db}__:"), "event").alias("topic"), F.col("key").alias("payload")))
    wanted = changes.filter(F.col("class").isin(sorted(flags["classes"])))
    if not messages:
        return wanted.limit(0).select(F.col("key").alias("topic"), F.col("event").alias("payload"))
    return wanted.select(F.inline(F.array(*messages)))


def watch_feed(changes: DataFrame, inline: int = INLINE, db: int = 0) -> DataFrame:
    """channel, key, event, version, value, truncated for changes(seq, key, event, value).

    Versions count the changes of a key from 1 and start again after it is deleted or
    expires.  Values too long, or no UTF-8, are left out and marked.
    """
    by = W.partitionBy("key").orderBy("seq")
    life = F.coalesce(F.sum(F.col("event").isin("del", "expired").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    living = changes.withColumn("__life", life)
    version = F.row_number().over(W.partitionBy("key", "__life").orderBy("seq")).cast("long")
    fits = (F.octet_length("value") <= inline) & F.is_valid_utf8(F.col("value").cast("string"))
    return living.select(
        F.concat(F.lit(f"__watch@{db}__:"), "key").alias("channel"),
        "key",
        "event",
        version.alias("version"),
        F.when(fits, F.col("value").cast("string")).alias("value"),
        (F.col("value").isNotNull() & ~fits).alias("truncated"),
    )
