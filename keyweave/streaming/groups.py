"""Consumer groups: who reads which partition, and how far they got."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def members_after(commands: DataFrame) -> DataFrame:
    """group_id, member_id, last_heartbeat, session_timeout_secs after commands(seq, ts, group_id, member_id, op, session_timeout_secs).

    op is join, heartbeat or leave.  A member is there from its last join on unless it left
    since; a heartbeat of one that is not there says nothing.
    """
    who = ["group_id", "member_id"]
    changes = commands.filter(F.col("op").isin("join", "leave")).groupBy(*who).agg(F.max_by(F.struct("op", "seq", "session_timeout_secs"), "seq").alias("c"))
    there = changes.filter("c.op = 'join'").select(*who, F.col("c.seq").alias("__since"), F.col("c.session_timeout_secs").alias("session_timeout_secs"))
    heard = commands.join(there, who).filter((F.col("seq") >= F.col("__since")) & F.col("op").isin("join", "heartbeat"))
    last = heard.groupBy(*who).agg(F.max("ts").alias("last_heartbeat"))
    return there.join(last, who).select(*who, "last_heartbeat", "session_timeout_secs")


def generations(commands: DataFrame) -> DataFrame:
    """group_id, generation: how often the group's partitions were dealt anew, once for each rebalance command."""
    return commands.groupBy("group_id").agg(F.count(F.when(F.col("op") == "rebalance", 1)).alias("generation"))


def rebalanced(members: DataFrame, now: Column, partitions: int, strategy: str = "round_robin") -> DataFrame:
    """The assignment once dead members are dropped, by ``round_robin`` or ``range``."""
    assign = {"round_robin": assign_round_robin, "range": assign_range}[strategy]
    return assign(alive(members, now).select("group_id", "member_id"), partitions)


def assignment(assigned: DataFrame, group_id: str, member_id: str) -> DataFrame:
    return assigned.filter((F.col("group_id") == group_id) & (F.col("member_id") == member_id)).select("partition_id")


def group_ids(members: DataFrame) -> DataFrame:
    return members.select("group_id").distinct()


def alive(members: DataFrame, now: Column) -> DataFrame:
    """Members heard of within their session's timeout."""
    return members.filter(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_heartbeat").cast("timestamp")) < F.col("session_timeout_secs"))


def needs_rebalance(members: DataFrame, now: Column) -> DataFrame:
    dead = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_heartbeat").cast("timestamp")) >= F.col("session_timeout_secs")
    return members.groupBy("group_id").agg(F.max(dead).alias("needs_rebalance"))


def _numbered(members: DataFrame) -> DataFrame:
    """Members of a group are processes; their number is not data."""
    group = W.partitionBy("group_id")
    sized = members.withColumn("n", F.count(F.lit(1)).over(group))
    return sized.withColumn("place", F.row_number().over(group.orderBy("member_id")) - 1)


def assign_round_robin(members: DataFrame, partitions: int) -> DataFrame:
    """group_id, member_id, partition_id: partition p to the member p modulo their number, in order of ids."""
    each = F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition_id")
    return _numbered(members).select("group_id", "member_id", "place", "n", each).filter(F.pmod("partition_id", "n") == F.col("place")).select("group_id", "member_id", "partition_id")


def assign_range(members: DataFrame, partitions: int) -> DataFrame:
    """Blocks of neighbours; the first members have one more if it doesn't divide."""
    each, more = F.floor(F.lit(partitions) / F.col("n")).cast("int"), F.pmod(F.lit(partitions), F.col("n")).cast("int")
    placed = _numbered(members).withColumn("first", F.col("place") * each + F.least("place", more))
    placed = placed.withColumn("last", F.col("first") + each + (F.col("place") < more).cast("int") - 1).filter("last >= first")
    return placed.select("group_id", "member_id", F.explode(F.sequence("first", "last")).alias("partition_id"))


def assign_sticky(members: list[str], current: dict[str, list[int]], partitions: int) -> dict[str, list[int]]:
    """Keeps what members have, gives out what nobody has, and levels the rest; no partition is lost.

    A handful of members: plain Python on the driver.
    """
    order = sorted(members)
    if not order:
        return {}
    held = {m: sorted(p for p in set(current.get(m, ())) if p < partitions) for m in order}
    owned = {p for ps in held.values() for p in ps}
    for i, p in enumerate(p for p in range(partitions) if p not in owned):
        held[order[i % len(order)]].append(p)
    target = partitions // len(order)
    for m in order:
        while len(held[m]) > target + 1:
            least = min(order, key=lambda x: (len(held[x]), x))
            held[least].append(held[m].pop())
    return {m: sorted(ps) for m, ps in held.items()}


def committed(commits: DataFrame) -> DataFrame:
    """The last commit of each group and partition, even if it goes back."""
    return commits.groupBy("group_id", "partition_id").agg(F.max_by("offset", "seq").alias("offset"))


def group_stats(members: DataFrame, commits: DataFrame) -> DataFrame:
    n = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    c = committed(commits).groupBy("group_id").agg(F.count(F.lit(1)).alias("committed_partitions"), F.sum("offset").alias("total_committed"))
    return n.join(c, "group_id", "left").select("group_id", "members", F.coalesce("committed_partitions", F.lit(0)).alias("committed_partitions"), F.coalesce("total_committed", F.lit(0)).alias("total_committed"))


def lag(topic: DataFrame, commits: DataFrame) -> DataFrame:
    """How many events of each partition a group has still to read."""
    ends = topic.groupBy("partition_id").agg((F.max("offset") + 1).alias("end"))
    return committed(commits).join(ends, "partition_id").select("group_id", "partition_id", (F.col("end") - F.col("offset")).alias("lag"))
