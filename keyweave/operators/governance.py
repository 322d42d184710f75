"""Tenants, quotas, eviction, placement and slow commands: rules that change results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slots import SLOTS, hash_slot
from ..plans.ordered import folded
from ..plans.staging import running

POLICIES = ("noeviction", "allkeys-lru", "volatile-lru", "allkeys-lfu", "volatile-lfu", "allkeys-random", "volatile-random", "volatile-ttl")


def scoped(key: Column, user: Column) -> Column:
    """A tenant's own name for a key; without a tenant the key itself."""
    return F.when(user.isNull(), key).otherwise(F.concat(F.lit("user_"), user, F.lit(":"), key))


def own_resources(df: DataFrame, user: str, column: str = "key") -> DataFrame:
    return df.filter(F.col(column).startswith(f"user_{user}:"))


def unscoped(key: Column) -> Column:
    return F.regexp_replace(key, r"^user_[^:]*:", "")


def storage_quota(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """user, bytes, max_bytes, fits: usage(user, bytes) against limits(user, max_bytes)."""
    total = usage.groupBy("user").agg(F.sum("bytes").alias("bytes"))
    return limits.join(total, "user", "left").select("user", F.coalesce("bytes", F.lit(0)).alias("bytes"), "max_bytes", (F.coalesce("bytes", F.lit(0)) <= F.col("max_bytes")).alias("fits"))


def operations_quota(operations: DataFrame, limits: DataFrame) -> DataFrame:
    total = operations.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    return limits.join(total, "user", "left").select("user", F.coalesce("n", F.lit(0)).alias("n"), "max_operations", (F.coalesce("n", F.lit(0)) < F.col("max_operations")).alias("fits"))


def slowlog(commands: DataFrame, threshold_us: int, count: int) -> DataFrame:
    return commands.filter(F.col("duration_us") >= threshold_us).orderBy(F.col("id").desc()).limit(count)


def evict(entries: DataFrame, policy: str, budget: int, seed: int = 0) -> DataFrame:
    """What stays of entries(key, size, last_access, freq, expires_at_ms) within ``budget`` bytes.

    The whole keyspace is the sample: the entries a policy would evict first go until
    the rest fits.  Entries are dealt out by range of the evicted order, so that no task
    orders all keys, however many tie.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if policy == "noeviction":
        return entries
    rank = {
        "lru": F.col("last_access"),
        "lfu": F.col("freq"),
        "random": F.xxhash64(F.lit(seed), "key"),
        "ttl": F.col("expires_at_ms"),
    }[policy.split("-")[1]].cast("long")
    candidate = F.col("expires_at_ms").isNotNull() if policy.startswith("volatile") else F.lit(True)
    excess = (entries.agg(F.sum("size")).first()[0] or 0) - budget
    if excess <= 0:
        return entries
    may_go = entries.filter(candidate).withColumn("__rank", rank)
    freed = running(may_go, [F.col("__rank").asc_nulls_first(), F.col("key").asc()], {"__freed": F.col("size")})
    # an entry goes if those before it have not freed enough
    stays = freed.filter(F.col("__freed") - F.col("size") >= excess).drop("__rank", "__freed")
    return stays.unionByName(entries.filter(~candidate))


def would_exceed(entries: DataFrame, more: int, budget: int) -> DataFrame:
    """bytes, exceeds: whether ``more`` bytes beside what is held would be over the budget (0: none)."""
    held = F.coalesce(F.sum("size"), F.lit(0)).cast("long")
    return entries.agg(held.alias("bytes")).withColumn("exceeds", (F.lit(budget) > 0) & (F.col("bytes") + more > budget))


def assign_slots(owned: DataFrame, node: str, first: int, last: int) -> DataFrame:
    """ranges(node, first, last) with one more; a slot that another node has raises."""
    if not 0 <= first <= last < SLOTS:
        raise ValueError(f"slots are 0 to {SLOTS - 1}")
    taken = owned.filter((F.col("node") != node) & (F.col("first") <= last) & (F.col("last") >= first)).limit(1).count()
    if taken:
        raise ValueError(f"a slot of {first} to {last} is assigned already")
    return owned.unionByName(owned.sparkSession.createDataFrame([(node, first, last)], "node string, first int, last int"))


def keys_in_slot(keys: DataFrame, slot: int) -> DataFrame:
    return keys.filter(hash_slot(F.col("key")) == slot)


def migrations(marks: DataFrame) -> DataFrame:
    """slot, from_node, to_node, state of marks(seq, slot, from_node, to_node, op), op being start or complete.

    A slot has one migration at a time: while one runs another start is refused, and a
    completion ends the start before it.
    """
    last = F.max_by(F.struct("op"), "seq")
    began = F.max(F.when(F.col("op") == "complete", F.col("seq")))
    ends = marks.groupBy("slot").agg(last.alias("w"), began.alias("__done"))
    starts = marks.filter("op = 'start'").join(ends, "slot").filter(F.col("__done").isNull() | (F.col("seq") > F.col("__done")))
    running_now = starts.groupBy("slot").agg(F.min_by(F.struct("from_node", "to_node"), "seq").alias("m"))
    done = marks.filter("op = 'complete'").select("slot").distinct().join(running_now, "slot", "left_anti")
    moved = marks.filter("op = 'start'").join(done, "slot", "left_semi").groupBy("slot").agg(F.max_by(F.struct("from_node", "to_node"), "seq").alias("m"))
    return running_now.select("slot", "m.from_node", "m.to_node", F.lit("migrating").alias("state")).unionByName(moved.select("slot", "m.from_node", "m.to_node", F.lit("complete").alias("state")))


def routed(keys: DataFrame, ranges: DataFrame, node: str, moving: DataFrame | None = None) -> DataFrame:
    """key, slot, owner, answer: what ``node`` answers a client that asks for the key.

    ``ok`` if it owns the slot; ``ask`` and the new node if it is handing the slot over;
    ``moved`` if another owns it; ``down`` if none does.
    """
    placed = slot_owner(keys.select("key", hash_slot(F.col("key")).alias("slot")), ranges)
    if moving is None:
        to = F.lit(None).cast("string")
    else:
        now = moving.filter("state = 'migrating'").select("slot", "to_node")
        placed, to = placed.join(F.broadcast(now), "slot", "left"), F.col("to_node")  # one row for each of 16384 slots at most
    own = F.col("node") == node
    answer = F.when(F.col("node").isNull(), "down").when(own & to.isNotNull(), F.concat(F.lit("ask "), to)).when(own, "ok").otherwise(F.concat(F.lit("moved "), F.col("node")))
    return placed.select("key", "slot", F.col("node").alias("owner"), answer.alias("answer"))


def allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests(id, user, resource, action) with ``allowed`` by rules(user, resource, action, allow).

    A rule names a resource, or all that begin with what stands before a last ``*``; its
    user and action may be ``*``.  The longest resource that fits decides, a denial before
    a permission of the same length; without a rule nothing is allowed.
    """
    star = F.col("rule_resource").endswith("*")
    named = rules.select(F.col("user").alias("rule_user"), F.col("resource").alias("rule_resource"), F.col("action").alias("rule_action"), "allow")
    exact = named.filter(~star).withColumn("stem", F.col("rule_resource"))
    open_ended = named.filter(star).withColumn("stem", F.expr("substr(rule_resource, 1, length(rule_resource) - 1)"))
    told = requests.select("id", "user", "resource", "action")
    # each request meets the rules filed under one of its resource's beginnings, by equality;
    # the lengths there are to try are no more than the longest name's characters
    tried = sorted(r["n"] for r in open_ended.select(F.length("stem").alias("n")).distinct().collect())
    stems = F.filter(F.array(*[F.lit(n) for n in tried]).cast("array<int>"), lambda n: n <= F.length("resource"))
    begins = told.withColumn("stem", F.explode(F.transform(stems, lambda n: F.substring(F.col("resource"), F.lit(1), n))))
    met = told.withColumn("stem", F.col("resource")).join(exact, "stem").unionByName(begins.join(open_ended, "stem"))
    fits = met.filter(F.col("rule_user").isin("*") | (F.col("rule_user") == F.col("user"))).filter(F.col("rule_action").isin("*") | (F.col("rule_action") == F.col("action")))
    best = fits.groupBy("id").agg(F.max(F.struct(F.length("rule_resource").alias("n"), (~F.col("allow")).alias("denied"))).alias("b"))
    return told.join(best, "id", "left").select("id", "user", "resource", "action", F.coalesce(~F.col("b.denied"), F.lit(False)).alias("allowed"))


def slot_owner(slots: DataFrame, ranges: DataFrame) -> DataFrame:
    """slots(slot) with the node of ranges(node, first, last) that holds them; null if none does.

    At most 16384 ranges exist, so they are spread to single slots and joined by equality.
    """
    each = ranges.select("node", F.explode(F.sequence("first", "last")).alias("slot"))
    return slots.join(F.broadcast(each), "slot", "left")


def slot_coverage(ranges: DataFrame) -> DataFrame:
    each = ranges.select(F.explode(F.sequence("first", "last")).alias("slot")).distinct()
    share = F.count(F.lit(1)) / F.lit(float(SLOTS))
    return each.agg(share.alias("coverage"), (F.count(F.lit(1)) == SLOTS).alias("full"))


def lfu_victims(accesses: DataFrame, count: int) -> DataFrame:
    """The ``count`` least used keys of accesses(key)."""
    return accesses.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).orderBy("freq", "key").limit(count)


def allowed_by_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """requests(client, ts, tokens) with ``allowed``: a token bucket for each client, refilled as time passes.

    A client's requests are read one after the other; two numbers are all that is held of them.
    """

    def step(bucket: dict, row: dict) -> list[tuple]:
        at = row["micros"] / 1e6
        left = burst if bucket["last"] is None else min(burst, bucket["left"] + (at - bucket["last"]) * rate)
        fits = left >= row["tokens"]
        bucket.update(last=at, left=left - row["tokens"] if fits else left)
        return [(row["client"], row["micros"], row["tokens"], fits)]

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    named = requests.select("client", micros.alias("micros"), F.col("tokens").cast("double").alias("tokens"))
    told = folded(named, "client", lambda: {"last": None, "left": burst}, step, lambda bucket, client: [], "client string, micros long, tokens double, allowed boolean", "micros")
    return told.select("client", F.timestamp_micros("micros").alias("ts"), "tokens", "allowed")
