"""Registered queries: each operator on whole tables, and the SQL that gives the same rows.

Binary members are shown as text, doubles rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, topics
from ..operators import bitmaps, geosets, governance, hashes, hll, keyspace, lists, sets, strings, zsets
from ..sources import keyspaces as ks
from ..streaming import groups, pubsub, queues, rooms, rx
from . import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = ks.NOW_MS

# Views of the oracle's side, each a CTE that queries name in their FROM.
VIEWS = {
    "kv": f"SELECT 'customer:' || c_custkey AS key, c_name AS value, CASE WHEN c_custkey % 3 = 0 THEN {NOW} - 500000 + c_custkey * 1700 END AS expires_at_ms FROM customer",
    "live": f"SELECT * FROM kv WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW}",
    "deltas": "SELECT 'counter:' || o_custkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS num, o_orderkey AS seq FROM orders",
    "hash": "SELECT 'part:' || p_partkey AS key, unnest(['brand', 'type', 'size']) AS field, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part",
    "list": "SELECT 'user:' || user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS value FROM events",
    "set_": "SELECT DISTINCT event_type AS key, CAST(user_id AS VARCHAR) AS member FROM events",
    "zset": "SELECT n_name AS key, c_name AS member, c_acctbal AS score FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "scores": "SELECT event_type AS key, CAST(user_id AS VARCHAR) AS member, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY ALL",
    "bitmap": "SELECT DISTINCT event_type AS key, user_id AS \"offset\" FROM events",
    "places": "SELECT c_name AS member, (c_custkey * 37 % 1700) / 10.0 - 85 AS lat, (c_custkey * 91 % 3600) / 10.0 - 180 AS lon FROM customer",
    "packed": "SELECT member, (CAST(floor((lat + 90.0) * 67108864 / 180.0 + 0.5) AS BIGINT) << 26) | CAST(floor((lon + 180.0) * 67108864 / 360.0 + 0.5) AS BIGINT) AS bits FROM places",
    "geo": "SELECT member, (bits >> 26) * 180.0 / 67108864 - 90.0 AS lat, (bits & 67108863) * 360.0 / 67108864 - 180.0 AS lon FROM packed",
    "room": "SELECT event_type AS room, event_id, ts, props AS data, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS \"offset\" FROM events",
    "topic": "SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY ts, event_id) - 1 AS \"offset\" FROM (SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, event_type AS event, props AS data, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 8 AS INT) AS partition_id, strlen(props) + strlen(CAST(user_id AS VARCHAR)) + 6 + strlen(event_type) AS size_bytes FROM events)",
    "message": "SELECT event_id AS id, 'events.' || event_type || '.user' || user_id AS topic FROM events",
}
_NEEDS = {"live": ["kv"], "packed": ["places"], "geo": ["places", "packed"]}


def _with(sql: str) -> str:
    """The SQL with the views it names."""
    import re

    used: list[str] = []
    for name in VIEWS:
        if re.search(rf"(?i)\b(?:from|join)\s+{name}\b", sql):
            used += [n for n in [*_NEEDS.get(name, []), name] if n not in used]
    if not used:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    return f"WITH {ctes} {sql}" if not sql.lstrip().upper().startswith("WITH") else f"WITH {ctes}, {sql.lstrip()[5:]}"


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _with(sql)
        return f

    return register


def text(name: str, alias: str | None = None):
    return F.col(name).cast("string").alias(alias or name)


# strings -----------------------------------------------------------------------------

@query("SELECT key, value FROM live WHERE key = 'customer:7'")
def kv_get(s, d):
    return strings.get(ks.kv(s, d), "customer:7", NOW).select("key", text("value"))


@query("SELECT r.i AS pos, r.key, value FROM (SELECT unnest(['customer:5', 'nobody', 'customer:3', 'customer:5']) AS key, unnest([0, 1, 2, 3]) AS i) r LEFT JOIN live ON r.key = live.key")
def kv_mget(s, d):
    return strings.mget(ks.kv(s, d), ["customer:5", "nobody", "customer:3", "customer:5"], NOW).select("pos", "key", text("value"))


@query("SELECT DISTINCT key FROM deltas d JOIN (SELECT replace(key, 'customer', 'counter') AS key FROM live) USING (key)")
def kv_exists(s, d):
    asked = ks.counter_deltas(s, d).select(F.regexp_replace("key", "counter", "customer").alias("key")).distinct()
    return strings.exists(ks.kv(s, d), asked, NOW).select(F.regexp_replace("key", "customer", "counter").alias("key"))


@query("SELECT key FROM live WHERE starts_with(key, 'customer:1') ORDER BY key LIMIT 50")
def kv_scan(s, d):
    return strings.scan(ks.kv(s, d), NOW, prefix="customer:1", limit=50)


@query("SELECT key FROM live WHERE regexp_matches(key, '^customer:[1-3].5$')")
def kv_keys_glob(s, d):
    return strings.keys(ks.kv(s, d), NOW, "customer:[1-3]?5")


@query("SELECT count(*) AS n FROM live")
def kv_dbsize(s, d):
    return strings.dbsize(ks.kv(s, d), NOW)


@query("SELECT count(*) AS total_keys, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS total_bytes, count(expires_at_ms) AS volatile_keys FROM live")
def kv_stats(s, d):
    return strings.stats(ks.kv(s, d), NOW)


@query("SELECT key, CAST(strlen(value) AS BIGINT) AS length FROM live")
def kv_strlen(s, d):
    return strings.strlen(ks.kv(s, d), NOW)


@query("SELECT key, substr(value, 4, 5) AS middle, right(value, 4) AS tail FROM live")
def kv_getrange(s, d):
    return strings.live(ks.kv(s, d), NOW).select("key", strings.get_range(F.col("value"), 3, 7).cast("string").alias("middle"), strings.get_range(F.col("value"), -4, -1).cast("string").alias("tail"))


@query("SELECT key, substr(value, 1, 2) || 'XY' || substr(value, 5) AS value, value || '!' AS appended FROM live")
def kv_setrange_append(s, d):
    live = strings.live(ks.kv(s, d), NOW)
    return live.select("key", strings.set_range(F.col("value"), 2, b"XY").cast("string").alias("value"), strings.append(F.col("value"), b"!").cast("string").alias("appended"))


@query(f"SELECT key, CASE WHEN expires_at_ms IS NOT NULL THEN greatest(0, CAST(floor((expires_at_ms - {NOW}) / 1000.0) AS BIGINT)) END AS ttl, CASE WHEN expires_at_ms IS NOT NULL THEN greatest(0, expires_at_ms - {NOW}) END AS pttl FROM kv")
def kv_ttl(s, d):
    return strings.ttl(ks.kv(s, d), NOW)


@query(f"SELECT key, value, CASE WHEN key IN ('customer:1', 'customer:2') THEN {NOW} + 60000 ELSE expires_at_ms END AS expires_at_ms FROM live")
def kv_expire(s, d):
    return strings.expire(ks.kv(s, d), ["customer:1", "customer:2"], 60, NOW).select("key", text("value"), "expires_at_ms")


@query("SELECT key, value, CASE WHEN key <> 'customer:600' THEN expires_at_ms END AS expires_at_ms FROM live")
def kv_persist(s, d):
    return strings.persist(ks.kv(s, d), ["customer:600"], NOW).select("key", text("value"), "expires_at_ms")


@query("SELECT key, CAST(sum(num) AS BIGINT) AS counter FROM deltas GROUP BY key")
def kv_incrby(s, d):
    return strings.incremented(ks.counter_deltas(s, d))


@query("SELECT key, CAST(-sum(num) AS BIGINT) AS counter FROM deltas GROUP BY key")
def kv_decrby(s, d):
    return strings.decremented(ks.counter_deltas(s, d))


@query("SELECT key, max_by(num, seq) AS value FROM deltas GROUP BY key")
def kv_set_latest(s, d):
    writes = ks.counter_deltas(s, d).select("key", F.col("num").alias("value"), F.lit(None).cast("long").alias("expires_at_ms"), "seq")
    return strings.set_latest(writes).select("key", "value")


@query("SELECT key, seq, num AS value, lag(num) OVER (PARTITION BY key ORDER BY seq) AS old FROM deltas")
def kv_getset(s, d):
    return strings.get_set(ks.counter_deltas(s, d).select("key", "seq", F.col("num").alias("value")))


@query("SELECT key, value FROM live UNION ALL SELECT 'new:' || r_regionkey, r_name FROM region")
def kv_msetnx(s, d):
    pairs = ks.table(s, d, "region").select(F.concat(F.lit("new:"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").cast("binary").alias("value"))
    return strings.mset_nx(ks.kv(s, d), pairs, NOW).select("key", text("value"))


@query("SELECT key, value FROM live WHERE key NOT IN ('customer:1', 'customer:10')")
def kv_del(s, d):
    return strings.delete(ks.kv(s, d), ["customer:1", "customer:10"], NOW).select("key", text("value"))


# hashes ------------------------------------------------------------------------------

@query("SELECT key, value FROM hash WHERE field = 'brand'")
def hash_hget(s, d):
    return hashes.hget(ks.hashes(s, d), "brand").select("key", text("value"))


@query("SELECT key, max(value) FILTER (field = 'brand') AS brand, max(value) FILTER (field = 'size') AS size, CAST(NULL AS VARCHAR) AS colour FROM hash GROUP BY key")
def hash_hmget(s, d):
    got = hashes.hmget(ks.hashes(s, d), ["brand", "size", "colour"])
    return got.select("key", text("brand"), text("size"), text("colour"))


@query("SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM hash GROUP BY key")
def hash_hgetall(s, d):
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return hashes.nested(ks.hashes(s, d)).select("key", F.array_join(F.sort_array(pairs), ",").alias("fields"))


@query("SELECT key, count(*) AS n_fields, bool_or(field = 'type') AS found FROM hash GROUP BY key")
def hash_hlen_hexists(s, d):
    h = ks.hashes(s, d)
    return hashes.hlen(h).join(hashes.hexists(h, "type"), "key")


@query("SELECT key, field, CASE WHEN field = 'size' THEN value || '0' ELSE value END AS value FROM hash UNION ALL SELECT DISTINCT key, 'extra', 'x' FROM hash")
def hash_hset(s, d):
    h = ks.hashes(s, d)
    sized = h.filter("field = 'size'").select("key", "field", F.concat("value", F.lit(b"0")).alias("value"), F.lit(1).alias("seq"))
    extra = h.select("key", F.lit("extra").alias("field"), F.lit(b"x").alias("value"), F.lit(2).alias("seq")).distinct()
    return hashes.hset(h, sized.unionByName(extra)).select("key", "field", text("value"))


@query("SELECT key, field, value FROM hash UNION ALL SELECT DISTINCT key, 'extra', 'x' FROM hash")
def hash_hsetnx(s, d):
    h = ks.hashes(s, d)
    new = h.select("key", F.explode(F.array(F.lit("brand"), F.lit("extra"))).alias("field"), F.lit(b"x").alias("value"), F.lit(1).alias("seq")).distinct()
    return hashes.hsetnx(h, new).select("key", "field", text("value"))


@query("SELECT key, field, value FROM hash WHERE field <> 'type'")
def hash_hdel(s, d):
    return hashes.hdel(ks.hashes(s, d), ["type"]).select("key", "field", text("value"))


@query("SELECT 'part:' || p_partkey AS key, 'size' AS field, CAST(p_size + 5 AS BIGINT) AS value FROM part")
def hash_hincrby(s, d):
    h = ks.hashes(s, d)
    return hashes.hincrby(h, h.filter("field = 'size'").select("key", "field", F.lit(5).alias("num")))


@query("SELECT 'part:' || p_partkey AS key, 'size' AS field, p_size + CAST(0.5 AS DOUBLE) AS value FROM part")
def hash_hincrbyfloat(s, d):
    h = ks.hashes(s, d)
    return hashes.hincrbyfloat(h, h.filter("field = 'size'").select("key", "field", F.lit(0.5).alias("num")))


@query("SELECT key, field, value, CAST(2 AS BIGINT) AS next_cursor FROM hash WHERE field = 'brand'")
def hash_hscan(s, d):
    return hashes.hscan(ks.hashes(s, d), 0, 2, "b*").select("key", "field", text("value"), "next_cursor")


@query("SELECT count(DISTINCT key) AS total_hashes, count(*) AS total_fields, CAST(sum(strlen(field) + strlen(value)) AS BIGINT) AS total_bytes FROM hash")
def hash_stats(s, d):
    return hashes.stats(ks.hashes(s, d))


# lists -------------------------------------------------------------------------------

@query("SELECT key, count(*) AS length FROM list GROUP BY key")
def list_llen(s, d):
    return lists.llen(ks.lists(s, d))


@query("SELECT key, idx, value FROM list WHERE idx BETWEEN 2 AND 5")
def list_lrange(s, d):
    return lists.lrange(ks.lists(s, d), 2, 5).select("key", "idx", text("value"))


@query("SELECT key, idx, value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM list) WHERE idx BETWEEN n - 4 AND n - 2")
def list_lrange_negative(s, d):
    return lists.lrange(ks.lists(s, d), -4, -2).select("key", "idx", text("value"))


@query("SELECT key, max_by(value, idx) AS last, max(value) FILTER (idx = 1) AS second FROM list GROUP BY key HAVING count(*) > 1")
def list_lindex(s, d):
    li = ks.lists(s, d)
    return lists.lindex(li, -1).select("key", text("value", "last")).join(lists.lindex(li, 1).select("key", text("value", "second")), "key")


@query("SELECT key, min(idx) AS pos FROM list WHERE value = 'purchase' GROUP BY key")
def list_lpos(s, d):
    return lists.lpos(ks.lists(s, d), "purchase")


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM list WHERE idx BETWEEN 1 AND 10")
def list_ltrim(s, d):
    return lists.ltrim(ks.lists(s, d), 1, 10).select("key", "idx", text("value"))


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM (SELECT key, idx, value FROM list UNION ALL SELECT DISTINCT key, -2, 'b' FROM list UNION ALL SELECT DISTINCT key, -1, 'a' FROM list)")
def list_lpush(s, d):
    li = ks.lists(s, d)
    new = li.select("key").distinct().select("key", F.inline(F.array(F.struct(F.lit(b"a").alias("value"), F.lit(1).alias("seq")), F.struct(F.lit(b"b").alias("value"), F.lit(2).alias("seq")))))
    return lists.push(li, new, left=True).select("key", "idx", text("value"))


@query("SELECT key, idx, value FROM list UNION ALL SELECT key, count(*), 'z' FROM list GROUP BY key")
def list_rpushx(s, d):
    li = ks.lists(s, d)
    new = li.select("key").distinct().unionByName(s.createDataFrame([("absent",)], "key string")).select("key", F.lit(b"z").alias("value"), F.lit(1).alias("seq"))
    return lists.push(li, new, only_existing=True).select("key", "idx", text("value"))


@query("SELECT key, n - 1 - idx AS at, value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM list) WHERE idx >= n - 3")
def list_rpop(s, d):
    return lists.pop(ks.lists(s, d), 3, right=True)[0].select("key", "at", text("value"))


@query("SELECT key, idx - 2 AS idx, value FROM list WHERE idx >= 2")
def list_lpop_rest(s, d):
    return lists.pop(ks.lists(s, d), 2)[1].select("key", "idx", text("value"))


@query("SELECT key, idx, CASE WHEN idx = n - 1 THEN 'end' ELSE value END AS value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM list)")
def list_lset(s, d):
    return lists.lset(ks.lists(s, d), -1, b"end").select("key", "idx", text("value"))


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY idx DESC) AS nth FROM list) WHERE value <> 'view' OR nth > 2")
def list_lrem(s, d):
    return lists.lrem(ks.lists(s, d), -2, b"view")[1].select("key", "idx", text("value"))


@query("SELECT key, count(*) FILTER (value = 'error') AS removed FROM list GROUP BY key")
def list_lrem_all(s, d):
    return lists.lrem(ks.lists(s, d), 0, b"error")[0]


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS idx, value FROM (SELECT key, CAST(idx AS DOUBLE) AS place, value FROM list UNION ALL SELECT key, min(idx) - 0.5, 'new' FROM list WHERE value = 'signup' GROUP BY key)")
def list_linsert(s, d):
    return lists.linsert(ks.lists(s, d), b"signup", b"new").select("key", "idx", text("value"))


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM (SELECT key, idx, value FROM list WHERE NOT (key = 'user:1' AND idx = (SELECT max(idx) FROM list WHERE key = 'user:1')) UNION ALL SELECT 'user:2', -1, max_by(value, idx) FROM list WHERE key = 'user:1')")
def list_rpoplpush(s, d):
    return lists.rpoplpush(ks.lists(s, d), "user:1", "user:2").select("key", "idx", text("value"))


@query("SELECT key, value FROM list WHERE key = 'user:4' AND idx = 0")
def list_blpop(s, d):
    return lists.bpop(ks.lists(s, d), ["absent", "user:4", "user:3"]).select("key", text("value"))


# sets --------------------------------------------------------------------------------

@query("SELECT member FROM set_ WHERE key = 'click' INTERSECT SELECT member FROM set_ WHERE key = 'purchase' INTERSECT SELECT member FROM set_ WHERE key = 'signup'")
def set_sinter(s, d):
    return sets.sinter(ks.sets(s, d), ["click", "purchase", "signup"]).select(text("member"))


@query("SELECT member FROM set_ WHERE key = 'click' UNION SELECT member FROM set_ WHERE key = 'error'")
def set_sunion(s, d):
    return sets.sunion(ks.sets(s, d), ["click", "error", "absent"]).select(text("member"))


@query("SELECT key, member FROM set_ UNION ALL SELECT 'both', member FROM (SELECT member FROM set_ WHERE key = 'click' INTERSECT SELECT member FROM set_ WHERE key = 'error')")
def set_sinterstore(s, d):
    st = ks.sets(s, d)
    return sets.stored(st, "both", sets.sinter(st, ["click", "error"])).select("key", text("member"))


@query("SELECT key, count(*) AS size, bool_or(member = '7') AS found FROM set_ GROUP BY key")
def set_scard_sismember(s, d):
    st = ks.sets(s, d)
    return sets.scard(st).join(sets.sismember(st, b"7"), "key")


@query("SELECT key, count(*) FILTER (NOT EXISTS (SELECT 1 FROM set_ o WHERE o.key = n.key AND o.member = n.member)) AS added FROM (SELECT DISTINCT 'error' AS key, CAST(user_id % 200 AS VARCHAR) AS member FROM events) n GROUP BY key")
def set_sadd(s, d):
    new = ks.table(s, d, "events").select(F.lit("error").alias("key"), (F.col("user_id") % 200).cast("string").cast("binary").alias("member"))
    return sets.sadd(ks.sets(s, d), new)[0]


@query("SELECT key, member FROM set_ WHERE NOT (key = 'view' AND length(member) = 1)")
def set_srem(s, d):
    st = ks.sets(s, d)
    return sets.srem(st, st.filter((F.col("key") == "view") & (F.octet_length("member") == 1)))[1].select("key", text("member"))


@query("SELECT DISTINCT CASE WHEN key = 'view' AND member = '5' THEN 'seen' ELSE key END AS key, member FROM set_")
def set_smove(s, d):
    return sets.smove(ks.sets(s, d), "view", "seen", b"5").select("key", text("member"))


@query("SELECT key, member FROM set_ QUALIFY row_number() OVER (PARTITION BY key ORDER BY member) <= 3")
def set_spop(s, d):
    return sets.spop(ks.sets(s, d), 3)[0].select("key", text("member"))


@query("SELECT key, member FROM set_ QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('9:' || member), member) <= 4")
def set_srandmember(s, d):
    return sets.srandmember(ks.sets(s, d), 4, seed=9).select("key", text("member"))


@query("SELECT key, member, CAST(CASE WHEN n > 20 THEN 20 ELSE 0 END AS BIGINT) AS next_cursor FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r, count(*) OVER (PARTITION BY key) AS n FROM set_) WHERE r BETWEEN 11 AND 20 AND starts_with(member, '1')")
def set_sscan(s, d):
    return sets.sscan(ks.sets(s, d), 10, 10, "1*").select("key", text("member"), "next_cursor")


# sorted sets -------------------------------------------------------------------------

@query("SELECT key, member, score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS r FROM zset) WHERE r < 10")
def zset_top(s, d):
    return zsets.top(ks.zsets(s, d), 10).select("key", text("member"), "score", "rank")


@query("SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zset")
def zset_zrank(s, d):
    return zsets.zrank(ks.zsets(s, d)).select("key", text("member"), "score", "rank")


@query("SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zset")
def zset_zrevrank(s, d):
    return zsets.zrevrank(ks.zsets(s, d)).select("key", text("member"), "score", "rank")


@query("SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM zset) WHERE r BETWEEN 1 AND n - 3")
def zset_zrange(s, d):
    return zsets.zrange(ks.zsets(s, d), 1, -3).select("key", text("member"), "score")


@query("SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS r FROM zset) WHERE r BETWEEN 2 AND 6")
def zset_zrevrange(s, d):
    return zsets.zrevrange(ks.zsets(s, d), 2, 6).select("key", text("member"), "score")


@query("SELECT key, member, score FROM zset WHERE score BETWEEN 1000 AND 2500")
def zset_zrangebyscore(s, d):
    return zsets.zrangebyscore(ks.zsets(s, d), 1000, 2500).select("key", text("member"), "score")


@query("SELECT key, count(*) FILTER (score BETWEEN 0 AND 5000) AS n, count(*) AS size FROM zset GROUP BY key HAVING n > 0")
def zset_zcount_zcard(s, d):
    z = ks.zsets(s, d)
    return zsets.zcount(z, 0, 5000).join(zsets.zcard(z), "key")


@query("SELECT r.i AS pos, r.m AS member, score FROM (SELECT unnest(['1', 'zz', '3']) AS m, unnest([0, 1, 2]) AS i) r LEFT JOIN (SELECT member, score FROM scores WHERE key = 'click') ON member = r.m")
def zset_zmscore(s, d):
    return zsets.zmscore(ks.user_scores(s, d), "click", [b"1", b"zz", b"3"]).select("pos", text("member"), "score")


@query("SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM scores QUALIFY rank < 2")
def zset_zpopmin(s, d):
    return zsets.zpopmin(ks.user_scores(s, d), 2)[0].select("key", text("member"), "score", "rank")


@query("SELECT key, member, score FROM scores QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) > 2")
def zset_zpopmax_rest(s, d):
    return zsets.zpopmax(ks.user_scores(s, d), 2)[1].select("key", text("member"), "score")


@query("SELECT key, member, score FROM scores WHERE key = 'error' ORDER BY score DESC, member DESC LIMIT 1")
def zset_bzpopmax(s, d):
    return zsets.bzpop(ks.user_scores(s, d), ["absent", "error", "click"], largest=True).select("key", text("member"), "score")


@query("SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM zset) WHERE NOT r BETWEEN n - 5 AND n - 1")
def zset_zremrangebyrank(s, d):
    return zsets.zremrangebyrank(ks.zsets(s, d), -5, -1).select("key", text("member"), "score")


@query("SELECT key, member, score FROM zset WHERE NOT score BETWEEN -100 AND 9000")
def zset_zremrangebyscore(s, d):
    return zsets.zremrangebyscore(ks.zsets(s, d), -100, 9000).select("key", text("member"), "score")


@query("SELECT key, member, score + 1.5 AS score FROM scores UNION ALL SELECT DISTINCT key, 'fresh', CAST(1.5 AS DOUBLE) FROM scores")
def zset_zincrby(s, d):
    z = ks.user_scores(s, d)
    deltas = z.select("key", "member").unionByName(z.select("key", F.lit(b"fresh").alias("member")).distinct()).withColumn("num", F.lit(1.5))
    return zsets.zincrby(z, deltas).select("key", text("member"), "score")


@query("SELECT key, member, CASE WHEN key = 'click' AND 20 > score THEN 20 ELSE score END AS score, false AS added, key = 'click' AND 20 > score AS changed FROM scores UNION ALL SELECT 'click', 'fresh', 20, true, true")
def zset_zadd_gt(s, d):
    z = ks.user_scores(s, d)
    new = z.filter("key = 'click'").select("key", "member").unionByName(s.createDataFrame([("click", b"fresh")], "key string, member binary")).withColumn("score", F.lit(20.0))
    return zsets.zadd(z, new, gt=True).select("key", text("member"), "score", "added", "changed")


@query("SELECT member, 2 * a.score + 3 * b.score AS score FROM (SELECT * FROM scores WHERE key = 'click') a JOIN (SELECT * FROM scores WHERE key = 'error') b USING (member)")
def zset_zinterstore_sum(s, d):
    return zsets.zinter(ks.user_scores(s, d), ["click", "error"], [2, 3]).select(text("member"), "score")


@query("SELECT member, min(score) AS score FROM scores WHERE key IN ('click', 'error', 'view') GROUP BY member HAVING count(*) = 3")
def zset_zinterstore_min(s, d):
    return zsets.zinter(ks.user_scores(s, d), ["click", "error", "view"], aggregate="MIN").select(text("member"), "score")


@query("SELECT member, max(score * CASE key WHEN 'click' THEN 1 ELSE 0.5 END) AS score FROM scores WHERE key IN ('click', 'purchase') GROUP BY member")
def zset_zunionstore_max(s, d):
    return zsets.zunion(ks.user_scores(s, d), ["click", "purchase"], [1, 0.5], "MAX").select(text("member"), "score")


@query("SELECT key, member, score FROM zset WHERE key <> 'rest' UNION ALL SELECT 'rest', member, score FROM scores WHERE key = 'view' AND member NOT IN (SELECT member FROM scores WHERE key = 'signup')")
def zset_zdiffstore(s, d):
    return zsets.stored(ks.zsets(s, d), "rest", zsets.zdiff(ks.user_scores(s, d), ["view", "signup"])).select("key", text("member"), "score")


@query("SELECT key, member, score, CAST(CASE WHEN n > 12 THEN 12 ELSE 0 END AS BIGINT) AS next_cursor FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r, count(*) OVER (PARTITION BY key) AS n FROM zset) WHERE r BETWEEN 5 AND 12")
def zset_zscan(s, d):
    return zsets.zscan(ks.zsets(s, d), 4, 8).select("key", text("member"), "score", "next_cursor")


@query("SELECT count(*) AS total_keys, CAST(sum(n) AS BIGINT) AS total_members, avg(n) AS avg_members FROM (SELECT count(*) AS n FROM zset GROUP BY key)")
def zset_stats(s, d):
    return zsets.stats(ks.zsets(s, d))


# bitmaps -----------------------------------------------------------------------------

@query('SELECT key, count(*) AS bits FROM bitmap GROUP BY key')
def bitmap_bitcount(s, d):
    return bitmaps.bitcount(ks.bitmaps(s, d))


@query('SELECT key, count(*) FILTER ("offset" BETWEEN 10 AND 60) AS bits FROM bitmap GROUP BY key')
def bitmap_bitcount_range(s, d):
    return bitmaps.bitcount(ks.bitmaps(s, d), 10, 60)


@query('SELECT key, count(*) AS bits FROM bitmap GROUP BY key')
def bitmap_dense_count(s, d):
    return bitmaps.dense_count(bitmaps.dense(ks.bitmaps(s, d)))


@query('SELECT "offset" FROM bitmap WHERE key IN (\'click\', \'error\') GROUP BY 1 HAVING count(*) = 2')
def bitmap_bitop_and(s, d):
    return bitmaps.bitop(ks.bitmaps(s, d), "AND", ["click", "error"])


@query('SELECT DISTINCT "offset" FROM bitmap WHERE key IN (\'click\', \'error\')')
def bitmap_bitop_or(s, d):
    return bitmaps.bitop(ks.bitmaps(s, d), "OR", ["click", "error"])


@query('SELECT "offset" FROM bitmap WHERE key IN (\'click\', \'error\', \'view\') GROUP BY 1 HAVING count(*) % 2 = 1')
def bitmap_bitop_xor(s, d):
    return bitmaps.bitop(ks.bitmaps(s, d), "XOR", ["click", "error", "view"])


@query('SELECT i AS "offset" FROM range((SELECT CAST(floor(max("offset") / 8) + 1 AS BIGINT) * 8 FROM bitmap WHERE key = \'signup\')) t(i) WHERE i NOT IN (SELECT "offset" FROM bitmap WHERE key = \'signup\')')
def bitmap_bitop_not(s, d):
    return bitmaps.bitop(ks.bitmaps(s, d), "NOT", ["signup"])


@query('SELECT k.key, (SELECT min(i) FROM range((SELECT CAST(floor(max("offset") / 8) + 1 AS BIGINT) * 8 FROM bitmap b WHERE b.key = k.key)) t(i) WHERE i >= 3 AND NOT EXISTS (SELECT 1 FROM bitmap c WHERE c.key = k.key AND c."offset" = i)) AS pos FROM (SELECT DISTINCT key FROM bitmap) k')
def bitmap_bitpos_clear(s, d):
    return bitmaps.bitpos(ks.bitmaps(s, d), 0, 3)


@query('SELECT key, min("offset") FILTER ("offset" >= 20) AS pos FROM bitmap GROUP BY key')
def bitmap_bitpos_set(s, d):
    return bitmaps.bitpos(ks.bitmaps(s, d), 1, 20)


@query('SELECT key, CAST(max(CASE WHEN "offset" = 42 THEN 1 ELSE 0 END) AS INT) AS bit, CAST(floor(max("offset") / 8) + 1 AS BIGINT) AS bytes FROM bitmap GROUP BY key')
def bitmap_getbit_length(s, d):
    b = ks.bitmaps(s, d)
    return bitmaps.getbit(b, 42).join(bitmaps.byte_length(b), "key")


@query('SELECT key, "offset" FROM bitmap WHERE "offset" % 10 <> 0 UNION ALL SELECT DISTINCT key, 100000 FROM bitmap')
def bitmap_setbit(s, d):
    b = ks.bitmaps(s, d)
    writes = b.filter("offset % 10 = 0").select("key", "offset", F.lit(0).alias("bit"), F.lit(1).alias("seq"))
    writes = writes.unionByName(b.select("key", F.lit(100000).cast("long").alias("offset"), F.lit(1).alias("bit"), F.lit(2).alias("seq")).distinct())
    return bitmaps.setbit(b, writes)


# distinct counts ---------------------------------------------------------------------

@query("SELECT event_type AS key, count(DISTINCT user_id) AS n, true AS near FROM events GROUP BY 1")
def hll_pfcount(s, d):
    e = ks.elements(s, d)
    exact = e.groupBy("key").agg(F.countDistinct("element").alias("n"))
    return hll.pfcount(hll.pfadd(e)).join(exact, "key").select("key", "n", (F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1), 0.05 * F.col("n"))).alias("near"))


@query("SELECT count(DISTINCT l_orderkey) AS n, true AS near FROM lineitem")
def hll_pfmerge(s, d):
    lines = ks.table(s, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_orderkey").alias("element"))
    merged = hll.pfmerge(hll.pfadd(lines), "all", ["A", "N", "R"]).filter("key = 'all'")
    exact = lines.agg(F.countDistinct("element").alias("n"))
    return hll.pfcount(merged).crossJoin(exact).select("n", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("near"))


# geo ---------------------------------------------------------------------------------

_DIST = "2 * asin(sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({d}) - radians({c})) / 2), 2)))"


@query("SELECT member, CAST(bits AS DOUBLE) AS score FROM packed")
def geo_geoadd(s, d):
    return geosets.geoadd(ks.places(s, d)).select(text("member"), "score")


@query("SELECT member, round(lat, 6) AS lat, round(lon, 6) AS lon FROM geo")
def geo_geopos(s, d):
    at = geosets.located(geosets.geoadd(ks.places(s, d)))
    return at.select(text("member"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"SELECT member, round({_DIST.format(a='48.85', b='lat', c='2.35', d='lon')} * 6371.0, 3) AS distance FROM geo WHERE {_DIST.format(a='48.85', b='lat', c='2.35', d='lon')} * 6371000.0 <= 2500 * 1000.0")
def geo_georadius(s, d):
    found = geosets.georadius(geosets.geoadd(ks.places(s, d)), 48.85, 2.35, 2500, "km")
    return found.select(text("member"), F.round("distance", 3).alias("distance"))


@query(f"SELECT member, round({_DIST.format(a='10', b='lat', c='20', d='lon')} * 6371000.0, 1) AS distance FROM geo ORDER BY {_DIST.format(a='10', b='lat', c='20', d='lon')}, member LIMIT 10")
def geo_nearest(s, d):
    found = geosets.georadius(geosets.geoadd(ks.places(s, d)), 10.0, 20.0, 20_100_000, "m", count=10)
    return found.select(text("member"), F.round("distance", 1).alias("distance"))


@query(f"SELECT g.member, round({_DIST.format(a='c.lat', b='g.lat', c='c.lon', d='g.lon')} * 3959.0, 3) AS distance FROM geo g, (SELECT lat, lon FROM geo WHERE member = (SELECT c_name FROM customer WHERE c_custkey = 7)) c WHERE {_DIST.format(a='c.lat', b='g.lat', c='c.lon', d='g.lon')} * 6371000.0 <= 1500 * 1609.34")
def geo_georadiusbymember(s, d):
    name = ks.table(s, d, "customer").filter("c_custkey = 7").select("c_name").first()[0]
    found = geosets.georadiusbymember(geosets.geoadd(ks.places(s, d)), "customers", name.encode(), 1500, "mi")
    return found.select(text("member"), F.round("distance", 3).alias("distance"))


@query("SELECT member FROM geo WHERE lat BETWEEN 40 - 1500 * 1000.0 / 2 / 111000 AND 40 + 1500 * 1000.0 / 2 / 111000 AND lon BETWEEN -3 - 3000 * 1000.0 / 2 / (111000 * cos(radians(40))) AND -3 + 3000 * 1000.0 / 2 / (111000 * cos(radians(40)))")
def geo_geosearch_box(s, d):
    return geosets.geosearch_box(geosets.geoadd(ks.places(s, d)), 40.0, -3.0, 3000, 1500, "km").select(text("member"))


@query(f"SELECT a.member AS member1, b.member AS member2, round({_DIST.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} * 6371.0, 3) AS distance FROM geo a JOIN (SELECT c_name, lead(c_name) OVER (ORDER BY c_custkey) AS following FROM customer) ON a.member = c_name JOIN geo b ON b.member = following")
def geo_geodist(s, d):
    c = ks.table(s, d, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("name"))
    # the next customer is found by its key, not by ordering all of them
    following = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("name").alias("member2"))
    pairs = c.join(following, "c_custkey").select(F.lit("customers").alias("key"), F.col("name").alias("member1"), "member2")
    return geosets.geodist(geosets.geoadd(ks.places(s, d)), pairs, "km").select(text("member1"), text("member2"), F.round("distance", 3).alias("distance"))


_BITS = " || ".join(
    f"substr('{geo.BASE32}', CAST(1 + "
    + " + ".join(
        f"((CAST({'floor((lon + 180.0) / 360.0 * 268435456.0)' if (5 * c + b) % 2 == 0 else 'floor((lat + 90.0) / 180.0 * 134217728.0)'} AS BIGINT) >> {(28 if (5 * c + b) % 2 == 0 else 27) - 1 - (5 * c + b) // 2}) & 1) * {1 << (4 - b)}"
        for b in range(5)
    )
    + " AS INT), 1)"
    for c in range(11)
)


@query(f"SELECT member, {_BITS} AS geohash FROM geo")
def geo_geohash(s, d):
    return geosets.geohash(geosets.geoadd(ks.places(s, d))).select(text("member"), "geohash")


# keys of any type --------------------------------------------------------------------

def _stores(s, d):
    return {"zset": ks.user_scores(s, d), "set": ks.sets(s, d), "list": ks.lists(s, d), "hash": ks.hashes(s, d), "string": ks.kv(s, d)}


@query("SELECT key, 'zset' AS type FROM (SELECT DISTINCT key FROM scores) UNION ALL SELECT DISTINCT key, 'list' FROM list UNION ALL SELECT DISTINCT key, 'hash' FROM hash UNION ALL SELECT key, 'string' FROM kv")
def key_type(s, d):
    return keyspace.all_keys(_stores(s, d))


@query("SELECT CASE WHEN key = 'click' THEN 'clicks' ELSE key END AS key, member FROM set_ WHERE key <> 'clicks'")
def key_rename(s, d):
    return keyspace.rename(ks.sets(s, d), "click", "clicks").select("key", text("member"))


@query("SELECT key, member FROM set_")
def key_renamenx(s, d):
    return keyspace.rename(ks.sets(s, d), "click", "error", only_new=True).select("key", text("member"))


@query("SELECT key, member FROM set_ WHERE key <> 'error' UNION ALL SELECT 'error', member FROM set_ WHERE key = 'click'")
def key_copy(s, d):
    return keyspace.copy(ks.sets(s, d), "click", "error", replace=True).select("key", text("member"))


@query("SELECT key FROM (SELECT DISTINCT key FROM scores UNION SELECT key FROM list UNION SELECT key FROM hash UNION SELECT key FROM kv) ORDER BY md5('3:' || key), key LIMIT 1")
def key_randomkey(s, d):
    return keyspace.random_key(_stores(s, d), 3)


@query("SELECT key, 'hash' AS type, CAST(sum(strlen(field) + strlen(value)) + strlen(key) AS BIGINT) AS bytes FROM hash GROUP BY key UNION ALL SELECT key, 'set', CAST(sum(strlen(member)) + strlen(key) AS BIGINT) FROM set_ GROUP BY key")
def key_memory_usage(s, d):
    return keyspace.memory_usage({"hash": ks.hashes(s, d), "set": ks.sets(s, d)})


# logs and topics ---------------------------------------------------------------------

@query('SELECT room, event_id, "offset" FROM room')
def room_offsets(s, d):
    return ks.room_events(s, d).select("room", "event_id", "offset")


@query('SELECT room, event_id, "offset" FROM room WHERE room = \'click\' AND "offset" BETWEEN 100 AND 149')
def room_consume(s, d):
    return rooms.consume(ks.room_events(s, d), "click", 100, 50).select("room", "event_id", "offset")


@query('SELECT room, count(*) AS message_count, min("offset") AS min_offset, max("offset") AS max_offset FROM room GROUP BY room')
def room_stats(s, d):
    return rooms.room_stats(ks.room_events(s, d))


@query("SELECT room, event_id FROM room WHERE epoch(date_trunc('second', ts)) > epoch(TIMESTAMP '2024-01-20') - 864000")
def room_time_retention(s, d):
    now = F.lit("2024-01-20").cast("timestamp")
    return rooms.keep_recent(ks.room_events(s, d), now, 864_000).select("room", "event_id")


@query('SELECT room, event_id FROM (SELECT *, max("offset") OVER (PARTITION BY room) AS last FROM room) WHERE last - "offset" < 100 OR (room = \'click\' AND "offset" >= last - 150)')
def room_cap_slowest_cursor(s, d):
    e = ks.room_events(s, d)
    ends = e.groupBy("room").agg(F.max("offset").alias("last"))
    cursors = ends.filter("room = 'click'").select("room", F.explode(F.array(F.col("last") - 150, F.col("last") - 20)).alias("last_offset"))
    return rooms.capped(e, 100, 1000, cursors).select("room", "event_id")


@query('SELECT event_id, partition_id, "offset" FROM topic')
def topic_partitioned(s, d):
    return ks.topic_events(s, d).select("event_id", "partition_id", "offset")


@query('SELECT event_id, partition_id, "offset" FROM topic WHERE partition_id = 2 AND "offset" BETWEEN 10 AND 39')
def topic_consume_partition(s, d):
    return rooms.consume_partition(ks.topic_events(s, d), "events", 2, 10, 30).select("event_id", "partition_id", "offset")


@query('SELECT event_id, partition_id, "offset" FROM topic WHERE "offset" BETWEEN 5 AND 44 ORDER BY epoch(date_trunc(\'second\', ts)), partition_id, "offset" LIMIT 40')
def topic_consume_all(s, d):
    return rooms.consume_all(ks.topic_events(s, d), "events", 5, 40).select("event_id", "partition_id", "offset")


@query('SELECT event_id FROM (SELECT *, sum(size_bytes) OVER (PARTITION BY partition_id ORDER BY "offset" DESC) AS upto, row_number() OVER (PARTITION BY partition_id ORDER BY "offset" DESC) AS n FROM topic WHERE epoch(date_trunc(\'second\', ts)) > epoch(TIMESTAMP \'2024-01-25\') - 1728000) WHERE upto <= 3000 AND n <= 110')
def topic_combined_retention(s, d):
    now = F.lit("2024-01-25").cast("timestamp")
    return rooms.retain(ks.topic_events(s, d), now=now, retention_secs=1_728_000, max_bytes=3000, max_messages=110).select("event_id")


@query('SELECT \'events\' AS topic, partition_id, count(*) AS message_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, min("offset") AS min_offset, max("offset") AS max_offset FROM topic GROUP BY partition_id')
def topic_stats(s, d):
    return rooms.topic_stats(ks.topic_events(s, d))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 5 AS INT) AS partition_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 5 AS \"offset\" FROM events")
def topic_round_robin(s, d):
    e = ks.table(s, d, "events").withColumn("topic", F.lit("t"))
    return rooms.round_robin(e, 5, ["ts", "event_id"]).select("event_id", "partition_id", "offset")


def _members(s, d):
    n = ks.table(s, d, "nation")
    return n.select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("group_id"), F.col("n_name").alias("member_id"))


_MEMBERS = "SELECT 'g' || n_regionkey AS group_id, n_name AS member_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS place, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation"


@query(f"SELECT group_id, member_id, CAST(p AS INT) AS partition_id FROM ({_MEMBERS}), range(17) t(p) WHERE p % n = place")
def group_round_robin(s, d):
    return groups.assign_round_robin(_members(s, d), 17)


@query("WITH parts AS (SELECT 'g' || r_regionkey AS group_id, CAST(p AS INT) AS p, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region, range(17) t(p)) SELECT m.group_id, m.member_id, p AS partition_id FROM parts JOIN (" + _MEMBERS + ") m ON m.group_id = parts.group_id AND m.place = CASE WHEN p < (17 % m.n) * (17 // m.n + 1) THEN p // (17 // m.n + 1) ELSE 17 % m.n + (p - (17 % m.n) * (17 // m.n + 1)) // (17 // m.n) END")
def group_range(s, d):
    return groups.assign_range(_members(s, d), 17)


@query('SELECT event AS group_id, partition_id, max_by("offset", event_id) AS "offset" FROM topic GROUP BY ALL')
def group_committed(s, d):
    return groups.committed(ks.topic_events(s, d).select(F.col("event").alias("group_id"), "partition_id", "offset", F.col("event_id").alias("seq")))


@query('SELECT group_id, partition_id, e - o AS lag FROM (SELECT event AS group_id, partition_id, max_by("offset", event_id) AS o FROM topic GROUP BY ALL) JOIN (SELECT partition_id, max("offset") + 1 AS e FROM topic GROUP BY 1) USING (partition_id)')
def group_lag(s, d):
    t = ks.topic_events(s, d)
    return groups.lag(t, t.select(F.col("event").alias("group_id"), "partition_id", "offset", F.col("event_id").alias("seq")))


# queues ------------------------------------------------------------------------------

@query("SELECT o_orderstatus AS queue, 'order-' || o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_orderpriority[1] AS INT), o_orderkey) - 1 AS place FROM orders")
def queue_priority_order(s, d):
    return queues.delivery_order(ks.queue_messages(s, d)).select("queue", "id", F.col("place").cast("long").alias("place"))


# routing and feeds -------------------------------------------------------------------

_ROUTES = ", ".join(f"('{who}', '{pattern}', '{topics.topic_regex(pattern)}')" for who, pattern in ks.SUBSCRIPTIONS)


@query(f"SELECT DISTINCT id, topic, subscriber_id FROM message JOIN (VALUES {_ROUTES}) v(subscriber_id, pattern, regex) ON CASE WHEN contains(pattern, '*') OR contains(pattern, '#') THEN regexp_matches(topic, regex) ELSE topic = pattern END")
def pubsub_route(s, d):
    given = s.createDataFrame(list(ks.SUBSCRIPTIONS), "subscriber_id string, pattern string")
    return pubsub.route_table(ks.pubsub_messages(s, d), given).select("id", "topic", "subscriber_id")


@query("SELECT '__keyspace@0__:user:' || user_id AS topic, event_type AS payload FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT '__keyevent@0__:' || event_type, 'user:' || user_id FROM events WHERE event_type IN ('click', 'view')")
def keyspace_events(s, d):
    e = ks.table(s, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "string").otherwise("generic")
    changes = e.select(kind.alias("class"), F.col("event_type").alias("event"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"))
    return pubsub.keyspace_events(changes, "KE$")


@query("SELECT '__watch@0__:user:' || user_id AS channel, 'user:' || user_id AS key, event, version, CASE WHEN strlen(props) <= 8 THEN props END AS value, strlen(props) > 8 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY user_id, life ORDER BY event_id) AS version FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS event, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM events))")
def watch_feed(s, d):
    e = ks.table(s, d, "events")
    event = F.when(F.col("event_type") == "error", "del").otherwise("set")
    changes = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), event.alias("event"), F.col("props").cast("binary").alias("value"))
    return pubsub.watch_feed(changes, inline=8)


# client dataflow ---------------------------------------------------------------------

@query("SELECT event_id FROM events QUALIFY lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) > 3600000000")
def rx_debounce(s, d):
    return rx.debounce(ks.table(s, d, "events"), 3600, "user_id").select("event_id")


@query("SELECT user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def rx_buffer_time(s, d):
    return rx.buffer_time(ks.table(s, d, "events"), 7200, "user_id").select("user_id", "n")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND (f.value >= 90 OR f.value IS NULL) AND (f.ts, f.event_id) <= (e.ts, e.event_id))")
def rx_take_while(s, d):
    return rx.take_while(ks.table(s, d, "events"), F.col("value") < 90, ["ts", "event_id"], "user_id").select("event_id")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 20 OFFSET 30")
def rx_skip_take(s, d):
    return rx.take(rx.skip(ks.table(s, d, "events"), 30, ["ts", "event_id"]), 20, ["ts", "event_id"]).select("event_id")


@query("SELECT event_id, 0 AS source FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'view'")
def rx_merge(s, d):
    e = ks.table(s, d, "events").select("event_id", "event_type")
    return rx.merge(e.filter("event_type = 'click'"), e.filter("event_type = 'view'")).select("event_id", "source")


# slots, tenants, quotas, eviction ----------------------------------------------------

@query("SELECT CAST(c_custkey * 7919 % 16384 AS INT) AS slot, CASE WHEN c_custkey * 7919 % 16384 < 5461 THEN 'n0' WHEN c_custkey * 7919 % 16384 < 10922 THEN 'n1' ELSE 'n2' END AS node FROM customer")
def slot_owner(s, d):
    given = ks.table(s, d, "customer").select((F.col("c_custkey") * 7919 % 16384).cast("int").alias("slot"))
    ranges = s.createDataFrame([("n0", 0, 5460), ("n1", 5461, 10921), ("n2", 10922, 16383)], "node string, first int, last int")
    return governance.slot_owner(given, ranges)


@query("SELECT 'user_' || c_nationkey || ':' || c_custkey AS scoped, CAST(c_custkey AS VARCHAR) AS own FROM customer")
def tenant_scope(s, d):
    c = ks.table(s, d, "customer")
    scoped = governance.scoped(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    return c.select(scoped.alias("scoped")).withColumn("own", governance.unscoped(F.col("scoped")))


@query("SELECT 'user_' || c_nationkey || ':' || c_custkey AS key FROM customer WHERE c_nationkey = 3")
def tenant_filter(s, d):
    c = ks.table(s, d, "customer")
    return governance.own_resources(c.select(governance.scoped(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")).alias("key")), "3")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"user\", CAST(coalesce(b, 0) AS BIGINT) AS bytes, CAST(1000 + n_nationkey * 10 AS BIGINT) AS max_bytes, coalesce(b, 0) <= 1000 + n_nationkey * 10 AS fits FROM nation LEFT JOIN (SELECT c_nationkey, sum(strlen(c_name)) AS b FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def quota_storage(s, d):
    usage = ks.table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("user"), F.octet_length("c_name").cast("long").alias("bytes"))
    limits = ks.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("user"), (F.lit(1000) + F.col("n_nationkey") * 10).cast("long").alias("max_bytes"))
    return governance.storage_quota(usage, limits)


@query("SELECT key, size FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY last_access, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(size) OVER () AS total FROM (SELECT 'order:' || o_orderkey AS key, CAST(o_totalprice AS BIGINT) AS size, o_orderkey * 7919 % 10007 AS last_access FROM orders)) WHERE freed >= total - 90000000")
def evict_lru(s, d):
    o = ks.table(s, d, "orders")
    entries = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), F.rint("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") * 7919 % 10007).alias("last_access"), F.lit(None).cast("long").alias("expires_at_ms"), F.lit(0).cast("long").alias("freq"))
    return governance.evict(entries, "allkeys-lru", 90_000_000).select("key", "size")


@query("SELECT event_id AS id, CAST(value AS BIGINT) AS duration_us FROM events WHERE CAST(value AS BIGINT) >= 50 ORDER BY event_id DESC LIMIT 100")
def slowlog(s, d):
    e = ks.table(s, d, "events").select(F.col("event_id").alias("id"), F.rint("value").cast("long").alias("duration_us"))
    return governance.slowlog(e, 50, 100)


# operation log -----------------------------------------------------------------------

def oplog_of(s, d):
    """SETs with conditions and expiry, increments and deletions of each customer's keys, from orders."""
    o = ks.table(s, d, "orders")
    op = F.when(F.col("o_orderkey") % 7 == 0, "DEL").otherwise("SET")
    args = F.when(F.col("o_orderkey") % 5 == 0, F.create_map(F.lit("NX"), F.lit("1"))).when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("KEEPTTL"), F.lit("1")))
    args = F.coalesce(args, F.when(F.col("o_orderkey") % 4 == 0, F.create_map(F.lit("expires_at_ms"), (F.col("o_orderkey") * 1000 + 500_000).cast("string"))))
    return o.select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 1000).alias("ts_ms"), op.alias("op"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("key"), F.lit(None).cast("binary").alias("member"), F.col("o_orderstatus").cast("binary").alias("value"), F.col("o_totalprice").alias("num"), args.alias("args"))


@query("SELECT 'c:' || o_custkey AS key, max_by(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY o_custkey HAVING max(o_orderkey) % 7 <> 0")
def oplog_latest(s, d):
    return fold.latest_values(oplog_of(s, d)).select("key", text("value"))
