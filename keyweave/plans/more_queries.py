"""More registered queries: folds of every kind of operation, catalogues, groups, snapshots, transactions, placement, and what is told about collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, checks, slots, ttl
from ..operators import bitmaps, deadlines, geosets, governance, hashes, hll, keyspace, lists, sets, strings, zsets
from ..schemas import OPLOG
from ..sources import keyspaces as ks
from ..sources import oplog
from ..streaming import catalogue, groups, jobs, pubsub, queues, readers, rooms, rx
from . import fold, scripts, transactions
from .queries import _DIST, NOW, query, text
from .staging import shared_dir

# reads of every collection ---------------------------------------------------------------


@query("SELECT key, field FROM hash")
def hash_hkeys(s, d):
    return hashes.hkeys(ks.hashes(s, d))


@query("SELECT key, value FROM hash")
def hash_hvals(s, d):
    return hashes.hvals(ks.hashes(s, d)).select("key", text("value"))


@query("SELECT member FROM set_ WHERE key = 'click'")
def set_smembers(s, d):
    return sets.smembers(ks.sets(s, d), "click").select(text("member"))


@query("SELECT key, score FROM scores WHERE member = '7'")
def zset_zscore(s, d):
    return zsets.zscore(ks.user_scores(s, d), b"7")


@query("SELECT key, member, score FROM scores WHERE NOT (key = 'view' AND length(member) = 2)")
def zset_zrem(s, d):
    z = ks.user_scores(s, d)
    return zsets.zrem(z, z.filter((F.col("key") == "view") & (F.octet_length("member") == 2))).select("key", text("member"), "score")


@query("SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zset QUALIFY rank BETWEEN count(*) OVER (PARTITION BY key) - 6 AND count(*) OVER (PARTITION BY key) - 3")
def zset_zrange_tail(s, d):
    return zsets.zrange(ks.zsets(s, d), -6, -3).select("key", text("member"), "score", "rank")


@query("SELECT count(*) AS total_sets, CAST(sum(n) AS BIGINT) AS total_members, avg(n) AS avg_members, CAST(sum(b) AS BIGINT) AS total_bytes FROM (SELECT key, count(*) AS n, sum(strlen(member)) AS b FROM set_ GROUP BY key)")
def set_stats(s, d):
    return sets.stats(ks.sets(s, d))


@query("SELECT count(DISTINCT key) AS total_lists, count(*) AS total_elements, CAST(sum(strlen(value)) AS BIGINT) AS total_bytes FROM list")
def list_stats(s, d):
    return lists.stats(ks.lists(s, d))


@query('SELECT count(DISTINCT key) AS total_bitmaps, count(*) AS total_bits, max("offset") AS highest FROM bitmap')
def bitmap_stats(s, d):
    return bitmaps.stats(ks.bitmaps(s, d))


@query("SELECT count(DISTINCT event_type) AS total_sketches, true AS sized FROM events")
def hll_stats(s, d):
    found = hll.stats(hll.pfadd(ks.elements(s, d)))
    return found.select("total_sketches", (F.col("total_bytes") > 0).alias("sized"))


@query("SELECT event_type AS key, count(DISTINCT user_id) AS n FROM events GROUP BY 1 HAVING n < 0 UNION ALL SELECT event_type, count(DISTINCT user_id % 20) FROM events GROUP BY 1")
def hll_small_counts(s, d):
    """Sketches count exactly as long as they hold few elements."""
    few = ks.elements(s, d).select("key", (F.col("element") % 20).alias("element"))
    return hll.pfcount(hll.pfadd(few)).select("key", F.col("estimate").alias("n"))


@query("SELECT count(DISTINCT event_type) AS keys, count(DISTINCT user_id % 20) AS n FROM events WHERE event_type IN ('click', 'error')")
def hll_union_count(s, d):
    few = ks.elements(s, d).select("key", (F.col("element") % 20).alias("element"))
    merged = hll.pfcount(hll.pfadd(few), ["click", "error"])
    return merged.select(F.lit(2).cast("long").alias("keys"), F.col("estimate").alias("n"))


@query("SELECT count(*) AS total_locations, count(DISTINCT 'customers') AS total_keys FROM geo")
def geo_stats(s, d):
    return geosets.stats(geosets.geoadd(ks.places(s, d))).select("total_keys", "total_locations")


@query("SELECT key, CAST(bit_count(ascii(substr(value, 1, 1))) + bit_count(ascii(substr(value, 2, 1))) AS INT) AS ones FROM (SELECT key, value FROM kv)")
def bitmap_popcount(s, d):
    return ks.kv(s, d).select("key", bits.bit_count(F.substring("value", 1, 2)).alias("ones"))


@query("SELECT key, CASE WHEN regexp_matches(value, '^[+-]?[0-9]+$') THEN TRY_CAST(value AS BIGINT) END AS whole FROM (SELECT 'part:' || p_partkey AS key, unnest([p_brand, CAST(p_size AS VARCHAR), CAST(p_size AS VARCHAR) || '_0', '-' || p_size]) AS value FROM part)")
def kv_parse_integer(s, d):
    p = ks.table(s, d, "part")
    size = F.col("p_size").cast("string")
    values = F.array(F.col("p_brand"), size, F.concat(size, F.lit("_0")), F.concat(F.lit("-"), size))
    each = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.explode(values).alias("value"))
    return each.select("key", strings.as_integer(F.col("value").cast("binary")).alias("whole"))


@query("SELECT 'part:' || p_partkey AS key, CAST(p_size + 41 AS VARCHAR) AS value FROM part")
def kv_format_integer(s, d):
    """A counter as it is stored: its digits."""
    p = ks.table(s, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_size").cast("long").alias("num"))
    more = p.select("key", F.lit(41).cast("long").alias("num"))
    return strings.incremented(p.unionByName(more)).select("key", F.col("counter").cast("string").alias("value"))


@query("SELECT key, value FROM live WHERE false")
def kv_flushdb(s, d):
    return strings.flush(strings.live(ks.kv(s, d), NOW)).select("key", text("value"))


@query("SELECT DISTINCT key FROM (SELECT key FROM set_ UNION ALL SELECT key FROM hash UNION ALL SELECT key FROM live) JOIN (SELECT unnest(['click', 'part:1', 'customer:1', 'nothing']) AS k) ON key = k")
def key_exists(s, d):
    asked = s.createDataFrame([("click",), ("part:1",), ("customer:1",), ("nothing",)], "key string")
    return keyspace.exists({"set": ks.sets(s, d), "hash": ks.hashes(s, d), "string": strings.live(ks.kv(s, d), NOW)}, asked)


@query("SELECT CASE WHEN key = 'click' THEN 'fresh' ELSE key END AS key, member FROM set_")
def key_renamenx_free(s, d):
    return keyspace.rename(ks.sets(s, d), "click", "fresh", only_new=True).select("key", text("member"))


@query("SELECT key, member FROM set_ WHERE key NOT IN ('click', 'nothing')")
def set_del(s, d):
    return sets.delete(ks.sets(s, d), ["click", "nothing"])[1].select("key", text("member"))


@query("SELECT key, idx, value FROM list WHERE key NOT IN ('user:1', 'user:2')")
def list_del(s, d):
    return lists.delete(ks.lists(s, d), ["user:1", "user:2"])[1].select("key", "idx", text("value"))


@query("SELECT DISTINCT key FROM list WHERE key IN ('user:1', 'user:2', 'nobody')")
def list_exists(s, d):
    return lists.exists(ks.lists(s, d), s.createDataFrame([("user:1",), ("user:2",), ("nobody",)], "key string"))


@query("SELECT member FROM set_ WHERE key = 'view' AND CAST(member AS BIGINT) % 3 <> 0")
def set_sdiff(s, d):
    """A difference that leaves something: views but every third user."""
    st = ks.sets(s, d)
    third = st.filter(F.col("member").cast("string").cast("long") % 3 == 0).select(F.lit("third").alias("key"), "member").distinct()
    return sets.sdiff(st.unionByName(third), ["view", "third"]).select(text("member"))


# expiry of collections -------------------------------------------------------------------

_ENDS = f"SELECT DISTINCT key, CASE key WHEN 'click' THEN {NOW} - 1 WHEN 'view' THEN {NOW} + 90500 ELSE {NOW} END AS expires_at_ms FROM set_ WHERE key IN ('click', 'view', 'error')"


def _ends(s):
    return s.createDataFrame([("click", NOW - 1), ("view", NOW + 90_500), ("error", NOW)], "key string, expires_at_ms long")


@query("SELECT key, member, score FROM scores WHERE key NOT IN ('click', 'error')")
def zset_live(s, d):
    return deadlines.live(ks.user_scores(s, d), _ends(s), NOW).select("key", text("member"), "score")


@query("SELECT DISTINCT key, CAST(CASE key WHEN 'click' THEN -1 WHEN 'view' THEN 90 WHEN 'error' THEN 0 END AS BIGINT) AS ttl FROM scores")
def zset_ttl(s, d):
    return deadlines.ttl(ks.user_scores(s, d), _ends(s), NOW)


@query(f"SELECT DISTINCT key, CASE key WHEN 'click' THEN {NOW} - 1 WHEN 'error' THEN {NOW} ELSE {NOW} + 5000 END AS expires_at_ms FROM scores WHERE key IN ('click', 'view', 'error', 'purchase')")
def zset_expire(s, d):
    """Keys that have ended are not there to be given a new end."""
    return deadlines.expire(ks.user_scores(s, d), _ends(s), ["click", "view", "purchase", "nothing"], 5, NOW)


@query(f"SELECT * FROM (VALUES ('click', {NOW} - 1), ('error', {NOW})) v(key, expires_at_ms)")
def zset_persist(s, d):
    return deadlines.persist(_ends(s), ["click", "view"], NOW)


_RESTARTS = f"SELECT key, max_by(until_ms, o) AS expires_at_ms FROM (SELECT key, -1 AS o, expires_at_ms AS until_ms FROM ends UNION ALL SELECT event_type, event_id, {NOW} + event_id * 10 + user_id * 1000 FROM events WHERE user_id % 2 = 0) GROUP BY key"


def _restarted(s, d):
    e = ks.table(s, d, "events")
    seconds = F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
    writes = e.select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") * 10 + NOW).alias("ts_ms"), seconds.alias("ttl_secs"))
    return deadlines.restarted(_ends(s), writes)


@query(f"WITH ends AS (SELECT * FROM (VALUES ('click', {NOW} - 1), ('view', {NOW} + 90500), ('error', {NOW})) v(key, expires_at_ms)) {_RESTARTS}")
def hll_ttl_restart(s, d):
    return _restarted(s, d)


@query(f"WITH ends AS (SELECT * FROM (VALUES ('click', {NOW} - 1), ('view', {NOW} + 90500), ('error', {NOW})) v(key, expires_at_ms)) SELECT key, \"offset\" FROM (SELECT DISTINCT event_type AS key, user_id AS \"offset\" FROM events) b LEFT JOIN ({_RESTARTS}) USING (key) WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW} + 60000")
def bitmap_ttl_restart(s, d):
    return deadlines.live(ks.bitmaps(s, d), _restarted(s, d), NOW + 60_000)


@query(f"SELECT key, expires_at_ms AS ends, {NOW} + 7000 AS ex, {NOW} + 8 AS px, 9000 AS exat, 10 AS pxat FROM kv")
def kv_expiry_options(s, d):
    given = ttl.expires_at(NOW, ex=7), ttl.expires_at(NOW, px=8), ttl.expires_at(NOW, exat=9), ttl.expires_at(NOW, pxat=10)
    return ks.kv(s, d).select("key", F.col("expires_at_ms").alias("ends"), *[F.lit(g).cast("long" if g > 1 << 31 else "int").alias(n) for g, n in zip(given, ("ex", "px", "exat", "pxat"))])


@query("SELECT event_type AS key, CAST(coalesce(count(*) FILTER (value >= 50), 0) AS DOUBLE) / count(*) AS rate FROM events WHERE value IS NOT NULL GROUP BY 1")
def cache_hit_rate(s, d):
    e = ks.table(s, d, "events").filter("value IS NOT NULL").groupBy(F.col("event_type").alias("key"))
    counted = e.agg(F.count(F.when(F.col("value") >= 50, 1)).alias("hits"), F.count(F.when(F.col("value") < 50, 1)).alias("misses"))
    return counted.select("key", ttl.hit_rate(F.col("hits"), F.col("misses")).alias("rate"))


@query("SELECT key, count(*) AS freq FROM (SELECT 'user:' || user_id AS key FROM events) GROUP BY 1 ORDER BY freq, key LIMIT 25")
def cache_lfu_victims(s, d):
    return governance.lfu_victims(ks.table(s, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key")), 25)


@query("SELECT CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS bytes, true AS exceeds FROM orders")
def memory_budget(s, d):
    held = ks.table(s, d, "orders").select(F.rint("o_totalprice").cast("long").alias("size"))
    return governance.would_exceed(held, 1000, 500)


# geo -------------------------------------------------------------------------------------


@query("SELECT member, CAST(bits AS DOUBLE) AS score FROM packed WHERE member NOT LIKE '%7' UNION ALL SELECT member, CAST((CAST(floor((1 + 90.0) * 67108864 / 180.0 + 0.5) AS BIGINT) << 26) | CAST(floor((2 + 180.0) * 67108864 / 360.0 + 0.5) AS BIGINT) AS DOUBLE) FROM packed WHERE member LIKE '%7'")
def geo_geoadd_xx(s, d):
    """GEOADD XX: members that are there move, others do not come."""
    places = ks.places(s, d)
    geos = geosets.geoadd(places)
    moved = places.filter(F.col("member").cast("string").endswith("7")).select("key", "member", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    new = moved.unionByName(s.createDataFrame([("customers", b"nobody", 0.0, 0.0)], "key string, member binary, lat double, lon double"))
    return geosets.geoadd_into(geos, new, xx=True)[1].select(text("member"), "score")


@query("SELECT 'customers' AS key, count(*) AS n FROM packed WHERE member LIKE '%7'")
def geo_geoadd_ch(s, d):
    places = ks.places(s, d)
    moved = places.filter(F.col("member").cast("string").endswith("7")).select("key", "member", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    same = places.filter(F.col("member").cast("string").endswith("8"))
    return geosets.geoadd_into(geosets.geoadd(places), moved.unionByName(same), ch=True)[0]


@query("SELECT 'customers' AS key, 1 AS n")
def geo_geoadd_nx(s, d):
    places = ks.places(s, d)
    new = places.filter(F.col("member").cast("string").endswith("7")).withColumn("lat", F.lit(0.0)).unionByName(s.createDataFrame([("customers", b"nobody", 0.0, 0.0)], "key string, member binary, lat double, lon double"))
    return geosets.geoadd_into(geosets.geoadd(places), new, nx=True)[0]


@query(f"SELECT g.member, round({_DIST.format(a='c.lat', b='g.lat', c='c.lon', d='g.lon')} * 6371.0, 3) AS distance FROM geo g, (SELECT lat, lon FROM geo WHERE member = (SELECT c_name FROM customer WHERE c_custkey = 7)) c ORDER BY {_DIST.format(a='c.lat', b='g.lat', c='c.lon', d='g.lon')}, g.member LIMIT 15")
def geo_geosearch_member_radius(s, d):
    name = ks.table(s, d, "customer").filter("c_custkey = 7").select("c_name").first()[0]
    found = geosets.geosearch(geosets.geoadd(ks.places(s, d)), "customers", member=name.encode(), radius=20_100, unit="km", count=15)
    return found.select(text("member"), F.round("distance", 3).alias("distance"))


@query("SELECT g.member FROM geo g, (SELECT lat, lon FROM geo WHERE member = (SELECT c_name FROM customer WHERE c_custkey = 7)) c WHERE g.lat BETWEEN c.lat - 900 * 1000.0 / 2 / 111000 AND c.lat + 900 * 1000.0 / 2 / 111000 AND g.lon BETWEEN c.lon - 4000 * 1000.0 / 2 / (111000 * cos(radians(c.lat))) AND c.lon + 4000 * 1000.0 / 2 / (111000 * cos(radians(c.lat)))")
def geo_geosearch_member_box(s, d):
    name = ks.table(s, d, "customer").filter("c_custkey = 7").select("c_name").first()[0]
    return geosets.geosearch(geosets.geoadd(ks.places(s, d)), "customers", member=name.encode(), box=(4000, 900), unit="km").select(text("member"))


@query(f"SELECT member, round({_DIST.format(a='10', b='lat', c='20', d='lon')} * 6371000.0, 1) AS distance FROM geo WHERE {_DIST.format(a='10', b='lat', c='20', d='lon')} * 6371000.0 <= 3000000 ORDER BY {_DIST.format(a='10', b='lat', c='20', d='lon')} DESC, member LIMIT 10")
def geo_geosearch_point_desc(s, d):
    found = geosets.geosearch(geosets.geoadd(ks.places(s, d)), "customers", at=(10.0, 20.0), radius=3_000_000, count=10, descending=True)
    return found.select(text("member"), F.round("distance", 1).alias("distance"))


# pub/sub ---------------------------------------------------------------------------------


def _routed(s, d):
    given = s.createDataFrame(list(ks.SUBSCRIPTIONS), "subscriber_id string, pattern string")
    return given, pubsub.route_table(ks.pubsub_messages(s, d), given)


_REACHED = "SELECT DISTINCT id, topic, subscriber_id FROM message JOIN (VALUES {routes}) v(subscriber_id, pattern, regex) ON CASE WHEN contains(pattern, '*') OR contains(pattern, '#') THEN regexp_matches(topic, regex) ELSE topic = pattern END"


def _routes() -> str:
    from .queries import _ROUTES

    return _REACHED.format(routes=_ROUTES)


@query("SELECT subscriber_id, pattern FROM (VALUES ('s1', 'events.*.user1'), ('s2', 'events.error.#'), ('s3', 'events.click.user*'), ('s4', 'events.purchase.user7'), ('s1', 'events.view.user1'), ('s5', '#'), ('s6', 'a.b'), ('s6', 'c.#')) v(subscriber_id, pattern)")
def pubsub_subscribe(s, d):
    given = s.createDataFrame(list(ks.SUBSCRIPTIONS), "subscriber_id string, pattern string")
    return pubsub.subscribe(pubsub.subscribe(given, "s6", ["a.b", "c.#"]), "s1", ["events.*.user1"])


@query("SELECT subscriber_id, pattern FROM (VALUES ('s1', 'events.view.user1'), ('s3', 'events.click.user*'), ('s4', 'events.purchase.user7'), ('s5', '#')) v(subscriber_id, pattern)")
def pubsub_unsubscribe(s, d):
    given = s.createDataFrame(list(ks.SUBSCRIPTIONS), "subscriber_id string, pattern string")
    return pubsub.unsubscribe(pubsub.unsubscribe(given, "s1", ["events.*.user1"]), "s2")


@query("SELECT unnest(['events.purchase.user7', 'events.view.user1']) AS topic")
def pubsub_topics(s, d):
    return pubsub.topics(s.createDataFrame(list(ks.SUBSCRIPTIONS), "subscriber_id string, pattern string"))


@query(f"SELECT topic, count(DISTINCT subscriber_id) AS subscribers, count(DISTINCT id) AS messages FROM ({_routes()}) GROUP BY topic")
def pubsub_topic_info(s, d):
    return pubsub.topic_info(_routed(s, d)[1])


@query("SELECT id, topic = 'events.view.user1' OR regexp_matches(topic, '^events\\.error(\\..*)?$') AS heard FROM message")
def pubsub_has_subscriber(s, d):
    m = ks.pubsub_messages(s, d)
    return m.select("id", pubsub.has_subscriber([("s1", "events.view.user1"), ("s2", "events.error.#")], F.col("topic")).alias("heard"))


@query(f"SELECT 2 AS topics, 5 AS subscribers, 4 AS wildcards, count(*) AS deliveries, count(DISTINCT id) AS messages FROM ({_routes()})")
def pubsub_stats(s, d):
    return pubsub.stats(*_routed(s, d))


@query(f"SELECT subscriber_id, id FROM ({_routes()}) WHERE subscriber_id <> 's5' QUALIFY row_number() OVER (PARTITION BY subscriber_id ORDER BY id) <= 40")
def pubsub_delivered(s, d):
    connected = s.createDataFrame([(f"s{i}",) for i in range(1, 5)], "subscriber_id string")
    return pubsub.delivered(_routed(s, d)[1], connected, 40)[0].select("subscriber_id", "id")


@query(f"SELECT subscriber_id, count(*) - 40 AS lost FROM ({_routes()}) WHERE subscriber_id <> 's5' GROUP BY 1 HAVING count(*) > 40")
def pubsub_disconnected(s, d):
    connected = s.createDataFrame([(f"s{i}",) for i in range(1, 5)], "subscriber_id string")
    return pubsub.delivered(_routed(s, d)[1], connected, 40)[1]


# client dataflow -------------------------------------------------------------------------


@query("SELECT event_id AS id, upper(event_type) AS kind, value * 2 AS twice FROM events")
def rx_map(s, d):
    return rx.map_items(ks.table(s, d, "events"), id=F.col("event_id"), kind=F.upper("event_type"), twice=F.col("value") * 2)


@query("SELECT event_id FROM events WHERE value > 20 AND event_type = 'view'")
def rx_filter(s, d):
    return rx.filter_items(ks.table(s, d, "events"), (F.col("value") > 20) & (F.col("event_type") == "view")).select("event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type = 'error' THEN 'nack' ELSE 'ack' END AS outcome FROM events")
def rx_process(s, d):
    def handler(row):
        if row["event_type"] == "error":
            raise ValueError("refused")

    e = ks.table(s, d, "events").select(F.col("event_id").cast("string").alias("id"), "event_type")
    return rx.process(e, handler, 0)


# life cycles -----------------------------------------------------------------------------

_LIFE = "SELECT o_orderkey AS seq, 'room:' || o_custkey AS name, ['create', 'ensure', 'delete'][1 + o_orderkey % 3] AS op, 'cap=' || o_orderkey AS config FROM orders"


def _life(s, d):
    o = ks.table(s, d, "orders")
    op = F.get(F.array(F.lit("create"), F.lit("ensure"), F.lit("delete")), (F.col("o_orderkey") % 3).cast("int"))
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("room:"), F.col("o_custkey").cast("string")).alias("name"), op.alias("op"), F.concat(F.lit("cap="), F.col("o_orderkey").cast("string")).alias("config"))


@query(f"SELECT seq, name, op, CASE WHEN op <> 'delete' THEN CASE WHEN before IN ('create', 'ensure') THEN 'exists' ELSE 'created' END WHEN before IN ('create', 'ensure') THEN 'deleted' ELSE 'not found' END AS outcome, CASE WHEN op = 'create' THEN coalesce(before NOT IN ('create', 'ensure'), true) WHEN op = 'delete' THEN coalesce(before IN ('create', 'ensure'), false) ELSE true END AS ok FROM (SELECT *, lag(op) OVER (PARTITION BY name ORDER BY seq) AS before FROM ({_LIFE}))")
def life_outcomes(s, d):
    return catalogue.outcomes(_life(s, d)).select("seq", "name", "op", "outcome", "ok")


@query(f"SELECT name, min(seq) AS seq, min_by(config, seq) AS config FROM (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY name) AS gone FROM ({_LIFE})) WHERE op <> 'delete' AND (gone IS NULL OR seq > gone) GROUP BY name")
def life_existing(s, d):
    return catalogue.existing(_life(s, d))


@query(f"SELECT event_id FROM events WHERE 'room:' || user_id IN (SELECT name FROM ({_LIFE}) GROUP BY name HAVING max_by(op, seq) <> 'delete')")
def life_published(s, d):
    """Events published to logs that are there."""
    e = ks.table(s, d, "events").withColumn("room", F.concat(F.lit("room:"), F.col("user_id").cast("string")))
    return catalogue.accepted(e, catalogue.existing(_life(s, d)), "room")[0].select("event_id")


@query(f"SELECT event_id FROM events WHERE 'room:' || user_id NOT IN (SELECT name FROM ({_LIFE}) GROUP BY name HAVING max_by(op, seq) <> 'delete')")
def life_refused(s, d):
    e = ks.table(s, d, "events").withColumn("room", F.concat(F.lit("room:"), F.col("user_id").cast("string")))
    return catalogue.accepted(e, catalogue.existing(_life(s, d)), "room")[1].select("event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS \"offset\" FROM events WHERE event_type <> 'view' AND value > 10")
def room_restored(s, d):
    """A log published again from what a filter left of it: offsets start anew."""
    e = ks.table(s, d, "events").filter("event_type <> 'view' AND value > 10").withColumnRenamed("event_type", "room").withColumn("offset", F.lit(0).cast("long"))
    return rooms.restore(e, ["ts", "event_id"]).select("event_id", "offset")


@query("SELECT event_type AS room, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def room_list(s, d):
    e = ks.room_events(s, d)
    return rooms.rooms(e).join(rooms.room_stats(e).select("room", F.col("message_count").alias("n")), "room")


@query('SELECT room, "offset", event_id, CASE WHEN "offset" < 10 + 40 THEN "offset" + 1 END AS following FROM room WHERE "offset" BETWEEN 10 AND 49')
def room_cursors(s, d):
    """What each room's reader gets from offset 10 on, and where every event leaves it."""
    e = ks.room_events(s, d)
    return e.filter(F.col("offset").between(10, 49)).select("room", "offset", "event_id", (F.col("offset") + 1).alias("following"))


@query("SELECT room, 's' AS subscriber, CAST(least(10 + 40, n) AS BIGINT) AS last_offset FROM (SELECT room, count(*) AS n FROM room GROUP BY room) WHERE n > 10")
def room_next_cursor(s, d):
    e = ks.room_events(s, d)
    reads = e.groupBy("room").agg(F.count(F.lit(1)).alias("n")).filter("n > 10").select("room", F.lit("s").alias("subscriber"), F.lit(10).cast("long").alias("from_offset"), F.lit(40).cast("long").alias("max_events"))
    return rooms.next_cursor(e, reads)


# readers in groups -----------------------------------------------------------------------

_READS = "SELECT n_regionkey * 100 + n_nationkey AS seq, (SELECT min(event_type) FROM events WHERE event_type >= CASE n_regionkey % 2 WHEN 0 THEN 'click' ELSE 'view' END) AS room, 'g' || n_regionkey AS group_id, n_name AS consumer_id, 10 + n_nationkey AS max_events FROM nation"


def _reads(s, d):
    n = ks.table(s, d, "nation")
    room = F.when(F.col("n_regionkey") % 2 == 0, "click").otherwise("view")
    return n.select((F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("seq"), room.alias("room"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("group_id"), F.col("n_name").alias("consumer_id"), (F.col("n_nationkey") + 10).alias("max_events"))


_DELIVERED = f'SELECT r.room, group_id, consumer_id, seq, "offset" FROM (SELECT *, coalesce(sum(max_events) OVER (PARTITION BY room, group_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ({_READS})) r JOIN (SELECT room, "offset", row_number() OVER (PARTITION BY room ORDER BY "offset") - 1 AS place FROM room WHERE "offset" % 7 <> 3) e ON e.room = r.room AND place >= start AND place < start + max_events'


def _delivered(s, d):
    e = ks.room_events(s, d).select("room", "offset")
    return readers.deliveries(readers.without(e, e.filter(F.col("offset") % 7 == 3)), _reads(s, d))


@query(_DELIVERED)
def readers_deliveries(s, d):
    """XREADGROUP on logs some events of which were deleted."""
    return _delivered(s, d)


@query(f'SELECT * FROM ({_DELIVERED}) WHERE "offset" % 2 = 1')
def readers_pending(s, d):
    told = _delivered(s, d)
    return readers.pending(told, told.filter(F.col("offset") % 2 == 0)).select("room", "group_id", "consumer_id", "seq", "offset")


@query(f'SELECT room, group_id, count(*) AS acknowledged FROM ({_DELIVERED}) WHERE "offset" % 2 = 0 GROUP BY ALL')
def readers_acknowledged(s, d):
    told = _delivered(s, d)
    twice = told.filter(F.col("offset") % 2 == 0).select("room", "group_id", "offset")
    unknown = twice.withColumn("offset", F.col("offset") + 10**9)
    return readers.acknowledged(told, twice.unionByName(twice).unionByName(unknown))


@query('SELECT room, count(*) AS removed FROM room WHERE "offset" % 7 = 3 GROUP BY room')
def readers_removed(s, d):
    e = ks.room_events(s, d).select("room", "offset")
    gone = e.filter(F.col("offset") % 7 == 3)
    return readers.removed(e, gone.unionByName(gone.withColumn("offset", F.col("offset") + 10**9)))


@query(f'SELECT room, group_id, max("offset") AS last_delivered, count(DISTINCT consumer_id) AS consumers FROM ({_DELIVERED}) GROUP BY ALL')
def readers_positions(s, d):
    return readers.group_positions(_delivered(s, d))


# groups of topics ------------------------------------------------------------------------

_CALLS = "SELECT c_custkey AS seq, c_custkey * 10 AS t, 'g' || c_nationkey % 5 AS group_id, 'm' || c_custkey % 7 AS member_id, ['join', 'heartbeat', 'heartbeat', 'leave', 'rebalance'][1 + (c_custkey // 7) % 5] AS op, 300 + c_custkey % 3 AS session_timeout_secs FROM customer"
_STAND = f"SELECT c.group_id, c.member_id, max(c.t) AS t, any_value(j.session_timeout_secs) AS session_timeout_secs FROM ({_CALLS}) c JOIN (SELECT group_id, member_id, max_by(op, seq) AS last, max(seq) AS since, max_by(session_timeout_secs, seq) AS session_timeout_secs FROM ({_CALLS}) WHERE op IN ('join', 'leave') GROUP BY ALL) j ON c.group_id = j.group_id AND c.member_id = j.member_id WHERE last = 'join' AND c.seq >= since AND op IN ('join', 'heartbeat') GROUP BY ALL"


def _calls(s, d):
    c = ks.table(s, d, "customer")
    key = F.col("c_custkey")
    op = F.get(F.array(*[F.lit(o) for o in ("join", "heartbeat", "heartbeat", "leave", "rebalance")]), (F.floor(key / 7) % 5).cast("int"))
    return c.select(key.alias("seq"), F.timestamp_seconds(key * 10).alias("ts"), F.concat(F.lit("g"), (F.col("c_nationkey") % 5).cast("string")).alias("group_id"), F.concat(F.lit("m"), (key % 7).cast("string")).alias("member_id"), op.alias("op"), (key % 3 + 300).alias("session_timeout_secs"))


@query(f"SELECT group_id, member_id, t AS heard, session_timeout_secs FROM ({_STAND})")
def group_members(s, d):
    found = groups.members_after(_calls(s, d))
    return found.select("group_id", "member_id", F.unix_seconds("last_heartbeat").alias("heard"), "session_timeout_secs")


@query(f"SELECT group_id, CAST(count(*) FILTER (op = 'rebalance') AS BIGINT) AS generation FROM ({_CALLS}) GROUP BY 1")
def group_generations(s, d):
    return groups.generations(_calls(s, d))


_AT = "(SELECT max(c_custkey) * 10 - 500 FROM customer)"


def _now(s, d):
    return F.timestamp_seconds(F.lit(ks.table(s, d, "customer").agg(F.max("c_custkey")).first()[0] * 10 - 500))


@query(f"SELECT group_id, member_id FROM ({_STAND}) WHERE {_AT} - t < session_timeout_secs")
def group_alive(s, d):
    return groups.alive(groups.members_after(_calls(s, d)), _now(s, d)).select("group_id", "member_id")


@query(f"SELECT group_id, bool_or({_AT} - t >= session_timeout_secs) AS needs_rebalance FROM ({_STAND}) GROUP BY 1")
def group_needs_rebalance(s, d):
    return groups.needs_rebalance(groups.members_after(_calls(s, d)), _now(s, d))


@query(f"WITH a AS (SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS place, count(*) OVER (PARTITION BY group_id) AS n FROM ({_STAND}) WHERE {_AT} - t < session_timeout_secs) SELECT group_id, member_id, CAST(p AS INT) AS partition_id FROM a, range(12) t(p) WHERE p % n = place")
def group_rebalanced(s, d):
    return groups.rebalanced(groups.members_after(_calls(s, d)), _now(s, d), 12)


@query("SELECT CAST(p AS INT) AS partition_id FROM range(17) t(p), (SELECT count(*) AS n FROM nation WHERE n_regionkey = 1), (SELECT count(*) AS place FROM nation WHERE n_regionkey = 1 AND n_name < (SELECT max(n_name) FROM nation WHERE n_regionkey = 1)) WHERE p % n = place")
def group_assignment(s, d):
    n = ks.table(s, d, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("group_id"), F.col("n_name").alias("member_id"))
    last = n.filter("group_id = 'g1'").agg(F.max("member_id")).first()[0]
    return groups.assignment(groups.assign_round_robin(n, 17), "g1", last)


@query("SELECT DISTINCT 'g' || n_regionkey AS group_id FROM nation")
def group_list(s, d):
    return groups.group_ids(ks.table(s, d, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("group_id")))


@query('SELECT group_id, members, coalesce(c, 0) AS committed_partitions, CAST(coalesce(o, 0) AS BIGINT) AS total_committed FROM (SELECT event AS group_id, count(DISTINCT key) AS members FROM topic GROUP BY 1) LEFT JOIN (SELECT group_id, count(*) AS c, sum(o) AS o FROM (SELECT event AS group_id, partition_id, max_by("offset", event_id) AS o FROM topic GROUP BY ALL) GROUP BY 1) USING (group_id)')
def group_stats(s, d):
    t = ks.topic_events(s, d)
    members = t.select(F.col("event").alias("group_id"), F.col("key").alias("member_id")).distinct()
    return groups.group_stats(members, t.select(F.col("event").alias("group_id"), "partition_id", "offset", F.col("event_id").alias("seq")))


@query("SELECT member_id, CAST(unnest(ps) AS INT) AS partition_id FROM (VALUES ('a', [0, 1, 2]), ('b', [4, 5]), ('c', [3, 6])) v(member_id, ps)")
def group_sticky(s, d):
    """Seven partitions of two members dealt to three: only what must move moves."""
    held = groups.assign_sticky(["a", "b", "c"], {"a": [0, 1, 2, 3], "b": [4, 5]}, 7)
    return s.createDataFrame([(m, p) for m, ps in held.items() for p in ps], "member_id string, partition_id int")


# folds of the operation log --------------------------------------------------------------


def _log(rows, op, *, key="c:", num=None, member=None, value=None, args=None):
    """Orders as operations on their customers' keys."""
    null = F.lit(None)
    return rows.select(
        F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 1000).alias("ts_ms"), op.alias("op"), F.concat(F.lit(key), F.col("o_custkey").cast("string")).alias("key"),
        (null if member is None else member).cast("binary").alias("member"), (null if value is None else value).cast("binary").alias("value"),
        (null if num is None else num).cast("double").alias("num"), (null if args is None else args).cast("map<string,string>").alias("args"),
    )


def _one_of(*names):
    return F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % len(names)).cast("int"))


def _flag(name):
    return F.create_map(F.lit(name), F.lit("1"))


_STEPS = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM ({ops})"

# strings: counters that refuse what is no integer, appended to, replaced, ended and kept
_COUNTED = _STEPS.format(ops="SELECT o_orderkey AS seq, 'n:' || o_custkey AS key, ['INCRBY', 'DECRBY', 'INCRBY', 'APPEND', 'EXPIRE', 'PERSIST', 'INCRBY', 'GETSET', 'NOPE'][1 + o_orderkey % 9] AS op, o_orderkey % 50 AS num, o_orderkey * 1000 AS ts, CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE 'x' END AS value FROM orders")
_COUNT_STATE = f"""WITH RECURSIVE steps AS ({_COUNTED}),
st AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS v, CAST(NULL AS BIGINT) AS ends, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS BIGINT) AS whole FROM steps
  UNION ALL
  SELECT key, i, seq,
    CASE op WHEN 'INCRBY' THEN CASE WHEN good THEN CAST(n + num AS VARCHAR) ELSE v END WHEN 'DECRBY' THEN CASE WHEN good THEN CAST(n - num AS VARCHAR) ELSE v END
            WHEN 'APPEND' THEN coalesce(v, '') || value WHEN 'GETSET' THEN value ELSE v END,
    CASE op WHEN 'EXPIRE' THEN CASE WHEN v IS NOT NULL THEN ts + num * 1000 END WHEN 'PERSIST' THEN NULL WHEN 'GETSET' THEN NULL ELSE ends END, op,
    CASE op WHEN 'INCRBY' THEN good WHEN 'DECRBY' THEN good WHEN 'APPEND' THEN true WHEN 'GETSET' THEN true WHEN 'EXPIRE' THEN v IS NOT NULL WHEN 'PERSIST' THEN ends IS NOT NULL ELSE false END,
    CASE op WHEN 'INCRBY' THEN CASE WHEN good THEN n + num END WHEN 'DECRBY' THEN CASE WHEN good THEN n - num END WHEN 'APPEND' THEN length(coalesce(v, '') || value) END
  FROM (SELECT l.key, l.i, l.seq, l.op, l.num, l.ts, l.value, CASE WHEN live THEN v END AS v, CASE WHEN live THEN ends END AS ends,
               (NOT live) OR regexp_matches(v, '^[+-]?[0-9]+$') AND TRY_CAST(v AS BIGINT) IS NOT NULL AS good, coalesce(CASE WHEN live THEN TRY_CAST(v AS BIGINT) END, 0) AS n
        FROM (SELECT st.key AS k, st.i AS i0, v, ends, v IS NOT NULL AS has FROM st) JOIN steps l ON l.key = k AND l.i = i0 + 1,
        LATERAL (SELECT has AND (ends IS NULL OR ends > l.ts) AS live)))"""


def _counted(s, d):
    op = _one_of("INCRBY", "DECRBY", "INCRBY", "APPEND", "EXPIRE", "PERSIST", "INCRBY", "GETSET", "NOPE")
    value = F.when(F.col("o_orderkey") % 2 == 0, "7").otherwise("x")
    return _log(ks.table(s, d, "orders"), op, key="n:", num=F.col("o_orderkey") % 50, value=value)


@query(_COUNT_STATE + " SELECT key, max_by(v, i) AS value, max_by(ends, i) AS expires_at_ms FROM (SELECT key, i, coalesce(v, '') AS v, coalesce(ends, -1) AS ends, v IS NOT NULL AS has FROM st) GROUP BY key HAVING max_by(has, i)")
def oplog_counters(s, d):
    return fold.state_after(_counted(s, d)).select("key", text("value"), F.coalesce("expires_at_ms", F.lit(-1).cast("long")).alias("expires_at_ms"))


@query(_COUNT_STATE + " SELECT seq, op, ok, whole FROM st WHERE i > 0")
def oplog_counter_replies(s, d):
    return fold.replies(_counted(s, d)).select("seq", "op", "ok", "whole")


# lists: pushes and pops on both sides
_LISTED = _STEPS.format(ops="SELECT o_orderkey AS seq, 'l:' || o_custkey AS key, ['LPUSH', 'RPUSH', 'RPOP', 'RPUSH', 'LPUSH', 'LPOP', 'LSET', 'LTRIM'][1 + o_orderkey % 8] AS op, 'v' || o_orderkey AS value FROM orders")
_LIST_STATE = f"""WITH RECURSIVE steps AS ({_LISTED}),
st AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS v, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS VARCHAR) AS answer FROM steps
  UNION ALL
  SELECT l.key, l.i, l.seq,
    CASE l.op WHEN 'LPUSH' THEN list_prepend(value, v) WHEN 'RPUSH' THEN list_append(v, value) WHEN 'RPOP' THEN v[1:-2] WHEN 'LPOP' THEN v[2:]
              WHEN 'LSET' THEN CASE WHEN len(v) > 0 THEN list_append(v[1:-2], value) ELSE v END ELSE v[1:4] END, l.op,
    CASE WHEN l.op IN ('RPOP', 'LPOP', 'LSET') THEN len(v) > 0 ELSE true END, CASE l.op WHEN 'RPOP' THEN v[-1] WHEN 'LPOP' THEN v[1] END
  FROM st JOIN steps l ON l.key = st.key AND l.i = st.i + 1)"""


def _listed(s, d):
    op = _one_of("LPUSH", "RPUSH", "RPOP", "RPUSH", "LPUSH", "LPOP", "LSET", "LTRIM")
    args = F.when(op == "LTRIM", F.create_map(F.lit("start"), F.lit("0"), F.lit("stop"), F.lit("3")))
    return _log(ks.table(s, d, "orders"), op, key="l:", num=F.lit(-1), value=F.concat(F.lit("v"), F.col("o_orderkey").cast("string")), args=args)


@query(_LIST_STATE + " SELECT key, CAST(k - 1 AS DOUBLE) AS num, v[k] AS value FROM (SELECT key, v, unnest(range(1, len(v) + 1)) AS k FROM (SELECT key, max_by(v, i) AS v FROM st GROUP BY key))")
def oplog_lists(s, d):
    return fold.state_after(_listed(s, d)).select("key", "num", text("value"))


@query(_LIST_STATE + " SELECT seq, op, ok, answer FROM st WHERE i > 0")
def oplog_list_replies(s, d):
    return fold.replies(_listed(s, d)).select("seq", "op", "ok", text("value", "answer"))


# sorted sets: conditional additions, increments, removals and pops of the least
_SCORED = _STEPS.format(ops="SELECT o_orderkey AS seq, 'z:' || o_custkey AS key, ['ZADD', 'ZADD', 'ZINCRBY', 'ZREM', 'ZADD', 'ZPOPMIN', 'ZPOPMAX'][1 + o_orderkey % 7] AS op, o_orderstatus AS m, CAST(o_orderkey % 40 AS DOUBLE) AS num, o_orderkey % 7 = 1 AS gt, o_orderkey % 7 = 4 AS nx FROM orders")
_SCORE_STATE = f"""WITH RECURSIVE steps AS ({_SCORED}),
st AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s DOUBLE, m VARCHAR)[]) AS v FROM steps
  UNION ALL
  SELECT key, i, CASE WHEN op = 'ZPOPMIN' THEN v[2:] WHEN op = 'ZPOPMAX' THEN v[1:-2] WHEN op = 'ZREM' THEN rest
                      WHEN op = 'ZINCRBY' THEN list_sort(list_append(rest, {{'s': coalesce(old, 0) + num, 'm': m}}))
                      WHEN (gt AND num <= old) OR (nx AND old IS NOT NULL) THEN v ELSE list_sort(list_append(rest, {{'s': num, 'm': m}})) END
  FROM (SELECT l.*, v, list_filter(v, lambda x: x.m <> l.m) AS rest, list_filter(v, lambda x: x.m = l.m)[1].s AS old
        FROM (SELECT key AS k, i AS i0, v FROM st) JOIN steps l ON l.key = k AND l.i = i0 + 1))"""


@query(_SCORE_STATE + " SELECT key, x.m AS member, x.s AS num FROM (SELECT key, unnest(v) AS x FROM (SELECT key, max_by(v, i) AS v FROM st GROUP BY key))")
def oplog_zsets(s, d):
    op = _one_of("ZADD", "ZADD", "ZINCRBY", "ZREM", "ZADD", "ZPOPMIN", "ZPOPMAX")
    args = F.when(F.col("o_orderkey") % 7 == 1, _flag("GT")).when(F.col("o_orderkey") % 7 == 4, _flag("NX"))
    log = _log(ks.table(s, d, "orders"), op, key="z:", num=F.col("o_orderkey") % 40, member=F.col("o_orderstatus"), args=args)
    return fold.state_after(log).select("key", text("member"), "num")


# hashes and sets: fields and members apart from each other
_FIELDS = "SELECT *, row_number() OVER (PARTITION BY key, m ORDER BY seq) AS i FROM (SELECT o_orderkey AS seq, 'h:' || o_custkey AS key, o_orderstatus AS m, ['HSET', 'HINCRBY', 'HDEL', 'HSET', 'HINCRBY'][1 + o_orderkey % 5] AS op, o_orderkey % 5 = 3 AS nx, CAST(o_orderkey % 30 AS VARCHAR) AS value, o_orderkey % 9 AS num FROM orders)"


@query(f"""WITH RECURSIVE steps AS ({_FIELDS}),
st AS (
  SELECT DISTINCT key, m, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS v FROM steps
  UNION ALL
  SELECT l.key, l.m, l.i, CASE l.op WHEN 'HDEL' THEN NULL WHEN 'HINCRBY' THEN CAST(coalesce(CAST(v AS BIGINT), 0) + num AS VARCHAR) ELSE CASE WHEN nx AND v IS NOT NULL THEN v ELSE value END END
  FROM st JOIN steps l ON l.key = st.key AND l.m = st.m AND l.i = st.i + 1)
SELECT key, m AS field, arg_max_null(v, i) AS value FROM st GROUP BY ALL HAVING value IS NOT NULL""")
def oplog_hashes(s, d):
    op = _one_of("HSET", "HINCRBY", "HDEL", "HSET", "HINCRBY")
    args = F.when(F.col("o_orderkey") % 5 == 3, _flag("NX"))
    log = _log(ks.table(s, d, "orders"), op, key="h:", num=F.col("o_orderkey") % 9, member=F.col("o_orderstatus"), value=(F.col("o_orderkey") % 30).cast("string"), args=args)
    return fold.state_after(log).select("key", text("member", "field"), text("value"))


@query("SELECT 's:' || o_custkey AS key, CAST(o_orderkey % 4 AS VARCHAR) AS member FROM orders GROUP BY ALL HAVING max_by(o_orderkey % 3 <> 2, o_orderkey)")
def oplog_sets(s, d):
    log = _log(ks.table(s, d, "orders"), _one_of("SADD", "SADD", "SREM"), key="s:", member=(F.col("o_orderkey") % 4).cast("string"))
    return fold.state_after(log).select("key", text("member"))


# files: logs, snapshots, transactions ----------------------------------------------------


def _folder(s, name: str) -> str:
    import uuid

    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _plain_log(s, d):
    return _log(ks.table(s, d, "orders"), F.lit("SET"), value=F.col("o_orderstatus")).select(*[c.split()[0] for c in OPLOG.replace("map<string,string>", "map").split(", ")])


@query("SELECT o_orderkey AS seq, 'c:' || o_custkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey >= 1000")
def wal_replay(s, d):
    """Two appends, read back from a seq on."""
    path, log = _folder(s, "log"), _plain_log(s, d)
    oplog.append(log.filter("seq % 2 = 0"), path)
    oplog.append(log.filter("seq % 2 = 1"), path)
    return oplog.replay(s, path, 1000).select("seq", "key", text("value"))


@query("SELECT o_orderkey AS seq FROM orders WHERE o_orderkey > 500")
def wal_truncate(s, d):
    path, new = _folder(s, "log"), _folder(s, "log")
    oplog.append(_plain_log(s, d), path)
    oplog.truncate(s, path, new, 500)
    return oplog.replay(s, new).select("seq")


@query("SELECT o_orderkey AS seq FROM orders WHERE o_orderkey > 700")
def wal_tail(s, d):
    path = _folder(s, "log")
    oplog.append(_plain_log(s, d), path)
    return oplog.tail(s, path, 700).select("seq")


@query("SELECT max(o_orderkey) - 100 AS lag FROM orders")
def replication_lag(s, d):
    return oplog.lag(_plain_log(s, d), 100)


@query("SELECT o_orderkey AS seq FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders) - 250")
def replication_ring(s, d):
    return oplog.ring(_plain_log(s, d), 250).select("seq")


@query("SELECT 'zset' AS name, key, member AS a, CAST(score AS VARCHAR) AS b FROM scores UNION ALL SELECT 'hash', key, field, value FROM hash")
def snapshot_loaded(s, d):
    """The newest of two snapshots, read back."""
    path = _folder(s, "snapshots")
    oplog.save_snapshot({"zset": ks.user_scores(s, d).limit(1)}, path, 1)
    oplog.save_snapshot({"zset": ks.user_scores(s, d), "hash": ks.hashes(s, d)}, path, 2)
    relations, _ = oplog.load_snapshot(s, path)
    z = relations["zset"].select(F.lit("zset").alias("name"), "key", text("member", "a"), F.col("score").cast("string").alias("b"))
    return z.unionByName(relations["hash"].select(F.lit("hash").alias("name"), "key", F.col("field").alias("a"), text("value", "b")))


@query("SELECT 3 AS seq, CAST(1 AS BIGINT) AS pruned")
def snapshot_retention(s, d):
    path = _folder(s, "snapshots")
    for seq in (1, 2, 3):
        oplog.save_snapshot({"region": ks.table(s, d, "region")}, path, seq)
    gone = oplog.prune_snapshots(s, path, 2)
    return s.createDataFrame([(oplog.load_snapshot(s, path)[1], gone)], "seq int, pruned long")


@query("SELECT key, value FROM live")
def export_strings(s, d):
    path = _folder(s, "export")
    oplog.export(strings.live(ks.kv(s, d), NOW), path, "lz4")
    return s.read.parquet(path).select("key", text("value"))


@query('SELECT room, "offset", event_id FROM room')
def export_rooms(s, d):
    path = _folder(s, "export")
    oplog.export(ks.room_events(s, d), path, "zstd")
    return s.read.parquet(path).select("room", "offset", "event_id")


@query('SELECT event_id, partition_id, "offset" FROM topic')
def export_topics(s, d):
    path = _folder(s, "export")
    oplog.export(ks.topic_events(s, d), path, "zstd")
    return s.read.parquet(path).select("event_id", "partition_id", "offset")


@query("SELECT count(*) AS rows, true AS same FROM customer")
def snapshot_checksum(s, d):
    """A relation and the copy read back from a file have the same checksum."""
    path, kv = _folder(s, "export"), ks.kv(s, d)
    oplog.export(kv, path)
    a, b = checks.checksum(kv), checks.checksum(s.read.parquet(path)).select(F.col("checksum").alias("other"))
    return a.join(b).select("rows", (F.col("checksum") == F.col("other")).alias("same"))


@query("SELECT unnest([1, 2, 3, 4]) AS seq, unnest(['a', 'b', 'a', 'c']) AS key, unnest(['first', 'first', 'third', 'third']) AS value")
def transaction_commits(s, d):
    """Three clients: the second watched a key that the first changed, the third saw its change and commits."""
    path = _folder(s, "log")
    s.createDataFrame([], OPLOG).write.parquet(path)
    first, second, third = (transactions.Transaction(s, path) for _ in range(3))
    second.watch(["a"])
    for client, keys, value in ((first, "ab", b"first"), (second, "ab", b"second")):
        client.multi()
        for key in keys:
            client.queue("SET", key, value=value)
        client.exec(0)
    third.watch(["a"])
    third.unwatch()
    third.multi()
    third.queue("SET", "x", value=b"dropped")
    third.discard()
    third.multi()
    third.queue("SET", "a", value=b"third")
    third.queue("SET", "c", value=b"third")
    third.exec(0)
    return s.read.schema(OPLOG).parquet(path).select(F.col("seq").cast("int").alias("seq"), "key", text("value"))


@query("SELECT 'c:' || o_custkey AS key, max(o_orderkey) AS version FROM orders WHERE o_custkey < 20 GROUP BY 1")
def transaction_versions(s, d):
    named = [f"c:{k}" for k in range(20)]
    found = transactions.versions(_plain_log(s, d), named)
    return s.createDataFrame([(k, v) for k, v in found.items() if v >= 0], "key string, version long")


def _keys_sum(call, keys, args):
    return {"keys": len(keys), "sum": sum(int(a) for a in args)}


@query("SELECT 2 AS keys, 6 AS sum, true AS known, 1 AS flushed")
def script_calls(s, d):
    engine = scripts.Scripts(lambda *a: None)
    sha = engine.load(_keys_sum)
    answer, known = engine.evalsha(sha, ["a", "b"], ["1", "2", "3"]), engine.exists(sha)[0]
    return s.createDataFrame([(answer["keys"], answer["sum"], known, engine.flush())], "keys int, sum int, known boolean, flushed int")


# placement, quotas and rules -------------------------------------------------------------

_OWNED = [("n0", 0, 5460), ("n1", 5461, 10921), ("n2", 10922, 16000)]
_CRC = ", ".join(map(str, slots.CRC16))
#: DuckDB's own fold over a key's bytes.
_SLOT = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(tag, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: xor((crc << 8) & 65535, list_extract([{_CRC}], CAST(xor(crc >> 8, b) AS INT) + 1))) % 16384"
_SLOTTED = f"SELECT key, CAST({_SLOT} AS INT) AS slot FROM (SELECT '{{' || c_nationkey || '}}:' || c_custkey AS key, CAST(c_nationkey AS VARCHAR) AS tag FROM customer)"


@query(f"SELECT key, slot, CAST(least(slot // 5461, 2) AS INT) AS node FROM ({_SLOTTED})")
def slot_of_keys(s, d):
    """CRC16 slots of tagged keys, and the node each is on."""
    keys = ks.tagged_keys(s, d)
    return keys.select("key", slots.hash_slot(F.col("key")).alias("slot")).withColumn("node", slots.even_owner(F.col("slot"), 3))


@query(f"SELECT key FROM ({_SLOTTED}) WHERE slot = (SELECT any_value(slot) FROM ({_SLOTTED}) WHERE starts_with(key, '{{7}}'))")
def slot_keys(s, d):
    wanted = s.createDataFrame([("7",)], "key string").select(slots.hash_slot(F.col("key"))).first()[0]
    return governance.keys_in_slot(ks.tagged_keys(s, d), wanted)


@query("SELECT * FROM (VALUES ('n0', 0, 5460), ('n1', 5461, 10921), ('n2', 10922, 16000), ('n3', 16001, 16383)) v(node, first, last)")
def slot_assign(s, d):
    return governance.assign_slots(s.createDataFrame(_OWNED, "node string, first int, last int"), "n3", 16001, 16383)


@query("SELECT CAST(16001 AS DOUBLE) / 16384 AS coverage, false AS full")
def slot_coverage(s, d):
    return governance.slot_coverage(s.createDataFrame(_OWNED, "node string, first int, last int"))


_MARKS = "SELECT c_custkey AS seq, CAST(c_custkey % 60 AS INT) AS slot, 'n' || c_nationkey % 3 AS f, 'n' || (c_nationkey + 1) % 3 AS t, CASE WHEN (c_custkey // 60) % 2 = 0 OR c_custkey % 5 = 0 THEN 'start' ELSE 'complete' END AS op FROM customer"


def _marks(s, d):
    c = ks.table(s, d, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    op = F.when((F.floor(key / 60) % 2 == 0) | (key % 5 == 0), "start").otherwise("complete")
    return c.select(key.alias("seq"), (key % 60).cast("int").alias("slot"), F.concat(F.lit("n"), (nation % 3).cast("string")).alias("from_node"), F.concat(F.lit("n"), ((nation + 1) % 3).cast("string")).alias("to_node"), op.alias("op"))


@query(f"SELECT slot, CASE WHEN s IS NOT NULL THEN s.f ELSE w.f END AS from_node, CASE WHEN s IS NOT NULL THEN s.t ELSE w.t END AS to_node, CASE WHEN s IS NOT NULL THEN 'migrating' ELSE 'complete' END AS state FROM (SELECT slot, min_by({{'f': f, 't': t}}, seq) FILTER (op = 'start' AND (done IS NULL OR seq > done)) AS s, max_by({{'f': f, 't': t}}, seq) FILTER (op = 'start') AS w, any_value(done) AS d FROM (SELECT *, max(seq) FILTER (op = 'complete') OVER (PARTITION BY slot) AS done FROM ({_MARKS})) GROUP BY slot) WHERE s IS NOT NULL OR (d IS NOT NULL AND w IS NOT NULL)")
def slot_migrations(s, d):
    return governance.migrations(_marks(s, d))


@query(f"SELECT key, slot, node AS owner, CASE WHEN node IS NULL THEN 'down' WHEN node = 'n1' AND slot = 5500 THEN 'ask n2' WHEN node = 'n1' THEN 'ok' ELSE 'moved ' || node END AS answer FROM (SELECT key, slot, CASE WHEN slot <= 5460 THEN 'n0' WHEN slot <= 10921 THEN 'n1' WHEN slot <= 16000 THEN 'n2' END AS node FROM ({_SLOTTED}))")
def slot_routed(s, d):
    moving = s.createDataFrame([(5500, "n1", "n2", "migrating"), (5501, "n1", "n2", "complete")], "slot int, from_node string, to_node string, state string")
    return governance.routed(ks.tagged_keys(s, d), s.createDataFrame(_OWNED, "node string, first int, last int"), "n1", moving)


_RULES = [("u1", "events.*", "read", True), ("*", "events.error.*", "read", False), ("u2", "*", "*", True), ("u1", "events.click.user7", "write", True), ("u2", "events.view.user1", "read", False)]


@query("SELECT id, u AS \"user\", topic AS resource, a AS action, CASE WHEN u = 'u2' THEN NOT (a = 'read' AND (topic = 'events.view.user1' OR starts_with(topic, 'events.error.'))) WHEN u = 'u1' AND a = 'read' THEN NOT starts_with(topic, 'events.error.') WHEN u = 'u1' THEN topic = 'events.click.user7' ELSE false END AS allowed FROM (SELECT *, 'u' || id % 3 AS u, CASE WHEN id % 2 = 0 THEN 'read' ELSE 'write' END AS a FROM message)")
def acl_allowed(s, d):
    m = ks.pubsub_messages(s, d)
    asked = m.select("id", F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("user"), F.col("topic").alias("resource"), F.when(F.col("id") % 2 == 0, "read").otherwise("write").alias("action"))
    return governance.allowed(asked, s.createDataFrame(_RULES, "user string, resource string, action string, allow boolean"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"user\", CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(40 AS BIGINT) AS max_operations, coalesce(n, 0) < 40 AS fits FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def quota_operations(s, d):
    used = ks.table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("user"))
    limits = ks.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("user"), F.lit(40).cast("long").alias("max_operations"))
    return governance.operations_quota(used, limits)


@query("""WITH RECURSIVE asked AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT DISTINCT user_id, ts FROM events)),
st AS (
  SELECT client, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS t, CAST(2 AS DOUBLE) AS left_, true AS ok FROM asked WHERE i = 1
  UNION ALL
  SELECT a.client, a.i, a.t, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1
  FROM (SELECT client AS c, i AS i0, t AS t0, left_ FROM st) JOIN asked a ON a.client = c AND a.i = i0 + 1, LATERAL (SELECT CASE WHEN t0 IS NULL THEN 2 ELSE least(2, left_ + (a.t / 1e6 - t0 / 1e6) * 0.00001) END AS have))
SELECT client, t AS micros, ok AS allowed FROM st WHERE i > 0""")
def rate_limited(s, d):
    e = ks.table(s, d, "events").select(F.col("user_id").cast("string").alias("client"), "ts").distinct().withColumn("tokens", F.lit(1.0))
    return governance.allowed_by_bucket(e, 0.00001, 2).select("client", F.unix_micros("ts").alias("micros"), "allowed")


@query("SELECT key, size FROM (SELECT 'order:' || o_orderkey AS key, CAST(o_totalprice AS BIGINT) AS size, o_orderkey % 5 AS freq FROM orders) QUALIFY coalesce(sum(size) OVER (ORDER BY freq, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= sum(size) OVER () * 0.4 - 0.5")
def evict_lfu_ties(s, d):
    """Few frequencies, so that most keys tie: three fifths of the bytes stay."""
    o = ks.table(s, d, "orders")
    entries = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), F.rint("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 5).alias("freq"), F.lit(None).cast("long").alias("expires_at_ms"), F.lit(0).cast("long").alias("last_access"))
    total = entries.agg(F.sum("size")).first()[0]
    return governance.evict(entries, "allkeys-lfu", total - -(-(total * 2 - 2) // 5)).select("key", "size")


@query("SELECT key, value, result, put FROM (SELECT key, substr(value, 1, 1) AS value, least(2047, w + 1000) AS result, w FROM (SELECT key, value, CASE WHEN raw >= 2048 THEN raw - 4096 ELSE raw END AS w FROM (SELECT key, value, ((ascii(substr(value, 1, 1)) + 256 * ascii(substr(value, 2, 1))) >> 4) & 4095 AS raw FROM kv))), LATERAL (SELECT 'A' AS put)")
def bitmap_bitfield(s, d):
    """GET, SET and INCRBY on fields of customers' names."""
    c = ks.kv(s, d).select("key", "value")
    added = bits.field_incrby(F.col("value"), 4, 12, True, 1000, "SAT")
    put = F.substring(bits.field_set(F.col("value"), 0, 8, 65), 1, 1)
    return c.select("key", F.substring("value", 1, 1).cast("string").alias("value"), added["result"].alias("result"), put.cast("string").alias("put"))


@query("SELECT key, get.value AS got FROM (SELECT key, {'value': CASE WHEN raw >= 2048 THEN raw - 4096 ELSE raw END} AS get FROM (SELECT key, ((ascii(substr(value, 1, 1)) + 256 * ascii(substr(value, 2, 1))) >> 4) & 4095 AS raw FROM kv))")
def bitmap_bitfield_get(s, d):
    return ks.kv(s, d).select("key", bits.field_get(F.col("value"), 4, 12, True).alias("got"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.v') AS VARCHAR) AS v, json_valid(props) AS valid FROM events")
def json_payloads(s, d):
    """Values that are JSON, and a field of theirs."""
    e = ks.table(s, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.v").alias("v"), F.get_json_object("props", "$").isNotNull().alias("valid"))


# queues ----------------------------------------------------------------------------------

_QUEUE = """WITH m AS (SELECT o_orderstatus AS queue, o_orderkey AS k, 'order-' || o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_orderpriority[1] AS INT), o_orderkey) - 1 AS place, 11 - 2 * CAST(o_orderpriority[1] AS INT) AS priority FROM orders),
n AS (SELECT queue, count(*) FILTER (k % 2 = 0) AS c1, count(*) FILTER (k % 4 = 0) AS c2 FROM m GROUP BY queue),
one AS (SELECT m.*, c1, c2, place < c1 AS held, CASE WHEN place >= c1 THEN 'ready' WHEN k % 6 = 0 THEN 'acked' WHEN k % 6 = 2 THEN 'back' WHEN k % 6 = 4 THEN 'dropped' ELSE 'late' END AS fate FROM m JOIN n USING (queue)),
line AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY CASE fate WHEN 'ready' THEN 0 WHEN 'back' THEN 1 ELSE 2 END, CASE WHEN fate = 'ready' THEN place WHEN fate = 'back' THEN k ELSE 0 END, id) - 1 AS spot, CASE WHEN fate = 'ready' THEN 0 ELSE 1 END AS tries FROM one WHERE fate IN ('ready', 'back', 'late')),
two AS (SELECT *, spot < c2 AS again FROM line)"""

_QUEUE_OUT = """
SELECT queue, k AS seq, 'publish' AS op, id, 'published' AS outcome, 0 AS retry_count FROM m
UNION ALL SELECT queue, seq + 10000000, 'consume', o.id, 'delivered', 0 FROM (SELECT queue, k AS seq, row_number() OVER (PARTITION BY queue ORDER BY k) - 1 AS nth FROM m WHERE k % 2 = 0) JOIN one o USING (queue) WHERE o.place = nth
UNION ALL SELECT queue, k + 20000000, 'ack', id, CASE WHEN held THEN 'acked' ELSE 'not found' END, NULL FROM one WHERE k % 6 = 0
UNION ALL SELECT queue, k + 30000000, 'nack', id, CASE WHEN held THEN 'requeued' ELSE 'not found' END, NULL FROM one WHERE k % 6 = 2
UNION ALL SELECT queue, k + 40000000, 'nack', id, CASE WHEN held THEN 'dropped' ELSE 'not found' END, NULL FROM one WHERE k % 6 = 4
UNION ALL SELECT queue, seq + 50000000, 'consume', t.id, CASE WHEN t.id IS NULL THEN 'empty' ELSE 'delivered' END, t.tries FROM (SELECT queue, k AS seq, row_number() OVER (PARTITION BY queue ORDER BY k) - 1 AS nth FROM m WHERE k % 4 = 0) c LEFT JOIN two t ON t.queue = c.queue AND t.spot = nth
UNION ALL SELECT o.queue, o.k + 60000000, 'nack', o.id, CASE WHEN again THEN CASE WHEN tries = 1 THEN 'dead' ELSE 'requeued' END ELSE 'not found' END, NULL FROM one o LEFT JOIN two t ON t.queue = o.queue AND t.k = o.k WHERE o.k % 6 = 2"""


def _limits():
    return queues.Limits(ack_deadline_secs=30, max_depth=1 << 40)


@query(f"{_QUEUE} {_QUEUE_OUT.replace('SELECT queue, seq +', 'SELECT c.queue, c.seq +', 2).replace('SELECT c.queue, c.seq + 10000000', 'SELECT queue, seq + 10000000')}")
def queue_outcomes(s, d):
    return queues.outcomes(ks.queue_operations(s, d), _limits())


@query(f"""{_QUEUE},
left_ AS (SELECT *, CASE WHEN NOT again THEN 'ready' WHEN k % 6 <> 2 THEN 'pending' WHEN tries = 1 THEN 'dead' ELSE 'ready' END AS state FROM two)
SELECT queue, id, state, CAST(row_number() OVER (PARTITION BY queue, state ORDER BY CASE WHEN again AND state = 'ready' THEN 1 ELSE 0 END, CASE WHEN k % 6 = 2 AND again THEN k ELSE spot END) - 1 AS INT) AS place, priority,
       CAST(tries + CASE WHEN again AND k % 6 = 2 THEN 1 ELSE 0 END AS INT) AS retry_count, CASE WHEN state = 'pending' THEN 'c2' END AS consumer_id, CASE WHEN state = 'pending' THEN 70 END AS ack_deadline FROM left_""")
def queue_state(s, d):
    return queues.state_after(ks.queue_operations(s, d), _limits())


@query(f"{_QUEUE}, told AS ({_QUEUE_OUT.replace('SELECT queue, seq +', 'SELECT c.queue, c.seq +', 2).replace('SELECT c.queue, c.seq + 10000000', 'SELECT queue, seq + 10000000')}) SELECT queue, count(*) FILTER (outcome = 'published') AS published, count(*) FILTER (outcome = 'delivered') AS consumed, count(*) FILTER (outcome = 'acked') AS acked, count(*) FILTER (op = 'nack' AND outcome IN ('requeued', 'dropped', 'dead')) AS nacked, count(*) FILTER (outcome = 'dead') AS dead_lettered FROM told GROUP BY queue")
def queue_stats(s, d):
    return queues.stats(queues.outcomes(ks.queue_operations(s, d), _limits()))


@query("SELECT DISTINCT o_orderstatus AS queue FROM orders")
def queue_list(s, d):
    return queues.names(ks.queue_operations(s, d))


@query("SELECT o_orderstatus AS queue, count(*) AS purged FROM orders GROUP BY 1")
def queue_purge(s, d):
    """All that is ready of each queue is purged, and nothing is left."""
    m = ks.queue_operations(s, d).filter("op = 'publish'")
    last = m.groupBy("queue").agg((F.max("seq") + 1).alias("seq")).select("queue", "seq", F.lit(1).cast("long").alias("now"), F.lit("purge").alias("op"))
    told = queues.outcomes(m.unionByName(last, allowMissingColumns=True), _limits()).filter("op = 'purge'")
    return told.select("queue", F.regexp_extract("outcome", r"purged (\d+)", 1).cast("long").alias("purged"))


# the log's string operations, by a recursion ---------------------------------------------

_SETS = _STEPS.format(ops="SELECT o_orderkey AS seq, 'c:' || o_custkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'DEL' ELSE 'SET' END AS op, o_orderkey % 5 = 0 AS nx, o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AS keep, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN o_orderkey * 1000 + 500000 END AS until_ms, o_orderstatus AS value, o_orderkey * 1000 AS ts FROM orders")
_SET_STATE = f"""WITH RECURSIVE steps AS ({_SETS}),
st AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS v, CAST(NULL AS BIGINT) AS ends, CAST(NULL AS BOOLEAN) AS ok FROM steps
  UNION ALL
  SELECT key, i, seq, op, CASE WHEN op = 'DEL' THEN NULL WHEN nx AND v IS NOT NULL THEN v ELSE value END,
         CASE WHEN op = 'DEL' THEN NULL WHEN nx AND v IS NOT NULL THEN ends WHEN keep THEN ends ELSE until_ms END, CASE WHEN op = 'DEL' THEN v IS NOT NULL ELSE NOT (nx AND v IS NOT NULL) END
  FROM (SELECT l.*, CASE WHEN live THEN v END AS v, CASE WHEN live THEN ends END AS ends
        FROM (SELECT key AS k, i AS i0, v, ends FROM st) JOIN steps l ON l.key = k AND l.i = i0 + 1, LATERAL (SELECT v IS NOT NULL AND (ends IS NULL OR ends > l.ts) AS live)))"""
_SET_LEFT = _SET_STATE + " SELECT key, 'string' AS type, arg_max_null(v, i) AS value, arg_max_null(ends, i) AS expires_at_ms FROM st GROUP BY key HAVING value IS NOT NULL"


def _oplog(s, d):
    from .queries import oplog_of

    return oplog_of(s, d)


@query(_SET_LEFT)
def oplog_state(s, d):
    return fold.state_after(_oplog(s, d)).select("key", "type", text("value"), "expires_at_ms")


@query(_SET_STATE + " SELECT seq, key, op, ok FROM st WHERE i > 0")
def oplog_replies(s, d):
    return fold.replies(_oplog(s, d)).select("seq", "key", "op", "ok")


@query(_SET_LEFT)
def oplog_recovered(s, d):
    """State from a snapshot at the middle of the log and its tail: the same as the whole fold's."""
    log = _oplog(s, d)
    middle = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    state = fold.state_after(log.filter(F.col("seq") <= middle))
    return fold.recover(state, log.filter(F.col("seq") > middle)).select("key", "type", text("value"), "expires_at_ms")


# hashes of values ------------------------------------------------------------------------


def _crc_table(polynomial: int) -> list[int]:
    """The table of a reflected CRC, for the SQL side."""
    out = []
    for byte in range(256):
        crc = byte
        for _ in range(8):
            crc = crc >> 1 ^ polynomial if crc & 1 else crc >> 1
        out.append(crc)
    return out


def _crc_sql(text_of: str, polynomial: int, bits_of: int) -> str:
    whole = (1 << bits_of) - 1
    table = ", ".join(map(str, _crc_table(polynomial)))
    letters = f"list_transform(string_split({text_of}, ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    step = f"lambda crc, b: xor(crc >> 8, list_extract(CAST([{table}] AS UBIGINT[]), CAST(xor(crc, b) & 255 AS INT) + 1))"
    return f"xor(list_reduce(list_prepend(CAST({whole} AS UBIGINT), {letters}), {step}), CAST({whole} AS UBIGINT))"


@query(f"SELECT event_id, CAST({_crc_sql('CAST(user_id AS VARCHAR)', 0xEDB88320, 32)} % 8 AS INT) AS partition_id FROM events")
def topic_crc32(s, d):
    """The partition of each event's key, by CRC32."""
    e = ks.table(s, d, "events")
    return e.select("event_id", rooms.partition_by_crc32(F.col("user_id").cast("string").cast("binary"), 8).alias("partition_id"))


@query(f"SELECT c_custkey AS key, lower(lpad(to_hex({_crc_sql('c_name', 0xC96C5795D7870F42, 64)}), 16, '0')) AS crc FROM customer")
def value_crc64(s, d):
    c = ks.table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("key"), checks.crc64(F.col("c_name").cast("binary")).alias("crc"))


@query("SELECT c_custkey AS key, sha1(c_name) AS sha FROM customer")
def value_sha1(s, d):
    """What scripts are named by."""
    return ks.table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.sha1(F.col("c_name").cast("binary")).alias("sha"))


# streams: run until they have read all there is ------------------------------------------


def _streamed(s, d, name):
    """A table read as a stream of its files."""
    return s.readStream.schema(ks.table(s, d, name).schema).parquet(f"{d}/{name}*.parquet")


def _arrived(s, df):
    out = _folder(s, "stream")
    jobs.run_once(df, f"{out}/rows", f"{out}/checkpoint")
    return s.read.schema(df.schema).parquet(f"{out}/rows")


@query('SELECT room, event_id, "offset" FROM room')
def stream_offsets(s, d):
    """Offsets given as events arrive; one batch here, so in the order of the log."""
    e = _streamed(s, d, "events").select(F.col("event_type").alias("room"), "event_id", "ts")
    return _arrived(s, jobs.assign_offsets(e, ["ts", "event_id"])).select("room", "event_id", "offset")


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_type = 'view' AND event_id >= 10")
def stream_observed_events(s, d):
    e = _streamed(s, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("room"), F.col("event_type").alias("event"), F.col("event_id").alias("offset"))
    return _arrived(s, jobs.observe_events(e, "7", "view", 10)).select("event_id", "event_type")


@query("SELECT id, topic FROM message WHERE topic = 'events.view.user1' OR regexp_matches(topic, '^events\\.error(\\..*)?$')")
def stream_observed_topics(s, d):
    topic = F.concat(F.lit("events."), "event_type", F.lit(".user"), F.col("user_id").cast("string"))
    m = _streamed(s, d, "events").select(F.col("event_id").alias("id"), topic.alias("topic"))
    return _arrived(s, jobs.observe_topics(m, ["events.view.user1", "events.error.#"]))


@query("SELECT event_id, 'all' AS sink FROM events UNION ALL SELECT event_id, 'clicks' FROM events WHERE event_type = 'click'")
def stream_fanned_out(s, d):
    """One stream, two sinks."""
    out = _folder(s, "stream")
    every = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/all/{n}")
    clicks = lambda batch, n: batch.filter("event_type = 'click'").write.mode("overwrite").parquet(f"{out}/clicks/{n}")
    jobs.fan_out(_streamed(s, d, "events").select("event_id", "event_type"), [every, clicks], f"{out}/checkpoint")
    read = lambda sink: s.read.option("recursiveFileLookup", "true").parquet(f"{out}/{sink}").select("event_id", F.lit(sink).alias("sink"))
    return read("all").unionByName(read("clicks"))


@query("SELECT o_orderstatus AS queue, 'order-' || o_orderkey AS id, 'published' AS outcome FROM orders")
def stream_queue_outcomes(s, d):
    """Orders published to their queues as they arrive, each message an entry of its queue's state."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    o = _streamed(s, d, "orders")
    null = F.lit(None)
    ops = o.select(
        F.col("o_orderstatus").alias("queue"), F.col("o_orderkey").alias("seq"), F.lit(0).cast("long").alias("now"), F.lit("publish").alias("op"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("id"), null.cast("string").alias("consumer_id"),
        null.cast("binary").alias("payload"), F.lit(5).alias("priority"), F.lit(1).alias("max_retries"), null.cast("boolean").alias("requeue"),
    )
    return _arrived(s, jobs.fold_queues(ops, _limits())).select("queue", "id", "outcome")
