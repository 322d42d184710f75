"""Small literal cases of the collection types."""

import pytest
from pyspark.sql import functions as F

from keyweave.operators import bitmaps, geosets, governance, hashes, hll, keyspace, lists, paging, sets, strings, zsets


def rows(df, *columns):
    return sorted(tuple(bytes(x).decode() if isinstance(x, (bytes, bytearray)) else x for x in r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def z(spark):
    return spark.createDataFrame([("z1", b"a", 1.0), ("z1", b"b", 2.0), ("z1", b"c", 3.0), ("z2", b"b", 4.0), ("z2", b"c", 5.0), ("z2", b"d", 6.0)], "key string, member binary, score double")


def test_zset_algebra(z):
    assert rows(zsets.zinter(z, ["z1", "z2"])) == [("b", 6.0), ("c", 8.0)]
    assert rows(zsets.zunion(z, ["z1", "z2"], aggregate="MIN")) == [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 6.0)]
    assert rows(zsets.zunion(z, ["z1", "z2"], aggregate="MAX")) == [("a", 1.0), ("b", 4.0), ("c", 5.0), ("d", 6.0)]
    assert rows(zsets.zdiff(z, ["z1", "z2"])) == [("a", 1.0)]
    assert rows(zsets.zinter(z, ["z1", "absent"])) == []


def test_zset_weights(spark):
    two = spark.createDataFrame([("x", b"a", 10.0), ("y", b"a", 5.0)], "key string, member binary, score double")
    assert rows(zsets.zinter(two, ["x", "y"], [2, 3])) == [("a", 35.0)]


def test_zset_order_and_ranges(spark, z):
    odd = spark.createDataFrame([("k", b"n", float("nan")), ("k", b"b", 1.0), ("k", b"a", 1.0)], "key string, member binary, score double")
    assert [bytes(r.member) for r in zsets.zrank(odd).orderBy("rank").collect()] == [b"n", b"a", b"b"]
    assert rows(zsets.zrange(z, -2, -1).filter("key = 'z1'"), "member") == [("b",), ("c",)]
    assert rows(zsets.zrange(z, 5, 9)) == []
    assert rows(zsets.zpopmin(z, 1)[0], "key", "member") == [("z1", "a"), ("z2", "b")]
    assert rows(zsets.zremrangebyrank(z, 0, 0), "key", "member") == [("z1", "b"), ("z1", "c"), ("z2", "c"), ("z2", "d")]


def test_zadd_options(spark, z):
    new = spark.createDataFrame([("z1", b"a", 9.0), ("z1", b"q", 7.0)], "key string, member binary, score double")
    after = lambda **o: {bytes(r.member): r.score for r in zsets.zadd(z, new, **o).filter("key = 'z1'").collect()}
    assert after() == {b"a": 9.0, b"b": 2.0, b"c": 3.0, b"q": 7.0}
    assert after(nx=True)[b"a"] == 1.0 and after(nx=True)[b"q"] == 7.0
    assert b"q" not in after(xx=True)
    assert after(lt=True)[b"a"] == 1.0 and after(gt=True)[b"a"] == 9.0
    assert after(incr=True)[b"a"] == 10.0


def test_list_commands(spark):
    li = spark.createDataFrame([("l", i, v) for i, v in enumerate([b"one", b"two", b"three", b"two"])], "key string, idx long, value binary")
    assert rows(lists.pop(li)[0], "value") == [("one",)] and rows(lists.pop(li, right=True)[0], "value") == [("two",)]
    removed, rest = lists.lrem(li, -1, b"two")
    assert rows(removed) == [("l", 1)] and [r[2] for r in rows(rest)] == ["one", "two", "three"]
    assert [r[2] for r in rows(lists.linsert(li, b"two", b"new", before=False))] == ["one", "two", "new", "three", "two"]
    new = spark.createDataFrame([("l", b"a", 1), ("l", b"b", 2)], "key string, value binary, seq int")
    assert [r[2] for r in rows(lists.push(li, new, left=True))][:2] == ["b", "a"]
    assert [r[2] for r in rows(lists.rpoplpush(li, "l", "l"))] == ["two", "one", "two", "three"]
    assert rows(lists.lindex(li, -2), "value") == [("three",)] and rows(lists.lindex(li, 9)) == []
    assert rows(lists.lpos(li, "two")) == [("l", 1)]
    assert [r[2] for r in rows(lists.lset(li, -1, b"end"))][-1] == "end"
    assert rows(lists.nested(li).select(F.size("values"))) == [(4,)]


def test_hash_commands(spark):
    h = spark.createDataFrame([("u", "name", b"Alice"), ("u", "age", b"30"), ("v", "name", b"Bob")], "key string, field string, value binary")
    assert rows(hashes.hmget(h, ["name", "none"])) == [("u", "Alice", None), ("v", "Bob", None)]
    assert rows(hashes.hincrby(h, spark.createDataFrame([("u", "age", 5)], "key string, field string, num int"))) == [("u", "age", 35)]
    with pytest.raises(Exception):
        hashes.hincrby(h, spark.createDataFrame([("u", "name", 5)], "key string, field string, num int")).collect()
    page = hashes.hscan(h, 0, 1, "n*").collect()  # the window is cut before the pattern applies
    assert [(r.key, r.next_cursor) for r in page] == [("v", 0)]


def test_set_commands(spark):
    s = spark.createDataFrame([("f", b"apple"), ("f", b"banana"), ("f", b"cherry"), ("g", b"banana")], "key string, member binary")
    assert rows(sets.sinter(s, ["f", "g"])) == [("banana",)] and rows(sets.sinter(s, ["f", "absent"])) == []
    assert rows(sets.sdiff(s, ["f", "g"])) == [("apple",), ("cherry",)]
    assert rows(sets.smove(s, "f", "g", b"apple"), "key", "member")[-2:] == [("g", "apple"), ("g", "banana")]
    assert rows(sets.smove(s, "f", "g", b"absent")) == rows(s)
    added, after = sets.sadd(s, spark.createDataFrame([("g", b"apple"), ("g", b"banana"), ("g", b"apple")], "key string, member binary"))
    assert rows(added) == [("g", 1)] and after.count() == 5
    assert len(rows(sets.srandmember(s, 2, seed=1))) == 3


def test_strings(spark):
    kv = spark.createDataFrame([("a", b"hello", None), ("b", b"x", 1000), ("c", b"42", 999)], "key string, value binary, expires_at_ms long")
    assert rows(strings.keys(kv, 999)) == [("a",), ("b",)]  # expiry is inclusive
    assert rows(strings.mget(kv, ["b", "zz", "a"], 500), "pos", "value") == [(0, "x"), (1, None), (2, "hello")]
    r = kv.filter("key = 'a'").select(strings.set_range(F.col("value"), 7, b"!"), strings.get_range(F.col("value"), -3, -2), strings.get_range(F.col("value"), 4, 2)).first()
    assert [bytes(x) for x in r] == [b"hello\0\0!", b"ll", b""]
    assert [r[0] for r in kv.select(strings.as_integer(F.col("value"))).collect()] == [None, None, 42]
    assert rows(strings.ttl(kv, 500)) == [("a", None, None), ("b", 0, 500), ("c", 0, 499)]
    pairs = spark.createDataFrame([("a", b"1"), ("n", b"2")], "key string, value binary")
    assert rows(strings.mset_nx(kv, pairs, 500), "key") == [("a",), ("b",), ("c",)]
    deltas = spark.createDataFrame([("k", 1 << 62), ("k", 1 << 62)], "key string, num long")
    with pytest.raises(Exception):  # a counter overflows
        strings.incremented(deltas).collect()


def test_bitmaps(spark):
    b = spark.createDataFrame([("x", 0), ("x", 1), ("x", 3), ("y", 1), ("y", 9)], "key string, offset long")
    assert rows(bitmaps.bitop(b, "AND", ["x", "y"])) == [(1,)]
    assert rows(bitmaps.bitop(b, "XOR", ["x", "y"])) == [(0,), (3,), (9,)]
    assert rows(bitmaps.bitop(b, "NOT", ["x"])) == [(2,), (4,), (5,), (6,), (7,)]
    assert rows(bitmaps.bitpos(b, 0)) == [("x", 2), ("y", 0)]
    assert rows(bitmaps.bitpos(b, 1, 2)) == [("x", 3), ("y", 9)]
    assert rows(bitmaps.bitpos(b, 1, 4, 8)) == [("x", None), ("y", None)]
    assert rows(bitmaps.dense_count(bitmaps.dense(b))) == [("x", 3), ("y", 2)]
    for op, keys in (("AND", ["x"]), ("NOT", ["x", "y"])):
        with pytest.raises(ValueError):
            bitmaps.bitop(b, op, keys)


def test_sketches(spark):
    e = spark.createDataFrame([("p", "user:a"), ("p", "user:b"), ("q", "user:c"), ("q", "user:d"), ("q", "user:a")], "key string, element string")
    merged = hll.pfmerge(hll.pfadd(e), "p", ["q"])
    assert rows(hll.pfcount(merged)) == [("p", 4), ("q", 3)]
    assert rows(hll.pfcount(hll.pfadd(e), ["p", "q"])) == [(4,)]


def test_geo(spark):
    given = [("c", b"sf", 37.7749, -122.4194), ("c", b"ny", 40.7128, -74.0060), ("c", b"la", 34.0522, -118.2437), ("c", b"oak", 37.8044, -122.2711)]
    g = geosets.geoadd(spark.createDataFrame(given, "key string, member binary, lat double, lon double"))
    assert [bytes(r.member) for r in geosets.georadius(g, 37.7749, -122.4194, 50, "km").collect()] == [b"sf", b"oak"]
    assert [bytes(r.member) for r in geosets.georadiusbymember(g, "c", b"sf", 600, "km", descending=True).collect()] == [b"la", b"oak", b"sf"]
    assert [bytes(r.member) for r in geosets.geosearch_box(g, 37.7, -122.3, 100, 100, "km").collect()] and geosets.georadius(g, 0.0, 0.0, 1, count=3).count() == 0
    pairs = spark.createDataFrame([("c", b"sf", b"la"), ("c", b"sf", b"xx")], "key string, member1 binary, member2 binary")
    assert [None if r.distance is None else round(r.distance) for r in geosets.geodist(g, pairs, "km").orderBy("member2").collect()] == [559, None]
    with pytest.raises(Exception):
        geosets.geoadd(spark.createDataFrame([("c", b"x", 91.0, 0.0)], "key string, member binary, lat double, lon double")).collect()


def test_keys_of_any_type(spark):
    s = spark.createDataFrame([("k", b"m"), ("o", b"n")], "key string, member binary")
    zs = spark.createDataFrame([("k", b"m", 1.0)], "key string, member binary, score double")
    assert rows(keyspace.all_keys({"zset": zs, "set": s})) == [("k", "zset"), ("o", "set")]
    assert rows(keyspace.rename(s, "k", "o")) == [("o", "m")]
    assert rows(keyspace.rename(s, "k", "o", only_new=True)) == rows(s) and rows(keyspace.rename(s, "absent", "o")) == rows(s)
    assert rows(keyspace.copy(s, "k", "new")) == [("k", "m"), ("new", "m"), ("o", "n")]


def test_eviction(spark):
    e = spark.createDataFrame([(f"k{i}", 10, i, 5 - i % 3, None if i % 2 else i) for i in range(20)], "key string, size long, last_access long, freq long, expires_at_ms long")
    assert rows(governance.evict(e, "allkeys-lru", 100), "key") == sorted((f"k{i}",) for i in range(10, 20))
    assert governance.evict(e, "noeviction", 0).count() == 20
    left = governance.evict(e, "volatile-ttl", 150)
    assert left.count() == 15 and left.filter("expires_at_ms IS NULL").count() == 10
    assert governance.evict(e, "volatile-lru", 0).count() == 10
    with pytest.raises(ValueError):
        governance.evict(e, "unknown", 1)


def test_pages_cover_everything_once(spark):
    s = spark.createDataFrame([("k", f"{i:02d}".encode()) for i in range(7)], "key string, member binary")
    seen, cursor = [], 0
    while True:
        got = sets.sscan(s, cursor, 3).collect()
        seen += [bytes(r.member) for r in got]
        cursor = got[0].next_cursor
        if not cursor:
            break
    assert seen == [f"{i:02d}".encode() for i in range(7)]
    assert paging.requested(s, [b"03", b"xx"], "member", "key").count() == 2


def test_token_bucket(spark):
    r = spark.createDataFrame([("c", i, 1.0) for i in (0, 0, 0, 10)], "client string, t long, tokens double").select("client", F.timestamp_seconds("t").alias("ts"), "tokens")
    assert [x.allowed for x in governance.allowed_by_bucket(r, 0.1, 2).orderBy("ts").collect()].count(True) == 3
