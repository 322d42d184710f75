"""Logs, topics, groups, queues, routing, transactions, recovery and streams."""

import pytest
from pyspark.sql import functions as F

from keyweave.plans import commands, fold, scripts, transactions
from keyweave.schemas import OPLOG
from keyweave.sources import oplog
from keyweave.streaming import groups, jobs, pubsub, queues, rooms, rx


def log(spark, *ops):
    full = [{"ts_ms": 0, "member": None, "value": None, "num": None, "args": None} | {"seq": i} | op for i, op in enumerate(ops)]
    names = [p.split()[0] for p in OPLOG.replace("map<string,string>", "map").split(", ")]
    return spark.createDataFrame([tuple(o[n] for n in names) for o in full], OPLOG)


def state(df):
    return {(r.key, r.type, None if r.member is None else bytes(r.member)): (None if r.value is None else bytes(r.value), r.num, r.expires_at_ms) for r in df.collect()}


def test_set_options(spark):
    ops = log(
        spark,
        {"op": "SET", "key": "a", "value": b"1", "args": {"NX": "1"}},
        {"op": "SET", "key": "a", "value": b"2", "args": {"NX": "1", "GET": "1"}},
        {"op": "SET", "key": "b", "value": b"2", "args": {"XX": "1"}},
        {"op": "SET", "key": "c", "value": b"3", "args": {"expires_at_ms": "100"}},
        {"op": "SET", "key": "c", "value": b"4", "args": {"KEEPTTL": "1"}, "ts_ms": 50},
        {"op": "SET", "key": "c", "value": b"5", "args": {"XX": "1"}, "ts_ms": 100},
        {"op": "INCRBY", "key": "n", "num": 5.0},
        {"op": "INCRBY", "key": "n", "num": -7.0},
    )
    assert state(fold.state_after(ops)) == {("a", "string", None): (b"1", None, None), ("n", "string", None): (b"-2", None, None)}
    answers = {r.seq: (r.ok, r.value) for r in fold.replies(ops).collect()}
    assert answers[1] == (False, bytearray(b"1")) and answers[2][0] is False and answers[4][0] and not answers[5][0]


def test_zadd_sequence_and_lists(spark):
    ops = log(
        spark,
        {"op": "ZADD", "key": "z", "member": b"m", "num": 5.0},
        {"op": "ZADD", "key": "z", "member": b"m", "num": 3.0, "args": {"GT": "1"}},
        {"op": "ZADD", "key": "z", "member": b"m", "num": 2.0, "args": {"INCR": "1", "CH": "1"}},
        {"op": "LPUSH", "key": "l", "value": b"a"},
        {"op": "RPUSH", "key": "l", "value": b"b"},
        {"op": "LPUSH", "key": "l", "value": b"c"},
        {"op": "RPOP", "key": "l"},
        {"op": "LPUSH", "key": "x", "value": b"c", "args": {"X": "1"}},
    )
    got = fold.state_after(ops)
    assert state(got)[("z", "zset", b"m")] == (None, 7.0, None)
    assert [bytes(r.value) for r in got.filter("type = 'list'").orderBy("num").collect()] == [b"c", b"a"]


def test_snapshot_and_tail_give_the_whole(spark, tmp_path):
    ops = log(spark, *[{"op": op, "key": f"k{i % 3}", "value": str(i).encode(), "member": str(i % 4).encode(), "num": float(i)} for i, op in enumerate(["SET", "RPUSH", "ZINCRBY", "SADD", "HSET", "LPUSH", "DEL", "RPUSH", "SADD", "ZADD"] * 3)])
    path = str(tmp_path / "log")
    oplog.append(ops.filter("seq < 20"), path)
    oplog.append(ops.filter("seq >= 20"), path)
    half = fold.state_after(oplog.replay(spark, path).filter("seq <= 14"))
    oplog.save_snapshot({"state": half}, str(tmp_path / "snap"), 14)
    loaded, seq = oplog.load_snapshot(spark, str(tmp_path / "snap"))
    assert seq == 14
    assert state(fold.recover(loaded["state"], oplog.tail(spark, path, seq))) == state(fold.state_after(ops))
    oplog.save_snapshot({"state": half}, str(tmp_path / "snap"), 20)
    assert oplog.prune_snapshots(spark, str(tmp_path / "snap"), 1) == 1
    oplog.truncate(spark, path, str(tmp_path / "short"), 14)
    with pytest.raises(oplog.OffsetTooOld):
        oplog.tail(spark, str(tmp_path / "short"), 3)
    assert oplog.ring(ops, 5).count() == 5 and oplog.lag(ops, 20).first()[0] == 9


def test_transactions(spark, tmp_path):
    path = str(tmp_path / "log")
    oplog.append(log(spark, {"op": "SET", "key": "a", "value": b"1"}), path)
    one, two = transactions.Transaction(spark, path), transactions.Transaction(spark, path)
    assert one.queue("SET", "a", value=b"0") is False  # no transaction is open
    one.watch(["a"])
    one.multi()
    one.queue("SET", "a", value=b"one")
    one.queue("SET", "b", value=b"one")
    two.multi()
    two.queue("SET", "a", value=b"two")
    assert two.exec(0) == 1
    assert one.exec(0) is None  # a watched key changed: nothing is written
    assert state(fold.state_after(spark.read.parquet(path))) == {("a", "string", None): (b"two", None, None)}
    for call in (one.discard, lambda: one.exec(0)):
        with pytest.raises(RuntimeError):
            call()


def test_partitions_and_groups(spark):
    events = spark.createDataFrame([("orders", f"customer-{i % 10}".encode(), f"order-{i}".encode(), i) for i in range(30)], "topic string, key binary, data binary, seq int")
    placed = rooms.to_topic(events, 3, ["seq"])
    assert placed.groupBy("key").agg(F.countDistinct("partition_id").alias("n")).filter("n > 1").count() == 0
    assert placed.filter("offset = 0").count() == placed.select("partition_id").distinct().count()
    members = spark.createDataFrame([("g", m) for m in ("m1", "m2", "m3")], "group_id string, member_id string")
    for assign in (groups.assign_round_robin, groups.assign_range):
        got = assign(members, 3).collect()
        assert {r.partition_id for r in got} == {0, 1, 2} and len({r.member_id for r in got}) == 3
    seven = {r.member_id: 0 for r in members.collect()}
    for r in groups.assign_range(members, 7).collect():
        seven[r.member_id] += 1
    assert seven == {"m1": 3, "m2": 2, "m3": 2}


def test_sticky_keeps_and_loses_nothing():
    before = {"a": [0, 1, 2, 3, 4, 5]}
    after = groups.assign_sticky(["a", "b", "c"], before, 7)
    assert sorted(p for ps in after.values() for p in ps) == list(range(7))
    assert max(map(len, after.values())) <= 3 and set(after["a"]) <= set(range(7))
    assert groups.assign_sticky(["a", "b"], {"a": [0], "b": [1]}, 2) == {"a": [0], "b": [1]}


def test_caps_protect_what_is_unread(spark):
    events = spark.createDataFrame([("r", i) for i in range(20)], "room string, offset long")
    kept = lambda *a: sorted(r.offset for r in rooms.capped(events, *a).collect())
    assert kept(5) == list(range(15, 20))
    slow = spark.createDataFrame([("r", "s1", 12), ("r", "s2", 18)], "room string, subscriber string, last_offset long")
    assert kept(5, 50, slow) == list(range(12, 20))
    assert kept(5, 7, slow) == list(range(13, 20))
    with pytest.raises(rooms.OffsetOutOfRange):
        rooms.check_offset(events.filter("offset >= 5"), "r", 2)


def ops_of(spark, rows):
    names = "queue string, seq long, now long, op string, id string, consumer_id string, payload binary, priority int, max_retries int, requeue boolean"
    full = [("q", i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, names)


def publish(i, priority=5, retries=3, now=0):
    return (now, "publish", i, None, b"job", priority, retries, None)


def consume(now=0, who="c"):
    return (now, "consume", None, who, None, None, None, None)


def nack(i, requeue=True, now=0):
    return (now, "nack", i, None, None, None, None, requeue)


def test_queue_priorities_and_requeue(spark):
    ops = ops_of(spark, [publish("a", 1), publish("b", 9), publish("c", 9), consume(), nack("b"), consume(), consume(), consume()])
    assert [r.id for r in queues.outcomes(ops).filter("op = 'consume'").orderBy("seq").collect()] == ["b", "c", "a", "b"]


def test_queue_dead_letters_drops_and_deadlines(spark):
    ops = ops_of(spark, [publish("a", retries=0), publish("b"), publish("c"), consume(), nack("a"), consume(), nack("b", False), consume(now=0), consume(now=40), nack("zz")])
    got = {r.seq: (r.id, r.outcome) for r in queues.outcomes(ops).collect()}
    assert got[4] == ("a", "dead") and got[6] == ("b", "dropped") and got[7] == ("c", "delivered")
    assert got[8] == ("c", "delivered")  # its deadline had passed, so it was requeued first
    assert got[9] == ("zz", "not found")
    left = {(r.id, r.state, r.retry_count) for r in queues.state_after(ops).collect()}
    assert left == {("a", "dead", 1), ("c", "pending", 1)}


def test_queue_prefetch_and_depth(spark):
    ops = ops_of(spark, [publish("a"), publish("b"), publish("c"), consume(), consume(), consume(who="d")])
    got = [r.outcome for r in queues.outcomes(ops, queues.Limits(max_depth=2, prefetch=1)).orderBy("seq").collect()]
    assert got == ["published", "published", "full", "delivered", "empty", "delivered"]


def test_every_message_is_delivered_once(spark):
    ops = [publish(str(i), (9, 5, 1)[i % 3]) for i in range(30)] + [consume(who=f"c{i % 5}") for i in range(35)]
    got = [r.id for r in queues.outcomes(ops_of(spark, ops)).filter("outcome = 'delivered'").orderBy("seq").collect()]
    assert len(got) == len(set(got)) == 30
    assert [int(i) % 3 for i in got] == [0] * 10 + [1] * 10 + [2] * 10


def test_routing_is_once_for_a_subscriber(spark):
    m = spark.createDataFrame([(1, "notifications.email"), (2, "notifications.email.user"), (3, "other")], "id int, topic string")
    exact = spark.createDataFrame([("s1", "notifications.email")], "subscriber_id string, topic string")
    got = pubsub.route(m, exact, [("s1", "notifications.*"), ("s2", "notifications.#")])
    assert sorted((r.id, r.subscriber_id) for r in got.collect()) == [(1, "s1"), (1, "s2"), (2, "s2")]
    assert m.filter(pubsub.has_subscriber([("s", "oth*")], F.col("topic"))).count() == 1


def test_watch_versions_and_notifications(spark):
    changes = spark.createDataFrame([(1, "k", "set", b"v"), (2, "k", "set", b"\xff"), (3, "k", "del", None), (4, "k", "set", b"long")], "seq int, key string, event string, value binary")
    got = pubsub.watch_feed(changes, inline=3).collect()
    assert sorted(((r.version, r.value, r.truncated) for r in got if r.event == "set"), key=str) == [(1, "v", False), (1, None, True), (2, None, True)]
    events = spark.createDataFrame([("string", "set", "k"), ("list", "lpush", "l")], "class string, event string, key string")
    assert sorted(r.topic for r in pubsub.keyspace_events(events, "KE$").collect()) == ["__keyevent@0__:set", "__keyspace@0__:k"]
    assert pubsub.keyspace_events(events, "A").count() == 0


def test_rx(spark):
    rows = spark.createDataFrame([("u", t, v) for t, v in ((0, 1), (1, 2), (2, 99), (30, 3))], "k string, t long, v int").select("k", F.timestamp_seconds("t").alias("ts"), "v", F.col("t").alias("event_id"))
    assert [r.v for r in rx.take_while(rows, F.col("v") < 50, ["ts"], "k").orderBy("ts").collect()] == [1, 2]
    assert [r.v for r in rx.debounce(rows, 5, "k").orderBy("ts").collect()] == [99, 3]
    assert sorted(r.n for r in rx.buffer_time(rows, 5, "k").collect()) == [1, 3]

    def handler(row):
        if row["v"] > 50:
            raise ValueError

    done = rx.process(rows.select(F.col("event_id").cast("string").alias("id"), "v"), handler, 10).collect()
    assert {r.id: r.outcome for r in done} == {"0": "ack", "1": "ack", "2": "nack", "30": "ack"}


def test_a_stream_shows_what_its_batch_twin_computes(spark, tmp_path):
    events = spark.createDataFrame([(f"r{i % 3}", i) for i in range(60)], "room string, event_id long")
    for part in range(3):
        events.filter(F.col("event_id").between(part * 20, part * 20 + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_log(spark, str(tmp_path / "in"), "room string, event_id long", 1)
    jobs.run_once(jobs.assign_offsets(stream, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.room, r.offset) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.room, r.offset) for r in rooms.with_offsets(events, ["room"], ["event_id"]).collect()}


def test_queues_as_a_stream(spark, tmp_path):
    ops = ops_of(spark, [publish("a", 1), publish("b", 9), consume(), nack("b"), consume(), consume()])
    for half in ("seq < 3", "seq >= 3"):
        ops.filter(half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_log(spark, str(tmp_path / "in"), queues.OPS, 1)
    jobs.run_once(jobs.fold_queues(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    order = lambda df: [(r.seq, r.id, r.outcome) for r in df.orderBy("seq").collect()]
    assert order(spark.read.parquet(str(tmp_path / "out"))) == order(queues.outcomes(ops))


def double_first(call, keys, args):
    return {"sum": sum(int(a) for a in args), "keys": len(keys)}


def test_scripts():
    s = scripts.Scripts(lambda *a: None)
    sha = s.load(double_first)
    assert s.evalsha(sha, ["k"], ["1", "2"]) == {"sum": 3, "keys": 1} and s.exists(sha, "no") == [True, False]
    assert s.flush() == 1
    with pytest.raises(scripts.NoScript):
        s.evalsha(sha, [], [])


def test_commands(spark):
    z = spark.createDataFrame([("k", b"a", 1.0), ("k", b"b", 2.0)], "key string, member binary, score double")
    kv = spark.createDataFrame([("s", b"v", None)], "key string, value binary, expires_at_ms long")
    engine = commands.Engine({"zset": z, "string": kv}, now_ms=0)
    assert engine.run("sortedset.zrange", 0, 0).count() == 1 and engine.run("GET", "s").count() == 1
    assert engine.run("TYPE", spark.createDataFrame([("k",), ("x",)], "key string")).count() == 2
    with pytest.raises(KeyError):
        engine.run("NOPE")
    assert set(fold.OPERATIONS) == set(commands.WRITES)
    g = engine.run("GEOADD", spark.createDataFrame([("k", b"a", 1.0, 1.0)], "key string, member binary, lat double, lon double"))
    assert commands.Engine({"geo": g}).run("geospatial.geosearch", "k", member=b"a", radius=1.0).count() == 1
    assert commands.command_name("hash.getall") == "HGETALL" and commands.command_name("set.size") == "SCARD" and commands.command_name("kv.get") == "GET"
    assert engine.run("ZINTERSTORE", "both", ["k"]).filter("key = 'both'").count() == 2
    assert bytes(engine.run("APPEND", b"!").first().value) == b"v!"
    assert engine.write(spark, 4, "kv.set", "s", value=b"w").first().op == "SET"
    for name in ("hash.get", "list.lpush", "set.add", "sortedset.zadd", "bitmap.bitop", "hyperloglog.pfcount", "geospatial.geosearch", "stream.consume", "queue.stats", "key.rename", "pubsub.subscribe", "stream.create", "pubsub.stats", "set.del", "queue.delete"):
        assert commands.command_name(name) in commands.COMMANDS, name
