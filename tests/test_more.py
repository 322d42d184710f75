"""Folds that go on after refusals, commits of two clients, life cycles, readers, deadlines, placement and checks by hand."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from keyweave.functions import checks
from keyweave.operators import deadlines, geosets, governance, lists, paging, zsets
from keyweave.plans import fold, staging, transactions
from keyweave.schemas import OPLOG
from keyweave.sources import oplog
from keyweave.streaming import catalogue, groups, jobs, pubsub, queues, readers, rooms
from tests.test_logs import log, state


def told(spark, *ops):
    return [(r.ok, r.whole, r.error) for r in fold.replies(log(spark, *[{"key": "k"} | o for o in ops])).orderBy("seq").collect()]


def test_a_refused_operation_leaves_the_fold_going(spark):
    got = told(
        spark,
        {"op": "SET", "value": b"1_0"},
        {"op": "INCRBY", "num": 1.0},
        {"op": "SET", "value": b"9007199254740993"},
        {"op": "INCRBY", "num": 2.0},
        {"op": "INCRBY", "num": 0.5},
        {"op": "INCRBY", "args": {"by": "9223372036854775807"}},
        {"op": "NOPE"},
        {"op": "ZADD", "member": b"m"},
        {"op": "ZADD", "num": 1.0},
        {"op": "LSET", "num": 3.0, "value": b"x"},
        {"op": "SET"},
        {"op": None},
        {"op": "APPEND", "value": b"!"},
    )
    integer = "value is not an integer or out of range"
    assert got == [
        (True, None, None),
        (False, None, integer),
        (True, None, None),
        (True, 9007199254740995, None),
        (False, None, "increment is not an integer"),
        (False, None, "increment or decrement would overflow"),
        (False, None, "unknown operation"),
        (False, None, "a number is missing"),
        (False, None, "member is missing"),
        (False, None, "index is out of range"),
        (False, None, "value is missing"),
        (False, None, "unknown operation"),
        (True, 17, None),
    ]


@pytest.mark.parametrize("value", [b" 1", b"1 ", b"", b"+", b"1e3", b"0x1", b"9223372036854775808", "١".encode()])
def test_integers_are_strict(value):
    with pytest.raises(fold.Refused):
        fold.integer(value)


def test_nan_is_a_number_and_null_is_none(spark):
    got = fold.state_after(log(spark, {"op": "ZADD", "key": "z", "member": b"a", "num": float("nan")}, {"op": "ZADD", "key": "z", "member": b"b", "num": 1.0}, {"op": "ZPOPMIN", "key": "z"}))
    assert state(got) == {("z", "zset", b"b"): (None, 1.0, None)}  # NaN comes first


def test_lists_of_the_fold_by_hand(spark):
    r = random.Random(5)
    ops, want = [], []
    for i in range(200):
        op = r.choice(["LPUSH", "RPUSH", "RPUSH", "LPOP", "RPOP", "LTRIM", "LSET"])
        a, b = r.randrange(-6, 7), r.randrange(-6, 7)
        ops.append({"op": op, "key": "l", "value": str(i).encode(), "num": float(a), "args": {"start": str(a), "stop": str(b)}})
        if op == "LPUSH":
            want.insert(0, str(i).encode())
        elif op == "RPUSH":
            want.append(str(i).encode())
        elif op == "LPOP" and want:
            want.pop(0)
        elif op == "RPOP" and want:
            want.pop()
        elif op == "LSET" and -len(want) <= a < len(want):
            want[a] = str(i).encode()
        elif op == "LTRIM":
            first, last = a if a >= 0 else max(0, len(want) + a), b if b >= 0 else len(want) + b
            want = want[first : last + 1] if last >= 0 else []
    got = sorted((r.num, bytes(r.value)) for r in fold.state_after(log(spark, *ops)).collect())
    assert [v for _, v in got] == want


def test_two_clients_on_one_log(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([], OPLOG).write.parquet(path)

    def client(name, done):
        for i in range(4):
            t = transactions.Transaction(spark, path)
            t.multi()
            t.queue("SET", name, value=str(i).encode())
            t.queue("SET", "both", value=name.encode())
            done.append(t.exec(0))

    done: list = []
    threads = [threading.Thread(target=client, args=(n, done)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = spark.read.schema(OPLOG).parquet(path).orderBy("seq").collect()
    assert done == [2] * 8 and [r.seq for r in rows] == list(range(1, 17))
    assert all(x.key in "ab" and y.key == "both" and bytes(y.value).decode() == x.key for x, y in zip(rows[::2], rows[1::2]))


def test_a_claim_is_one_clients(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([], OPLOG).write.parquet(path)
    assert oplog.claim(spark, path, 1) and not oplog.claim(spark, path, 1)
    t = transactions.Transaction(spark, path, patience=0.2)
    t.multi()
    t.queue("SET", "k", value=b"v")
    with pytest.raises(TimeoutError):
        t.exec(0)
    assert oplog.release(spark, path, 1)
    t.multi()
    t.queue("SET", "k", value=b"v")
    assert t.exec(0) == 1 and spark.read.parquet(path).count() == 1


# places and slices ------------------------------------------------------------------------


def test_places_within_keys_of_any_size(spark):
    rows = [("hot", i * 7919 % 1000) for i in range(1000)] + [(f"k{i % 5}", i) for i in range(40)] + [(None, i) for i in range(5)]
    got = staging.placed(spark.createDataFrame(rows, "key string, x int"), ["key"], [F.col("x")], "at").collect()
    for key in {k for k, _ in rows}:
        own = sorted((r.x, r.at) for r in got if r.key == key)
        assert [a for _, a in own] == list(range(len(own)))
    assert len(got) == len(rows)


@pytest.mark.parametrize("start, stop", [(0, 2), (2, 5), (-3, -1), (-5, -2), (1, -2), (0, -1), (-4, 5), (3, 1), (9, 20), (-20, -9), (-2, -4)])
def test_slices_by_hand(spark, start, stop):
    z = spark.createDataFrame([(k, bytes([i]), float(i * 5 % 7)) for k, n in (("a", 7), ("b", 3), ("c", 1)) for i in range(n)], "key string, member binary, score double")
    got = {(r.key, bytes(r.member), r["rank"]) for r in zsets.zrange(z, start, stop).collect()}
    want = set()
    for key in "abc":
        own = sorted((r.score, bytes(r.member)) for r in z.filter(F.col("key") == key).collect())
        n = len(own)
        first, last = start if start >= 0 else max(0, n + start), stop if stop >= 0 else n + stop
        want |= {(key, m, i) for i, (_, m) in enumerate(own) if first <= i <= last}
    assert got == want


def test_list_writes_by_hand(spark):
    r = random.Random(8)
    values = {k: [r.choice(["x", "y", "z"]).encode() for _ in range(n)] for k, n in (("a", 9), ("b", 4), ("c", 1))}
    li = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "key string, idx long, value binary")

    def of(df):
        out = {}
        for row in sorted(df.collect(), key=lambda x: (x.key, x.idx)):
            out.setdefault(row.key, []).append((row.idx, bytes(row.value)))
        assert all([i for i, _ in v] == list(range(len(v))) for v in out.values())
        return {k: [v for _, v in vs] for k, vs in out.items()}

    for count in (0, 1, 2, -1, -2):
        want = {}
        for k, vs in values.items():
            at = [i for i, v in enumerate(vs) if v == b"x"]
            gone = set(at if count == 0 else at[:count] if count > 0 else at[count:])
            want[k] = [v for i, v in enumerate(vs) if i not in gone]
        assert of(lists.lrem(li, count, b"x")[1]) == {k: v for k, v in want.items() if v}
    new = spark.createDataFrame([("a", b"1", 1), ("a", b"2", 2), ("d", b"3", 1)], "key string, value binary, seq int")
    assert of(lists.push(li, new)) == {**values, "a": values["a"] + [b"1", b"2"], "d": [b"3"]}
    assert of(lists.push(li, new, left=True)) == {**values, "a": [b"2", b"1"] + values["a"], "d": [b"3"]}
    assert of(lists.push(li, new, only_existing=True)) == {**values, "a": values["a"] + [b"1", b"2"]}
    for before in (True, False):
        want = {k: (vs[: vs.index(b"y") + (not before)] + [b"!"] + vs[vs.index(b"y") + (not before) :]) if b"y" in vs else vs for k, vs in values.items()}
        assert of(lists.linsert(li, b"y", b"!", before=before)) == want
    assert of(lists.rpoplpush(li, "a", "b")) == {**values, "a": values["a"][:-1], "b": [values["a"][-1], *values["b"]]}
    assert of(lists.rpoplpush(li, "a", "a")) == {**values, "a": [values["a"][-1], *values["a"][:-1]]}
    assert of(lists.rpoplpush(li, "none", "b")) == values
    assert of(lists.ltrim(li, 1, -2)) == {k: vs[1:-1] for k, vs in values.items() if vs[1:-1]}


def test_retention_of_sizes_and_counts_by_hand(spark):
    r = random.Random(3)
    rows = [("t", p, i, r.randrange(1, 30)) for p in range(3) for i in range(40)]
    topic = spark.createDataFrame(rows, "topic string, partition_id int, offset long, size_bytes long")
    for most, many in ((100, None), (None, 7), (150, 6), (60, 30)):
        want = set()
        for p in range(3):
            total = n = 0
            for _, _, i, size in sorted((x for x in rows if x[1] == p), key=lambda x: -x[2]):
                total, n = total + size, n + 1
                if (most is None or total <= most) and (many is None or n <= many):
                    want.add((p, i))
        assert {(x.partition_id, x.offset) for x in rooms.retain(topic, max_bytes=most, max_messages=many).collect()} == want


# rules and placement ----------------------------------------------------------------------


def test_eviction_with_ties_by_hand(spark):
    rows = [(f"k{i:03}", 5 + i % 4, i % 3, None if i % 5 else i, 0) for i in range(120)]
    e = spark.createDataFrame(rows, "key string, size long, last_access long, expires_at_ms long, freq long")
    for policy, by, may in (("allkeys-lru", 2, lambda x: True), ("allkeys-lfu", 4, lambda x: True), ("volatile-ttl", 3, lambda x: x[3] is not None)):
        for budget in (0, 300, 500, 10_000):
            excess, stay = sum(x[1] for x in rows) - budget, []
            for x in sorted((x for x in rows if may(x)), key=lambda x: (x[by], x[0])):
                if excess > 0:
                    excess -= x[1]
                else:
                    stay.append(x[0])
            stay += [x[0] for x in rows if not may(x)]
            assert sorted(x.key for x in governance.evict(e, policy, budget).collect()) == sorted(stay)


def test_slots_are_assigned_once(spark):
    owned = spark.createDataFrame([("a", 0, 99)], "node string, first int, last int")
    with pytest.raises(ValueError):
        governance.assign_slots(owned, "b", 50, 60)
    with pytest.raises(ValueError):
        governance.assign_slots(owned, "b", 100, 1 << 14)
    assert governance.assign_slots(owned, "b", 100, 200).count() == 2


def test_rules_the_longest_decides(spark):
    rules = spark.createDataFrame([("*", "a*", "*", True), ("u", "a.b*", "read", False), ("u", "a.b.c", "read", True)], "user string, resource string, action string, allow boolean")
    asked = spark.createDataFrame([(1, "u", "a.b.c", "read"), (2, "u", "a.b.d", "read"), (3, "v", "a.b.d", "read"), (4, "u", "b", "read"), (5, "u", "a", "write")], "id int, user string, resource string, action string")
    assert {r.id: r.allowed for r in governance.allowed(asked, rules).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_routing_by_table_finds_what_every_pattern_finds(spark):
    from keyweave.functions.topics import is_wildcard, topic_regex
    import re

    r = random.Random(6)
    level = lambda: r.choice(["a", "b", "c1", "c2", "*", "c*", ""])
    patterns = {(f"s{r.randrange(9)}", ".".join(level() for _ in range(r.randint(1, 4))) + r.choice(["", ".#"])) for _ in range(80)} | {("all", "#")}
    messages = [(i, ".".join(r.choice(["a", "b", "c1", "c2", ""]) for _ in range(r.randint(1, 4)))) for i in range(150)]
    got = {(x.id, x.subscriber_id) for x in pubsub.route_table(spark.createDataFrame(messages, "id int, topic string"), spark.createDataFrame(sorted(patterns), "subscriber_id string, pattern string")).collect()}
    want = {(i, s) for i, t in messages for s, p in patterns if (re.search(topic_regex(p).replace("\\z", "\\Z"), t) if is_wildcard(p) else p == t)}
    assert got == want


# logs, readers, life ----------------------------------------------------------------------


def test_life_and_refusals(spark):
    calls = [(1, "r", "create", "c1"), (2, "r", "create", "c2"), (3, "q", "delete", None), (4, "r", "delete", None), (5, "r", "ensure", "c5"), (6, "r", "ensure", "c6"), (7, "x", "create", "c7"), (8, "x", "delete", None)]
    df = spark.createDataFrame(calls, "seq int, name string, op string, config string")
    assert [(r.outcome, r.ok) for r in catalogue.outcomes(df).orderBy("seq").collect()] == [("created", True), ("exists", False), ("not found", False), ("deleted", True), ("created", True), ("exists", True), ("created", True), ("deleted", True)]
    there = catalogue.existing(df)
    assert [(r.name, r.seq, r.config) for r in there.collect()] == [("r", 5, "c5")]
    events = spark.createDataFrame([("r", 1), ("x", 2)], "room string, id int")
    kept, refused = catalogue.accepted(events, there, "room")
    assert [r.id for r in kept.collect()] == [1] and [r.id for r in refused.collect()] == [2]
    assert catalogue.dropped(events, there, "room").count() == 1


def test_readers_share_a_log(spark):
    events = spark.createDataFrame([("r", i) for i in range(10)], "room string, offset long")
    reads = spark.createDataFrame([("r", "g", "a", 1, 3), ("r", "g", "b", 2, 4), ("r", "g", "a", 3, 9), ("r", "h", "c", 1, 2), ("r", "g", "b", 4, 5), ("s", "g", "a", 1, 5), ("r", "h", "c", 2, 0)], "room string, group_id string, consumer_id string, seq int, max_events long")
    left = readers.without(events, spark.createDataFrame([("r", 1)], "room string, offset long"))
    got = readers.deliveries(left, reads)
    assert {(r.group_id, r.consumer_id, r.seq): 0 for r in got.collect()}.keys() == {("g", "a", 1), ("g", "b", 2), ("g", "a", 3), ("h", "c", 1)}
    assert sorted((r.group_id, r.offset) for r in got.collect()) == [("g", i) for i in (0, 2, 3, 4, 5, 6, 7, 8, 9)] + [("h", 0), ("h", 2)]
    acks = spark.createDataFrame([("r", "g", 0), ("r", "g", 0), ("r", "g", 77)], "room string, group_id string, offset long")
    assert readers.pending(got, acks).count() == 10 and readers.acknowledged(got, acks).first().acknowledged == 1


def test_members_come_and_go(spark):
    calls = [(1, 10, "g", "a", "join", 60), (2, 20, "g", "a", "heartbeat", None), (3, 30, "g", "b", "join", 60), (4, 40, "g", "b", "leave", None), (5, 50, "g", "b", "heartbeat", None), (6, 55, "g", "c", "join", 5), (7, 60, "g", "c", "rebalance", None)]
    df = spark.createDataFrame(calls, "seq int, t long, group_id string, member_id string, op string, session_timeout_secs int").withColumn("ts", F.timestamp_seconds("t"))
    members = groups.members_after(df)
    assert {(r.member_id, r.h) for r in members.select("member_id", F.unix_seconds("last_heartbeat").alias("h")).collect()} == {("a", 20), ("c", 55)}
    now = F.timestamp_seconds(F.lit(65))
    assert {r.member_id for r in groups.rebalanced(members, now, 4, "range").collect()} == {"a"}
    assert groups.generations(df).first().generation == 1


def test_deadlines_of_collections(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "key string, x int")
    ends = spark.createDataFrame([("a", 100), ("b", 50)], "key string, expires_at_ms long")
    assert {r.key for r in deadlines.live(rows, ends, 50).collect()} == {"a", "c"}
    assert {(r.key, r.expires_at_ms) for r in deadlines.expire(rows, ends, ["a", "b", "c", "z"], 1, 50).collect()} == {("a", 1050), ("b", 50), ("c", 1050)}
    assert {r.key for r in deadlines.persist(ends, ["a", "b"], 50).collect()} == {"b"}
    assert {(r.key, r.ttl) for r in deadlines.ttl(rows, ends, 1060).collect()} == {("a", -1), ("b", -2), ("c", None)}


def test_geo_options(spark):
    g = geosets.geoadd(spark.createDataFrame([("k", b"a", 1.0, 1.0), ("k", b"b", 1.0, 1.1), ("k", b"far", 40.0, 40.0)], "key string, member binary, lat double, lon double"))
    assert [bytes(r.member) for r in geosets.geosearch(g, "k", member=b"a", radius=50, unit="km").collect()] == [b"a", b"b"]
    assert geosets.geosearch(g, "k", member=b"nobody", box=(1, 1)).count() == 0 == geosets.geosearch(g, "k", member=b"nobody", radius=1).count()
    with pytest.raises(ValueError):
        geosets.geosearch(g, "k", member=b"a", at=(0.0, 0.0), radius=1)


def test_crc64_by_brute_force(spark):
    assert checks.crc64_of(b"123456789") == 0x995DC9BBDF1939FA
    words = [b"", b"a", b"123456789", bytes(range(256)) * 3]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(9, None)], "i int, w binary").select("i", checks.crc64(F.col("w")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: f"{checks.crc64_of(w):016x}" for i, w in enumerate(words)} | {9: None}
    df = spark.range(100)
    assert checks.checksum(df).first() == checks.checksum(df.repartition(7)).first() != checks.checksum(df.limit(99)).first()


# streams ----------------------------------------------------------------------------------


def test_a_queues_entries_are_the_queue(spark):
    r = random.Random(9)
    limits = queues.Limits(ack_deadline_secs=5)
    whole, parts = queues.Queue(limits), queues.Queue(limits)
    for i in range(400):
        op = r.choice(["publish", "publish", "consume", "ack", "nack"])
        row = {"op": op, "now": i // 4, "id": f"m{i if op == 'publish' else r.randrange(i + 1)}", "consumer_id": r.choice("ab"), "payload": b"", "priority": r.randrange(5), "max_retries": 2, "requeue": r.random() < 0.7}
        assert whole.apply(dict(row)) == parts.apply(dict(row))
        if i % 7 == 0:  # as between two batches of a stream
            parts = queues.Queue.unpacked(parts.packed(), limits)
    assert list(whole.rows("q")) == list(parts.rows("q"))


def test_streams_are_observed_and_fanned_out(spark, tmp_path):
    rows = [("r" if i % 2 else "s", i, "ab"[i % 3 == 0], f"t.{i % 4}") for i in range(40)]
    spark.createDataFrame(rows, "room string, offset long, event string, topic string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_log(spark, str(tmp_path / "in"), "room string, offset long, event string, topic string")
    jobs.run_once(jobs.observe_events(stream, "r", "a", 10), str(tmp_path / "one"), str(tmp_path / "c1"))
    assert {x.offset for x in spark.read.parquet(str(tmp_path / "one")).collect()} == {i for i in range(40) if i % 2 and i % 3 and i >= 10}
    jobs.run_once(jobs.observe_topics(stream, ["t.1", "x.*", "t.2.#"]), str(tmp_path / "two"), str(tmp_path / "c2"))
    assert {x.topic for x in spark.read.parquet(str(tmp_path / "two")).collect()} == {"t.1", "t.2"}
    seen: list = []
    jobs.fan_out(stream, [lambda b, n: seen.append(("all", b.count())), lambda b, n: seen.append(("r", b.filter("room = 'r'").count()))], str(tmp_path / "c3"))
    assert seen == [("all", 40), ("r", 20)]


def test_failing_jobs_run_again(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, tries = jobs.read_log(spark, str(tmp_path / "in"), "id long"), []

    def sink(batch, number):
        tries.append(batch.count())
        if len(tries) < 3:
            raise ValueError("not yet")

    assert jobs.retried(lambda: jobs.fan_out(stream, [sink], str(tmp_path / "c")), 5) == 2 and tries == [5, 5, 5]


def test_first_ranks_are_those_of_all(spark):
    df = spark.createDataFrame([(f"k{i % 3}", i * 37 % 100) for i in range(90)], "key string, x int")
    near = {(r.key, r.x, r["rank"]) for r in paging.first_ranks(df, [F.col("x")], 5).collect()}
    assert near == {(r.key, r.x, r["rank"]) for r in paging.ranked(df, [F.col("x")]).filter("rank < 5").collect()}
