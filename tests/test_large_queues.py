"""Queues of any length: what a task holds of them, and folds whose keys come as sorted stretches."""

import random
import tracemalloc

from pyspark.sql import functions as F

from keyweave.plans.ordered import folded, stretches
from keyweave.streaming import queues
from keyweave.streaming.queues import Limits, Message, Queue


def publish(i, **more):
    return {"op": "publish", "now": 0, "id": f"order-{i}", "payload": None, "priority": i % 5, "max_retries": 1} | more


def test_ready_messages_are_not_all_in_memory():
    queue, n = Queue(Limits(max_depth=1 << 40)), 200_000
    tracemalloc.start()
    try:
        for i in range(n):
            queue.apply(publish(i))
        assert tracemalloc.get_traced_memory()[0] < 100 * n
    finally:
        tracemalloc.stop()
    assert [m.id for m in queue.ready] == [f"order-{i}" for p in range(4, -1, -1) for i in range(p, n, 5)]


def test_messages_in_flight_are_small():
    queue, n = Queue(Limits(max_depth=1 << 40, ack_deadline_secs=5)), 100_000
    tracemalloc.start()
    try:
        for i in range(n):
            queue.apply(publish(i, priority=0))
            queue.apply({"op": "consume", "now": 0, "consumer_id": "c"})
        assert tracemalloc.get_traced_memory()[0] < 150 * n
    finally:
        tracemalloc.stop()
    assert len(queue.pending) == n and queue.ack("order-7") == "acked" and queue.ack("order-7") == "not found"
    assert queue.expire(5) == sorted(f"order-{i}" for i in range(n) if i != 7)


def test_a_queues_entries_hold_many_messages():
    queue, n = Queue(Limits(max_depth=1 << 40)), 20_000
    for i in range(n):
        queue.apply(publish(i))
    for _ in range(n // 2):
        queue.apply({"op": "consume", "now": 0, "consumer_id": "c"})
    assert len(queue.packed()) < n // 50
    assert list(Queue.unpacked(queue.packed(), queue.limits).rows("q")) == list(queue.rows("q"))


class Plain:
    """A queue by lists and dicts that are searched from end to end."""

    def __init__(self, limits):
        self.limits, self.ready, self.pending, self.dead = limits, [], {}, []

    def back(self, m, requeue):
        m["tries"] += 1
        if m["tries"] > m["most"]:
            self.dead.append(m)
            return "dead"
        if requeue:
            self.ready.append(m)
        return "requeued" if requeue else "dropped"

    def apply(self, row):
        op, now = row["op"], row["now"]
        for _, i in sorted((d, i) for i, (_, _, d) in self.pending.items() if d <= now):
            self.back(self.pending.pop(i)[0], True)
        if op == "publish":
            m = {"id": row["id"], "priority": row["priority"], "most": row["max_retries"], "tries": 0}
            at = next((n for n, o in enumerate(self.ready) if o["priority"] < m["priority"]), len(self.ready))
            self.ready.insert(at, m)
            return m["id"], "published", 0
        if op == "consume":
            if not self.ready or sum(who == row["consumer_id"] for _, who, _ in self.pending.values()) >= self.limits.prefetch:
                return None, "empty", None
            m = self.ready.pop(0)
            self.pending[m["id"]] = m, row["consumer_id"], now + self.limits.ack_deadline_secs
            return m["id"], "delivered", m["tries"]
        if op == "purge":
            n = len(self.ready)
            self.ready = []
            return None, f"purged {n}", None
        if op == "delete":
            self.__init__(self.limits)
            return None, "deleted", None
        held = self.pending.pop(row["id"], None)
        if not held:
            return row["id"], "not found", None
        return row["id"], "acked" if op == "ack" else self.back(held[0], row["requeue"]), None

    def rows(self, name):
        for state, found in (("ready", [(m, None, None) for m in self.ready]), ("pending", self.pending.values()), ("dead", [(m, None, None) for m in self.dead])):
            for i, (m, who, until) in enumerate(found):
                yield name, m["id"], state, i, m["priority"], m["tries"], who, until


def test_spilled_and_closed_up_queues_equal_a_plain_one(monkeypatch):
    monkeypatch.setattr(queues.Line, "PART", 3)
    monkeypatch.setattr(queues, "SORTED", 4)
    monkeypatch.setattr(queues, "SEGMENT", 5)
    for seed, batches in ((1, False), (2, False), (3, False), (4, True), (5, True)):
        chance, limits = random.Random(seed), Limits(ack_deadline_secs=40, prefetch=60)
        plain, queue = Plain(limits), Queue(limits)
        ops = ["publish"] * 8 + ["consume"] * 8 + ["ack"] * 3 + ["nack"] * 3
        for i in range(6000):
            op = chance.choice(ops) if chance.random() > 0.001 else chance.choice(["purge", "delete"])
            # ids are published again, but not while in flight where entries are read back, which puts such by their last delivery
            mine = i if op == "publish" and (batches or chance.random() < 0.9) else chance.randrange(max(0, i - 150), i + 1)
            row = {"op": op, "now": i // 20 * 3, "id": f"é{mine}", "consumer_id": chance.choice("abc"), "payload": None, "priority": chance.randrange(4), "max_retries": 2, "requeue": chance.random() < 0.7}
            assert queue.apply(dict(row)) == plain.apply(dict(row)), (seed, i)
            if i % 50 == 0:
                assert list(queue.rows("q")) == list(plain.rows("q")), (seed, i)
                if batches:
                    queue = Queue.unpacked(queue.packed(), limits)


def test_messages_without_an_id_and_with_payloads():
    queue = Queue(Limits())
    queue.publish(Message(None, b"x", 1, 1))
    queue.publish(Message("", b"y", 1, 1))
    assert queue.consume("c", 0).payload == b"x" and queue.consume("c", 0).id == ""
    again = Queue.unpacked(queue.packed(), Limits())
    assert again.nack(None, True) == "requeued" and again.consume("c", 1).payload == b"x" and again.ack("") == "acked"


def test_an_entry_a_message_is_still_read():
    import pickle

    old = {"ready 3 7": pickle.dumps(("a", b"", 3, 2, 0, 7)), "pending 4 0": pickle.dumps((("b", b"p", 1, 2, 1, 2), "c", 30)), "dead 0 0": pickle.dumps(("d", b"", 5, 0, 1, 1))}
    queue = Queue.unpacked(old, Limits())
    assert list(queue.rows("q")) == [("q", "a", "ready", 0, 3, 0, None, None), ("q", "b", "pending", 0, 1, 1, "c", 30), ("q", "d", "dead", 0, 5, 1, None, None)]
    assert queue.delivered == 4 and queue.ready.came == 8 and queue.holds["c"] == 1


def test_stretches_fold_as_rows_do(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 50 == 3, None).when(F.col("id") % 10 < 9, "big").otherwise(F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).alias("key"), (F.col("id") * 7919 % 40_000).alias("seq"), F.lit("x").alias("what"))
    step = lambda state, row: state.append(row["seq"]) or [(row["key"], row["seq"], len(state), state[-2:] in ([row["seq"]], sorted(state[-2:])))]
    told = lambda large: folded(rows, "key", list, step, lambda state, key: [(key, -1, len(state), True)], "key string, seq long, nth int, after boolean", large=large)
    by = lambda r: (r.key or "", r.seq)
    got = sorted(told(True).collect(), key=by)
    assert got == sorted(told(False).collect(), key=by) and all(r.after for r in got)
    size = stretches(rows, "key", "seq").filter("__key = 'big'").agg(F.sum(F.octet_length("__rows"))).first()[0]
    assert size < 15 * 36_000
