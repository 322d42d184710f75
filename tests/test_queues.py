"""The registered queue queries and the queue's order against folds that do each step by hand."""

import random

import pytest

from keyweave.plans.registry import QUERIES
from keyweave.streaming.queues import Limits, Message, Queue, Ready

KEYS = [k for k in range(1, 240) if k % 7]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """A folder with orders in two queues, of all priorities; few keys end in 0."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, "FO"[k % 3 == 0], f"{k % 5 + 1}-X") for k in KEYS]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return path


def by_hand(keys, queue_of, priority_of):
    """(outcomes, messages left) of all orders, by lists searched from end to end."""
    steps = [("publish", 0, keys), ("consume", 1, [k for k in keys if k % 2 == 0]), ("ack", 2, [k for k in keys if k % 6 == 0])]
    steps += [("requeue", 3, [k for k in keys if k % 6 == 2]), ("drop", 4, [k for k in keys if k % 6 == 4])]
    steps += [("consume", 40, [k for k in keys if k % 4 == 0]), ("requeue", 41, [k for k in keys if k % 6 == 2])]
    outcomes, left = [], []
    for queue in sorted({queue_of(k) for k in keys}):
        ready, pending, dead, tries = [], {}, [], {}

        def back(k, requeue):
            tries[k] += 1
            if tries[k] > 1:
                dead.append(k)
                return "dead"
            if requeue:
                ready.append(k)
            return "requeued" if requeue else "dropped"

        for op, now, chosen in steps:
            for k in sorted(k for k in chosen if queue_of(k) == queue):
                for deadline, i in sorted((d, i) for i, d in pending.items() if d <= now):
                    del pending[i]
                    back(int(i.removeprefix("order-")), True)
                name, done = f"order-{k}", "not found"
                if op == "publish":
                    tries[k] = 0
                    at = next((i for i, m in enumerate(ready) if priority_of(m) < priority_of(k)), len(ready))
                    ready.insert(at, k)
                    done = "published"
                elif op == "consume":
                    done, name = ("delivered", f"order-{ready[0]}") if ready else ("empty", None)
                    if ready:
                        pending[f"order-{ready.pop(0)}"] = now + 30
                elif name in pending:
                    del pending[name]
                    done = "acked" if op == "ack" else back(k, op == "requeue")
                outcomes.append((queue, "nack" if op in ("requeue", "drop") else op, name, done))
        left += [(queue, f"order-{k}", "ready", i) for i, k in enumerate(ready)]
        left += [(queue, k, "pending", i) for i, k in enumerate(pending)]
        left += [(queue, f"order-{k}", "dead", i) for i, k in enumerate(dead)]
    return outcomes, left


def test_queue_queries_hold_every_order(spark, orders):
    outcomes, left = by_hand(KEYS, lambda k: "FO"[k % 3 == 0], lambda k: 11 - 2 * (k % 5 + 1))
    rows = QUERIES["queue_outcomes"](spark, orders).orderBy("queue", "seq").collect()
    assert [(r.queue, r.op, r.id, r.outcome) for r in rows] == outcomes
    assert sum(r.outcome == "published" for r in rows) == len(KEYS)
    assert {"acked", "requeued", "dropped"} <= {r.outcome for r in rows}
    assert sorted((r.queue, r.id, r.state, r.place) for r in QUERIES["queue_state"](spark, orders).collect()) == sorted(left)
    for r in QUERIES["queue_stats"](spark, orders).collect():
        count = lambda *names: sum(q == r.queue and done in names for q, _, _, done in outcomes)
        assert (r.published, r.consumed, r.acked) == (count("published"), count("delivered"), count("acked"))
        assert (r.nacked, r.dead_lettered) == (count("requeued", "dropped", "dead"), count("dead"))


def test_ready_runs_equal_a_scanned_list():
    chance = random.Random(5)
    for levels in (1, 3, 12):
        ready, scanned = Ready(), []
        for i in range(3000):
            message = Message(str(i), b"", chance.randrange(levels), 3)
            act = chance.random()
            if act < 0.35:
                at = next((n for n, m in enumerate(scanned) if m.priority < message.priority), len(scanned))
                scanned.insert(at, message)
                ready.insert(message)
            elif act < 0.6:
                scanned.append(message)
                ready.append(message)
            elif scanned:
                assert ready.pop() is scanned.pop(0)
            assert len(ready) == len(scanned)
            if i % 50 == 0:
                assert list(ready) == scanned


def test_deadlines_of_messages_given_back_or_delivered_again():
    queue = Queue(Limits(ack_deadline_secs=10, prefetch=2))
    for i in "ab":
        queue.publish(Message(i, b"", 5, 5))
    assert queue.consume("c", 0).id == "a" and queue.consume("c", 0).id == "b" and queue.consume("c", 0) is None
    assert queue.nack("a", True) == "requeued" and queue.consume("c", 5).id == "a"
    assert queue.expire(10) == ["b"]  # the second delivery of a has five seconds left
    assert queue.consume("c", 10).id == "b" and queue.consume("c", 10) is None
    assert queue.ack("b") == "acked" and queue.expire(15) == ["a"] and queue.holds["c"] == 0


def test_a_full_queue_of_many_priorities_takes_no_scan():
    queue = Queue(Limits(max_depth=50_000))
    got = [queue.publish(Message(str(i), b"", i % 5, 3)) for i in range(60_000)]
    assert got.count("published") == 50_000 and got[50_000:] == ["full"] * 10_000
    assert [m.priority for m in queue.ready] == sorted((i % 5 for i in range(50_000)), reverse=True)
