"""Acknowledged queues: an operation log folded in order, queue by queue.

Whether a message is delivered depends on all operations before, so a queue is folded
by one task; queues run beside each other, and a stream folds them incrementally.
"""

from __future__ import annotations

import marshal
import os
import pickle
import tempfile
from array import array
from bisect import insort
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush, merge
from itertools import batched, groupby
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import folded
from ..plans.staging import placed

OPS = "queue string, seq long, now long, op string, id string, consumer_id string, payload binary, priority int, max_retries int, requeue boolean"
RESULTS = "queue string, seq long, op string, id string, outcome string, retry_count int"
#: Messages of one entry of a queue's state.
SEGMENT = 1024
#: Messages due at once that are sorted in memory.
SORTED = 200_000
STATE = "queue string, id string, state string, place int, priority int, retry_count int, consumer_id string, ack_deadline long"


@dataclass
class Limits:
    max_depth: int = 100_000
    ack_deadline_secs: int = 30
    default_max_retries: int = 3
    default_priority: int = 5
    #: Unacknowledged messages a consumer may hold; 0 for any number.
    prefetch: int = 0


@dataclass(slots=True)
class Message:
    id: str
    payload: bytes
    priority: int
    max_retries: int
    retries: int = 0
    #: Where it stands among the ready ones of its run, counted up as they come; in flight, which delivery of its queue it was.
    place: int = 0
    #: Who holds it while it is in flight, and until when.
    consumer: str | None = None
    deadline: int | None = None

    def values(self) -> tuple:
        return self.id, self.payload, self.priority, self.max_retries, self.retries, self.place, self.consumer, self.deadline


#: Stands for an absent id: no text's bytes.
_NO_ID = b"\xff"


def _bytes(message_id: str | None) -> bytes:
    return _NO_ID if message_id is None else message_id.encode("utf-8", "surrogatepass")


class Spill:
    """A file on the task's own disk, made when first written to, for what its lines hold between their ends."""

    def __init__(self) -> None:
        self.file: BinaryIO | None = None
        self.end = 0

    def keep(self, values: Iterable[tuple]) -> tuple[int, int]:
        """Where it is kept."""
        data = marshal.dumps(list(values))
        if self.file is None:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        at = self.end
        self.file.seek(at)
        self.file.write(data)
        self.end += len(data)
        return at, len(data)

    def kept(self, at: int, size: int) -> list[tuple]:
        self.file.seek(at)
        return marshal.loads(self.file.read(size))

    def put(self, messages: Iterable[Message]) -> tuple[int, int]:
        return self.keep(m.values() for m in messages)

    def get(self, at: int, size: int) -> list[Message]:
        return [Message(*values) for values in self.kept(at, size)]


class Line:
    """First in, first out: of a long line only both ends are in memory, the rest is spilled."""

    #: Messages that are spilled, and read back, at once.
    PART = 4096
    __slots__ = ("spill", "head", "parts", "tail", "size")

    def __init__(self, spill: Spill) -> None:
        self.spill, self.size = spill, 0
        self.head: deque[Message] = deque()
        self.parts: deque[tuple[int, int]] = deque()
        self.tail: list[Message] = []

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[Message]:
        yield from self.head
        for part in self.parts:
            yield from self.spill.get(*part)
        yield from self.tail

    def append(self, message: Message) -> None:
        self.size += 1
        self.tail.append(message)
        if len(self.tail) >= self.PART:
            self.parts.append(self.spill.put(self.tail))
            self.tail = []

    def first(self) -> Message:
        if not self.head:
            if self.parts:
                self.head.extend(self.spill.get(*self.parts.popleft()))
            else:
                self.head.extend(self.tail)
                self.tail = []
        return self.head[0]

    def popleft(self) -> Message:
        self.first()
        self.size -= 1
        return self.head.popleft()


@dataclass
class Ready:
    """Messages in order of delivery, cut into runs where one has a lower priority than all before it.

    A run is named by its first message's priority, so none is scanned to insert one.
    """

    spill: Spill = field(default_factory=Spill)
    runs: dict[int, Line] = field(default_factory=dict)
    #: The runs' names, ascending: the front of the queue is the last one.
    lows: list[int] = field(default_factory=list)
    size: int = 0
    came: int = 0

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[Message]:
        for low in reversed(self.lows):
            yield from self.runs[low]

    def _put(self, message: Message, low: int) -> None:
        if low not in self.runs:
            self.runs[low] = Line(self.spill)
            insort(self.lows, low)
        self.runs[low].append(message)

    def _come(self, message: Message, low: int) -> None:
        message.place = self.came
        self.came += 1
        self.size += 1
        self._put(message, low)

    def insert(self, message: Message) -> None:
        """Before the first of a lower priority."""
        self._come(message, message.priority)

    def append(self, message: Message) -> None:
        """Behind all, whatever its priority."""
        self._come(message, min(self.lows[0], message.priority) if self.lows else message.priority)

    def pop(self) -> Message:
        low = self.lows[-1]
        run = self.runs[low]
        message = run.popleft()
        self.size -= 1
        # requeued ones of higher priority are now first: runs of their own, up to the next of this priority
        above = None
        while run and run.first().priority > low:
            above = run.first().priority if above is None else min(above, run.first().priority)
            self._put(run.popleft(), above)
        if not run:
            del self.runs[low]
            self.lows.remove(low)
        return message


class Flight:
    """Messages in flight by id, in the order of their deliveries: columns and a table of their slots, some 80 bytes a message.

    A slot is one delivery's; slots of messages that are gone are closed up once they are half of all.
    """

    def __init__(self) -> None:
        self.size = 0
        #: The ids one after the other, and where each ends.
        self.ids, self.ends = bytearray(), array("q")
        self.places, self.deadlines = array("q"), array("q")
        self.priorities, self.limits, self.retries = array("i"), array("i"), array("i")
        #: The consumer's number in ``names``; -1 for a slot whose message is gone.
        self.holders = array("i")
        self.names: list[str | None] = []
        self.numbers: dict[str | None, int] = {}
        self.payloads: dict[int, bytes] = {}
        #: Open addressing: a slot, or -1 where there never was one.
        self.table, self.mask = array("i", [-1]) * 64, 63

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[Message]:
        return (self.at(slot) for slot, holder in enumerate(self.holders) if holder >= 0)

    def _id(self, slot: int) -> bytes:
        return bytes(self.ids[self.ends[slot - 1] if slot else 0 : self.ends[slot]])

    def id_of(self, slot: int) -> str | None:
        name = self._id(slot)
        return None if name == _NO_ID else name.decode("utf-8", "surrogatepass")

    def at(self, slot: int) -> Message:
        return Message(self.id_of(slot), self.payloads.get(slot), self.priorities[slot], self.limits[slot], self.retries[slot], self.places[slot], self.names[self.holders[slot]], self.deadlines[slot])

    def _seek(self, name: bytes) -> tuple[int, int]:
        """The slot of the message, or -1, and where the table ends looking for it."""
        table, mask, holders, ids, ends = self.table, self.mask, self.holders, self.ids, self.ends
        at = hash(name) & mask
        while (slot := table[at]) != -1:
            if holders[slot] >= 0 and ids[ends[slot - 1] if slot else 0 : ends[slot]] == name:
                return slot, at
            at = (at + 1) & mask
        return -1, at

    def find(self, message_id: str | None) -> int:
        """The slot of the message, or -1."""
        return self._seek(_bytes(message_id))[0]

    def put(self, message: Message) -> tuple[int, str | None, bool]:
        """The message's slot; one of the same id is replaced where it stands: who held it, and whether there was one."""
        name = _bytes(message.id)
        slot, at = self._seek(name)
        holder = self.numbers.get(message.consumer)
        if holder is None:
            holder = self.numbers[message.consumer] = len(self.names)
            self.names.append(message.consumer)
        before, there = None, slot >= 0
        if there:
            before = self.names[self.holders[slot]]
            self.payloads.pop(slot, None)
            self.holders[slot], self.priorities[slot], self.limits[slot] = holder, message.priority, message.max_retries
            self.retries[slot], self.places[slot], self.deadlines[slot] = message.retries, message.place, message.deadline
        else:
            slot = len(self.holders)
            self.ids += name
            self.ends.append(len(self.ids))
            self.holders.append(holder)
            self.priorities.append(message.priority)
            self.limits.append(message.max_retries)
            self.retries.append(message.retries)
            self.places.append(message.place)
            self.deadlines.append(message.deadline)
            self.size += 1
            self.table[at] = slot
        if message.payload is not None:
            self.payloads[slot] = message.payload
        return slot, before, there

    def _file(self, slot: int) -> None:
        at = hash(self._id(slot)) & self.mask
        while self.table[at] != -1:
            at = (at + 1) & self.mask
        self.table[at] = slot

    def drop(self, slot: int) -> str | None:
        """Who held it."""
        holder = self.names[self.holders[slot]]
        self.holders[slot] = -1
        if self.payloads:
            self.payloads.pop(slot, None)
        self.size -= 1
        return holder

    def crowded(self) -> bool:
        """Whether the slots, gone ones too, need another table."""
        return 3 * len(self.holders) > 2 * self.mask

    def close_up(self) -> bool:
        """Makes the table anew; where half of the slots are of messages that are gone these go, and slots change."""
        moved = 2 * self.size <= len(self.holders)
        if moved:
            live = array("i", (slot for slot, holder in enumerate(self.holders) if holder >= 0))
            self.payloads = {new: self.payloads[old] for new, old in enumerate(live) if old in self.payloads} if self.payloads else {}
            ids, ends = bytearray(), array("q")
            for slot in live:
                ids += self._id(slot)
                ends.append(len(ids))
            self.ids, self.ends = ids, ends
            for column in ("places", "deadlines", "priorities", "limits", "retries", "holders"):
                old = getattr(self, column)
                setattr(self, column, array(old.typecode, (old[slot] for slot in live)))
        self.mask = 63
        while self.mask < 2 * len(self.holders):
            self.mask = 2 * self.mask + 1
        self.table = array("i", [-1]) * (self.mask + 1)
        for slot, holder in enumerate(self.holders):
            if holder >= 0:
                self._file(slot)
        return moved


@dataclass
class Queue:
    """Ready messages in order of delivery, those in flight, and the dead."""

    limits: Limits
    ready: Ready = field(default_factory=Ready)
    pending: Flight = field(default_factory=Flight)
    dead: Line = field(default_factory=lambda: Line(Spill()))
    #: A heap of deadlines, the slots of the messages delivered with each, how many those are, and how many messages each consumer holds.
    deadlines: list[int] = field(default_factory=list)
    due: dict[int, array[int]] = field(default_factory=dict)
    marked: int = 0
    holds: Counter[str] = field(default_factory=Counter)
    #: Deliveries over the queue's life.
    delivered: int = 0

    def publish(self, message: Message) -> str:
        if len(self.ready) >= self.limits.max_depth:
            return "full"
        # behind all of its priority or higher, wherever requeued ones stand
        self.ready.insert(message)
        return "published"

    def _take(self, slot: int) -> Message:
        message = self.pending.at(slot)
        message.consumer = message.deadline = None
        self.holds[self.pending.drop(slot)] -= 1
        return message

    def _mark(self, slot: int, deadline: int) -> None:
        slots = self.due.get(deadline)
        if slots is None:
            slots = self.due[deadline] = array("i")
            heappush(self.deadlines, deadline)
        slots.append(slot)
        self.marked += 1

    def _remark(self) -> None:
        """Only the messages in flight keep their marks."""
        self.due, self.deadlines, self.marked = {}, [], 0
        for slot, holder in enumerate(self.pending.holders):
            if holder >= 0:
                self._mark(slot, self.pending.deadlines[slot])

    def consume(self, consumer: str, now: int) -> Message | None:
        if not self.ready or (self.limits.prefetch and self.holds[consumer] >= self.limits.prefetch):
            return None
        message = self.ready.pop()
        self.delivered += 1
        message.place, message.consumer, message.deadline = self.delivered, consumer, now + self.limits.ack_deadline_secs
        slot, before, there = self.pending.put(message)
        if there:  # published twice: the later delivery counts
            self.holds[before] -= 1
        self.holds[consumer] += 1
        self._mark(slot, message.deadline)
        if self.pending.crowded() and self.pending.close_up() or self.marked > 2 * len(self.pending) + 1000:
            self._remark()
        return message

    def ack(self, message_id: str) -> str:
        slot = self.pending.find(message_id)
        if slot < 0:
            return "not found"
        self.holds[self.pending.drop(slot)] -= 1
        return "acked"

    def nack(self, message_id: str, requeue: bool) -> str:
        """A retry more; beyond the limit it is dead, else at the back of the queue, or gone."""
        slot = self.pending.find(message_id)
        return "not found" if slot < 0 else self._back(self._take(slot), requeue)

    def _back(self, message: Message, requeue: bool) -> str:
        message.retries += 1
        if message.retries > message.max_retries:
            self.dead.append(message)
            return "dead"
        if requeue:
            self.ready.append(message)
            return "requeued"
        return "dropped"

    def _by_id(self, slots: array[int]) -> Iterator[tuple[str, int]]:
        """Marked slots of messages in flight by their ids; long ones are sorted part by part, on disk."""
        told = lambda part: sorted((self.pending._id(slot), slot) for slot in part if self.pending.holders[slot] >= 0)
        if len(slots) <= SORTED:
            return iter(told(slots))
        spill = Spill()
        parts = [[spill.keep(x) for x in batched(told(slots[at : at + SORTED]), 1000)] for at in range(0, len(slots), SORTED)]
        return merge(*[(x for part in one for x in spill.kept(*part)) for one in parts])

    def expire(self, now: int, told: bool = True) -> list[str]:
        """Messages whose deadline has come are requeued, the earliest first."""
        due = []
        while self.deadlines and self.deadlines[0] <= now:
            deadline = heappop(self.deadlines)
            slots = self.due.pop(deadline)
            self.marked -= len(slots)
            for _, slot in self._by_id(slots):
                if self.pending.holders[slot] >= 0 and self.pending.deadlines[slot] == deadline:  # not given back, nor delivered again since
                    message = self._take(slot)
                    self._back(message, True)
                    if told:
                        due.append(message.id)
        return due

    def purge(self) -> int:
        n = len(self.ready)
        self.ready = Ready()
        return n

    def apply(self, row: dict) -> tuple[str | None, str, int | None]:
        """(message, outcome, retries so far) of one operation."""
        op, now = row["op"], int(row["now"])
        if self.deadlines and self.deadlines[0] <= now:
            self.expire(now, told=False)
        if op == "publish":
            priority, retries = row["priority"], row["max_retries"]
            priority = self.limits.default_priority if priority is None or priority != priority else int(priority)
            retries = self.limits.default_max_retries if retries is None or retries != retries else int(retries)
            return row["id"], self.publish(Message(row["id"], row.get("payload"), priority, retries)), 0
        if op == "consume":
            message = self.consume(row["consumer_id"], now)
            return (message.id, "delivered", message.retries) if message else (None, "empty", None)
        if op == "ack":
            return row["id"], self.ack(row["id"]), None
        if op == "nack":
            return row["id"], self.nack(row["id"], bool(row["requeue"])), None
        if op == "purge":
            return None, f"purged {self.purge()}", None
        if op == "create":  # a queue that is there stays as it is
            return None, "created", None
        if op == "delete":
            self.ready, self.pending, self.dead, self.holds = Ready(), Flight(), Line(Spill()), Counter()
            self._remark()
            return None, "deleted", None
        if op == "sweep":
            return None, "swept", None
        return row["id"], "unknown operation", None

    def entries(self) -> Iterator[tuple[str, bytes]]:
        """The queue as entries of up to ``SEGMENT`` messages, named by where those are: in a run of the ready, in flight, or dead.

        Messages keep the segment they came to, so an operation changes few entries.
        """
        at = lambda m: m.place // SEGMENT
        for low, run in self.ready.runs.items():
            for segment, some in groupby(run, at):
                yield f"ready {low} {segment}", pickle.dumps([m.values() for m in some])
        places, held = self.pending.places, self.pending.holders
        slots = sorted((slot for slot in range(len(held)) if held[slot] >= 0), key=places.__getitem__)
        for segment, some in groupby(slots, lambda slot: places[slot] // SEGMENT):
            yield f"pending {segment} 0", pickle.dumps([self.pending.at(slot).values() for slot in some])
        for segment, some in groupby(enumerate(self.dead), lambda x: x[0] // SEGMENT):
            yield f"dead {segment} 0", pickle.dumps([m.values() for _, m in some])

    def packed(self) -> dict[str, bytes]:
        return dict(self.entries())

    @classmethod
    def unpacked(cls, entries: dict[str, bytes], limits: Limits) -> Queue:
        queue = cls(limits)
        for kind, one, two, name in sorted((kind, int(one), int(two), n) for n in entries for kind, one, two in [n.split(" ")]):  # in the order of their places
            value = pickle.loads(entries[name])
            if kind == "ready" and one not in queue.ready.runs:
                queue.ready.runs[one] = Line(queue.ready.spill)
            # a tuple is the single message of an entry written before entries held several
            for message in [Message(*v) for v in value] if isinstance(value, list) else [cls._single(kind, one, value)]:
                if kind == "pending":
                    queue.pending.put(message)
                    if queue.pending.crowded():
                        queue.pending.close_up()
                    queue.delivered = message.place
                    queue.holds[message.consumer] += 1
                elif kind == "ready":
                    queue.ready.runs[one].append(message)
                    queue.ready.size += 1
                    queue.ready.came = max(queue.ready.came, message.place + 1)
                else:
                    queue.dead.append(message)
        queue.ready.lows = sorted(queue.ready.runs)
        queue._remark()
        return queue

    @staticmethod
    def _single(kind: str, one: int, value: tuple) -> Message:
        if kind != "pending":
            return Message(*value)
        message = Message(*value[0])
        message.place, message.consumer, message.deadline = one, value[1], value[2]
        return message

    def rows(self, name: str) -> Iterator[tuple]:
        for i, m in enumerate(self.ready):
            yield name, m.id, "ready", i, m.priority, m.retries, None, None
        for i, m in enumerate(self.pending):
            yield name, m.id, "pending", i, m.priority, m.retries, m.consumer, m.deadline
        for i, m in enumerate(self.dead):
            yield name, m.id, "dead", i, m.priority, m.retries, None, None


def _folded(operations: DataFrame, limits: Limits, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """No result shows a payload, so none is carried along."""
    return folded(operations.drop("payload"), "queue", lambda: Queue(limits), step, finish, schema, large=True)


def outcomes(operations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What each operation did: queue, seq, op, id, outcome, retry_count."""

    def step(queue: Queue, row: dict) -> list[tuple]:
        return [(row["queue"], row["seq"], row["op"], *queue.apply(row))]

    return _folded(operations, limits, step, lambda queue, name: [], RESULTS)


def state_after(operations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All messages once every operation is done: ready, pending and dead, in order."""

    def step(queue: Queue, row: dict) -> list[tuple]:
        queue.apply(row)
        return []

    return _folded(operations, limits, step, Queue.rows, STATE)


def names(operations: DataFrame) -> DataFrame:
    """The queues there are once all creations and deletions are done; publishing to one makes it."""
    makes = F.col("op").isin("create", "publish")
    last = operations.filter(makes | (F.col("op") == "delete")).groupBy("queue").agg(F.max_by("op", "seq").alias("op"))
    return last.filter(F.col("op") != "delete").select("queue")


def delivery_order(messages: DataFrame) -> DataFrame:
    """The order in which messages(queue, seq, priority) that are never requeued are delivered; no task orders a whole queue."""
    return placed(messages, ["queue"], [F.col("priority").desc(), F.col("seq").asc()], "place")


def stats(results: DataFrame) -> DataFrame:
    """Counters of each queue from its outcomes."""
    count = lambda *names: F.count(F.when(F.col("outcome").isin(*names), 1))
    return results.groupBy("queue").agg(
        count("published").alias("published"),
        count("delivered").alias("consumed"),
        count("acked").alias("acked"),
        F.count(F.when((F.col("op") == "nack") & F.col("outcome").isin("requeued", "dropped", "dead"), 1)).alias("nacked"),
        count("dead").alias("dead_lettered"),
    )
