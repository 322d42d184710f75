"""State as a fold of the operation log, key by key.

Most operations need no order beyond "the last wins" and are aggregates
(``latest_values``, ``counters``).  Conditional ones (SET NX/XX/KEEPTTL, ZADD NX/GT,
list pushes and pops) depend on all before them; they are folded in order, a key by
one task, which holds that key's state alone, and keys spread over the cluster.

An operation that its key refuses, that is unknown or lacks what it needs changes
nothing: its reply says why, and the fold of all others goes on.
"""

from __future__ import annotations

import math
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import folded

STATE = "key string, type string, member binary, value binary, num double, expires_at_ms long"
#: ``whole`` is an integer answer, ``num`` one that need not be; ``error`` says why nothing was done.
REPLIES = "seq long, key string, op string, ok boolean, value binary, num double, whole long, error string"
_INTEGER = re.compile(rb"[+-]?[0-9]+").fullmatch
LONG = 1 << 63


def latest_values(oplog: DataFrame) -> DataFrame:
    """Plain SETs and DELs: the last operation of a key decides. One shuffle, combined on the map side."""
    last = F.max_by(F.struct("op", "value", F.try_element_at("args", F.lit("expires_at_ms")).cast("long").alias("expires_at_ms")), "seq")
    folded = oplog.filter(F.col("op").isin("SET", "DEL")).groupBy("key").agg(last.alias("w"))
    return folded.filter("w.op = 'SET'").select("key", "w.value", "w.expires_at_ms")


def counters(oplog: DataFrame) -> DataFrame:
    """INCRBY and DECRBY; integers that overflow raise."""
    sign = F.when(F.col("op") == "DECRBY", -F.col("num")).otherwise(F.col("num"))
    return oplog.filter(F.col("op").isin("INCRBY", "DECRBY")).groupBy("key").agg(F.sum(sign.cast("long")).alias("counter"))


class Refused(ValueError):
    """An operation that its key's state refuses, with the reason."""


def integer(text: bytes | None) -> int:
    """A 64-bit integer written as digits with at most a sign; absent is 0."""
    if text is None:
        return 0
    if not _INTEGER(text) or not -LONG <= int(text) < LONG:
        raise Refused("value is not an integer or out of range")
    return int(text)


def given(row: dict) -> int:
    """The integer an operation brings: ``by`` among its arguments where a double could not hold it, else ``num``."""
    args = row["args"]
    if "by" in args:
        return integer(args["by"].encode())
    num = row["num"]
    if num is None or not math.isfinite(num) or num != int(num):
        raise Refused("increment is not an integer")
    return int(num)


def added(old: int, more: int) -> int:
    if not -LONG <= old + more < LONG:
        raise Refused("increment or decrement would overflow")
    return old + more


def number(row: dict) -> float:
    if row["num"] is None:
        raise Refused("a number is missing")
    return row["num"]


def present(row: dict, *names: str) -> None:
    for name in names:
        if row[name] is None:
            raise Refused(f"{name} is missing")


class Reply(tuple):
    """(done, the value, the number, the integer it answers with)."""

    def __new__(cls, done: bool, value: bytes | None = None, num: float | None = None, whole: int | None = None):
        return super().__new__(cls, (bool(done), value, num, whole))


def by_score(item: tuple[bytes, float]) -> tuple:
    return not math.isnan(item[1]), 0.0 if math.isnan(item[1]) else item[1], item[0]


class Key:
    """What one key holds, in whichever of the types it was first used as."""

    def __init__(self) -> None:
        self.string: bytes | None = None
        self.expires: int | None = None
        self.zset: dict[bytes, float] = {}
        self.hash: dict[bytes, bytes] = {}
        self.set: set[bytes] = set()
        self.list: deque[bytes] = deque()

    def live(self, now: int) -> bool:
        return self.string is not None and (self.expires is None or self.expires > now)

    def apply(self, row: dict) -> tuple:
        """(done, value, number, integer, error) of one operation."""
        row = row | {"args": dict(row["args"]) if row["args"] is not None else {}}
        now = row["ts_ms"] or 0
        if not self.live(now):
            self.string = self.expires = None
        handler = getattr(self, f"do_{(row['op'] or '').lower()}", None)
        try:
            if handler is None:
                raise Refused("unknown operation")
            return (*handler(row, row["args"], now), None)
        except Refused as why:
            return False, None, None, None, str(why)

    # strings

    def do_set(self, row, args, now):
        present(row, "value")
        there, old = self.live(now), self.string
        answer = old if "GET" in args else None
        if ("NX" in args and there) or ("XX" in args and not there):
            return Reply(False, answer if "NX" in args else None)
        at = integer(args["expires_at_ms"].encode()) if "expires_at_ms" in args else None
        self.string, self.expires = row["value"], self.expires if "KEEPTTL" in args else at
        return Reply(True, answer)

    def do_del(self, row, args, now):
        there = self.live(now) or bool(self.zset or self.hash or self.set or self.list)
        self.__init__()
        return Reply(there)

    def _counted(self, more: int) -> Reply:
        new = added(integer(self.string), more)
        self.string = str(new).encode()
        return Reply(True, whole=new)

    def do_incrby(self, row, args, now):
        return self._counted(given(row))

    def do_decrby(self, row, args, now):
        return self._counted(-given(row))

    def do_append(self, row, args, now):
        self.string = (self.string or b"") + (row["value"] or b"")
        return Reply(True, whole=len(self.string))

    def do_getset(self, row, args, now):
        present(row, "value")
        old, self.string, self.expires = self.string, row["value"], None
        return Reply(True, old)

    def do_expire(self, row, args, now):
        seconds = given(row)
        if not self.live(now):
            return Reply(False)
        self.expires = now + seconds * 1000
        return Reply(True)

    def do_persist(self, row, args, now):
        had, self.expires = self.expires is not None, None
        return Reply(had)

    # sorted sets

    def do_zadd(self, row, args, now):
        present(row, "member")
        member, num = row["member"], number(row)
        old = self.zset.get(member)
        refused = ("NX" in args and old is not None) or ("XX" in args and old is None)
        if old is not None:
            refused = refused or ("GT" in args and num <= old) or ("LT" in args and num >= old)
        if refused:
            return Reply(False, whole=0)
        self.zset[member] = old + num if "INCR" in args and old is not None else num
        changed = old is None or self.zset[member] != old
        return Reply(True, whole=int(changed if "CH" in args else old is None))

    def do_zincrby(self, row, args, now):
        present(row, "member")
        self.zset[row["member"]] = self.zset.get(row["member"], 0.0) + number(row)
        return Reply(True, num=self.zset[row["member"]])

    def do_zrem(self, row, args, now):
        return Reply(self.zset.pop(row["member"], None) is not None)

    def _zpop(self, largest: bool) -> Reply:
        if not self.zset:
            return Reply(False)
        member, score = (max if largest else min)(self.zset.items(), key=by_score)
        del self.zset[member]
        return Reply(True, member, score)

    def do_zpopmin(self, row, args, now):
        return self._zpop(False)

    def do_zpopmax(self, row, args, now):
        return self._zpop(True)

    # hashes

    def do_hset(self, row, args, now):
        present(row, "member", "value")
        new = row["member"] not in self.hash
        if "NX" in args and not new:
            return Reply(False)
        self.hash[row["member"]] = row["value"]
        return Reply(new)

    def do_hdel(self, row, args, now):
        return Reply(self.hash.pop(row["member"], None) is not None)

    def do_hincrby(self, row, args, now):
        present(row, "member")
        new = added(integer(self.hash.get(row["member"])), given(row))
        self.hash[row["member"]] = str(new).encode()
        return Reply(True, whole=new)

    # sets

    def do_sadd(self, row, args, now):
        present(row, "member")
        new = row["member"] not in self.set
        self.set.add(row["member"])
        return Reply(new)

    def do_srem(self, row, args, now):
        there = row["member"] in self.set
        self.set.discard(row["member"])
        return Reply(there)

    # lists

    def _push(self, row, args, put) -> Reply:
        present(row, "value")
        if "X" in args and not self.list:
            return Reply(False, whole=0)
        put(row["value"])
        return Reply(True, whole=len(self.list))

    def do_lpush(self, row, args, now):
        return self._push(row, args, self.list.appendleft)

    def do_rpush(self, row, args, now):
        return self._push(row, args, self.list.append)

    def do_lpop(self, row, args, now):
        return Reply(True, self.list.popleft()) if self.list else Reply(False)

    def do_rpop(self, row, args, now):
        return Reply(True, self.list.pop()) if self.list else Reply(False)

    def do_lset(self, row, args, now):
        present(row, "value")
        at = given(row)
        if not -len(self.list) <= at < len(self.list):
            raise Refused("index is out of range")
        self.list[at] = row["value"]
        return Reply(True)

    def do_ltrim(self, row, args, now):
        start, stop = integer(args.get("start", "0").encode()), integer(args.get("stop", "-1").encode())
        n = len(self.list)
        first, last = max(start + n, 0) if start < 0 else start, stop + n if stop < 0 else min(stop, n - 1)
        for _ in range(n - 1 - last if last >= first else n):
            self.list.pop()
        for _ in range(min(first, len(self.list))):
            self.list.popleft()
        return Reply(True)

    def rows(self, key: str):
        if self.string is not None:
            yield key, "string", None, self.string, None, self.expires
        for m, s in sorted(self.zset.items()):
            yield key, "zset", m, None, s, None
        for f, v in sorted(self.hash.items()):
            yield key, "hash", f, v, None, None
        for m in sorted(self.set):
            yield key, "set", m, None, None, None
        for i, v in enumerate(self.list):
            yield key, "list", None, v, float(i), None


#: Operations that the fold knows.
OPERATIONS = tuple(sorted(n[3:].upper() for n in vars(Key) if n.startswith("do_")))


def state_after(oplog: DataFrame) -> DataFrame:
    """All that every key holds once the log is applied in order of seq."""

    def step(state: Key, row: dict) -> list[tuple]:
        state.apply(row)
        return []

    return folded(oplog, "key", Key, step, Key.rows, STATE)


def replies(oplog: DataFrame) -> DataFrame:
    """What each operation answered."""

    def step(state: Key, row: dict) -> list[tuple]:
        return [(row["seq"], row["key"], row["op"], *state.apply(row))]

    return folded(oplog, "key", Key, step, lambda state, key: [], REPLIES)


def state_as_oplog(state: DataFrame) -> DataFrame:
    """A snapshot as operations at seq -1 and after nothing, so that snapshot and tail fold as one log."""
    op = F.expr("CASE type WHEN 'string' THEN 'SET' WHEN 'zset' THEN 'ZADD' WHEN 'hash' THEN 'HSET' WHEN 'set' THEN 'SADD' ELSE 'RPUSH' END")
    args = F.when(F.col("expires_at_ms").isNotNull(), F.create_map(F.lit("expires_at_ms"), F.col("expires_at_ms").cast("string")))
    # list elements keep their order: their place is their seq, all before the tail
    seq = F.when(F.col("type") == "list", F.col("num").cast("long")).otherwise(0) - F.expr("1000000000000L")
    return state.select(seq.alias("seq"), F.lit(0).cast("long").alias("ts_ms"), op.alias("op"), "key", "member", "value", F.when(F.col("type") == "zset", F.col("num")).alias("num"), args.alias("args"))


def recover(state: DataFrame, tail: DataFrame) -> DataFrame:
    """State of a snapshot with the log's tail applied."""
    columns = ["seq", "ts_ms", "op", "key", "member", "value", "num", "args"]
    return state_after(state_as_oplog(state).unionByName(tail.select(*columns)))
