"""Command names and the operators they run, for programs that speak in commands.

``Engine.run("ZRANGE", 0, 9)`` returns a DataFrame over the engine's relations; the
collection's name in lower case and a dot (``sortedset.zrange``) says the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import bits
from ..operators import bitmaps, deadlines, geosets, governance, hashes, hll, keyspace, lists, sets, strings, zsets
from ..schemas import OPLOG
from ..streaming import catalogue, groups, pubsub, queues, readers, rooms
from .fold import OPERATIONS


def _timed(function: Callable) -> Callable:
    return lambda engine, *args, **kw: function(engine.relations["string"], *args, now_ms=engine.now_ms, **kw)


def _on(relation: str, function: Callable) -> Callable:
    return lambda engine, *args, **kw: function(engine.relations[relation], *args, **kw)


def _with(relation: str, function: Callable, **fixed) -> Callable:
    return lambda engine, *args, **kw: function(engine.relations[relation], *args, **fixed, **kw)


def _stored(relation: str, module, function: Callable) -> Callable:
    """A command that stores its result: the relation with ``destination`` replaced."""
    return lambda engine, destination, *args, **kw: module.stored(engine.relations[relation], destination, function(engine.relations[relation], *args, **kw))


def _value(function: Callable) -> Callable:
    """A command on the live strings' values: key and what the function makes of the value."""

    def run(engine, *args):
        kv = strings.live(engine.relations["string"], engine.now_ms)
        return kv.select("key", function(kv["value"], *args).alias("value"))

    return run


def _stores(function: Callable) -> Callable:
    return lambda engine, *args, **kw: function({t: engine.relations[t] for t in keyspace.PRECEDENCE if t in engine.relations}, *args, **kw)


def _family(relation: str, module, names: dict[str, str]) -> dict[str, Callable]:
    return {command: _on(relation, getattr(module, name)) for command, name in names.items()}


_STRING = {n.upper(): _timed(getattr(strings, n)) for n in ("get", "mget", "exists", "scan", "keys", "dbsize", "stats", "strlen", "ttl", "expire", "persist")}
_STRING |= {"DEL": _timed(strings.delete), "MDEL": _timed(strings.delete), "MSETNX": _timed(strings.mset_nx), "KVSTATS": _timed(strings.stats)}
_STRING |= {"FLUSHDB": _on("string", strings.flush), "FLUSHALL": _on("string", strings.flush)}

COMMANDS: dict[str, Callable] = {
    **_STRING,
    **_family("hash", hashes, {n.upper(): n for n in ("hget", "hmget", "hkeys", "hvals", "hexists", "hlen", "hset", "hsetnx", "hdel", "hincrby", "hincrbyfloat", "hscan")}),
    **_family("hash", hashes, {"HGETALL": "nested", "HMSET": "hset", "HASHSTATS": "stats"}),
    **_family("list", lists, {n.upper(): n for n in ("llen", "lrange", "lindex", "lpos", "ltrim", "lset", "lrem", "linsert", "rpoplpush")}),
    **_family("list", lists, {"BRPOPLPUSH": "rpoplpush", "BLPOP": "bpop", "LISTSTATS": "stats"}),
    "LPUSH": _with("list", lists.push, left=True),
    "RPUSH": _with("list", lists.push),
    "LPUSHX": _with("list", lists.push, left=True, only_existing=True),
    "RPUSHX": _with("list", lists.push, only_existing=True),
    "LPOP": _with("list", lists.pop),
    "RPOP": _with("list", lists.pop, right=True),
    "BRPOP": _with("list", lists.bpop, right=True),
    **_family("set", sets, {n.upper(): n for n in ("sismember", "smembers", "scard", "sinter", "sunion", "sdiff", "sadd", "srem", "smove", "spop", "srandmember", "sscan")}),
    **_family("set", sets, {"SETSTATS": "stats"}),
    **_family("zset", zsets, {n.upper(): n for n in ("zrank", "zrevrank", "zrange", "zrevrange", "zrangebyscore", "zcount", "zcard", "zscore", "zmscore", "zpopmin", "zpopmax", "zremrangebyrank", "zremrangebyscore", "zrem", "zincrby", "zadd", "zunion", "zinter", "zdiff", "zscan")}),
    **_family("zset", zsets, {"BZPOPMIN": "bzpop", "ZSETSTATS": "stats"}),
    "BZPOPMAX": _with("zset", zsets.bzpop, largest=True),
    **{f"S{n}STORE": _stored("set", sets, getattr(sets, f"s{n.lower()}")) for n in ("INTER", "UNION", "DIFF")},
    **{f"Z{n}STORE": _stored("zset", zsets, getattr(zsets, f"z{n.lower()}")) for n in ("INTER", "UNION", "DIFF")},
    "APPEND": _value(strings.append),
    "GETRANGE": _value(strings.get_range),
    "SETRANGE": _value(strings.set_range),
    "BITFIELD": _value(bits.field_get),
    **_family("bitmap", bitmaps, {n.upper(): n for n in ("setbit", "getbit", "bitcount", "bitpos", "bitop")}),
    **_family("bitmap", bitmaps, {"BITMAPSTATS": "stats"}),
    **_family("sketch", hll, {"PFCOUNT": "pfcount", "PFMERGE": "pfmerge", "HLLSTATS": "stats"}),
    "PFADD": lambda engine, elements: hll.pfadd(elements),
    **_family("geo", geosets, {n.upper(): n for n in ("geopos", "geohash", "geodist", "georadius", "georadiusbymember")}),
    **_family("geo", geosets, {"GEOSEARCH": "geosearch", "GEOSTATS": "stats"}),
    "GEOADD": lambda engine, places, **kw: geosets.geoadd_into(engine.relations["geo"], places, **kw) if "geo" in engine.relations else geosets.geoadd(places),
    "TYPE": _stores(keyspace.key_type),
    "KEYEXISTS": _stores(keyspace.exists),
    "RANDOMKEY": _stores(keyspace.random_key),
    "MEMORY": _stores(keyspace.memory_usage),
    "RENAME": lambda engine, kind, *args: keyspace.rename(engine.relations[kind], *args),
    "RENAMENX": lambda engine, kind, *args: keyspace.rename(engine.relations[kind], *args, only_new=True),
    "INCRBY": lambda engine, deltas: strings.incremented(deltas),
    "DECRBY": lambda engine, deltas: strings.decremented(deltas),
    "MSET": lambda engine, writes: strings.set_latest(writes),
    "GETSET": lambda engine, writes: strings.get_set(writes),
    "COPY": lambda engine, kind, *args, **kw: keyspace.copy(engine.relations[kind], *args, **kw),
    **_family("room", rooms, {"SREAD": "consume", "XREAD": "consume", "XRANGE": "consume", "SLIST": "rooms", "SSTATS": "room_stats"}),
    **_family("topic", rooms, {"CONSUMEPARTITION": "consume_partition", "CONSUMEALL": "consume_all", "TOPICSTATS": "topic_stats"}),
    "PUBLISH": lambda engine, messages: pubsub.route_table(messages, engine.relations["subscription"]),
    "TOPICS": _on("subscription", pubsub.topics),
    "SUBSCRIBE": _on("subscription", pubsub.subscribe),
    "PSUBSCRIBE": _on("subscription", pubsub.subscribe),
    "UNSUBSCRIBE": _on("subscription", pubsub.unsubscribe),
    "QCONSUME": lambda engine, operations, *args: queues.outcomes(operations, *args),
    "QSTATS": lambda engine, operations, *args: queues.stats(queues.outcomes(operations, *args)),
    "QLIST": lambda engine, operations: queues.names(operations),
    **_family("room", readers, {"XREADGROUP": "deliveries", "XDEL": "without"}),
    "XACK": lambda engine, delivered, acks: readers.acknowledged(delivered, acks),
    "XPENDING": lambda engine, delivered, acks: readers.pending(delivered, acks),
    # what exists is told by the commands that made and dropped it
    **{name: (lambda engine, commands: catalogue.outcomes(commands)) for name in ("SCREATE", "SGETORCREATE", "SDELETE", "QCREATE", "QDELETE", "TOPICCREATE", "TOPICDELETE", "GROUPCREATE", "GROUPDELETE")},
    **{name: (lambda engine, commands: groups.members_after(commands)) for name in ("GROUPJOIN", "GROUPLEAVE", "GROUPHEARTBEAT")},
    "GROUPREBALANCE": lambda engine, members, now, partitions, *args: groups.rebalanced(members, now, partitions, *args),
    "SETDEL": _on("set", sets.delete),
    "LISTDEL": _on("list", lists.delete),
    "KEYTTL": lambda engine, kind, ends: deadlines.ttl(engine.relations[kind], ends, engine.now_ms),
    "KEYSINSLOT": lambda engine, keys, slot: governance.keys_in_slot(keys, slot),
    "PSSTATS": lambda engine, routed: pubsub.stats(engine.relations["subscription"], routed),
}

#: Operations that are written to the log and take effect when it is folded.
WRITES = OPERATIONS

# How a collection's name before the dot changes the command after it.
FAMILIES = {"hash": "H", "set": "S"}
SYNONYMS = {
    "set.size": "SCARD", "list.range": "LRANGE", "list.len": "LLEN", "list.index": "LINDEX", "list.set": "LSET", "list.trim": "LTRIM",
    "stream.consume": "SREAD", "stream.list": "SLIST", "stream.stats": "SSTATS", "kv.stats": "KVSTATS", "list.stats": "LISTSTATS",
    "set.stats": "SETSTATS", "hash.stats": "HASHSTATS", "sortedset.stats": "ZSETSTATS", "bitmap.stats": "BITMAPSTATS",
    "hyperloglog.stats": "HLLSTATS", "geospatial.stats": "GEOSTATS", "queue.consume": "QCONSUME", "queue.stats": "QSTATS",
    "queue.list": "QLIST", "key.exists": "KEYEXISTS", "memory.usage": "MEMORY", "pubsub.topics": "TOPICS",
    "pubsub.stats": "PSSTATS", "stream.create": "SCREATE", "stream.delete": "SDELETE", "queue.create": "QCREATE", "queue.delete": "QDELETE",
    "set.del": "SETDEL", "list.del": "LISTDEL", "key.ttl": "KEYTTL",
}


def command_name(command: str) -> str:
    """``hash.get`` is HGET, ``sortedset.zrange`` ZRANGE, ``kv.get`` GET."""
    family, dot, name = command.lower().rpartition(".")
    if not dot:
        return command.upper()
    return SYNONYMS.get(command.lower()) or FAMILIES.get(family, "") + name.upper()


@dataclass
class Engine:
    """Relations by type (string, hash, list, set, zset, bitmap, sketch, geo, room, topic, subscription) at one moment."""

    relations: dict[str, DataFrame] = field(default_factory=dict)
    now_ms: int = 0

    def run(self, command: str, *args, **kw) -> DataFrame | tuple[DataFrame, DataFrame]:
        """What the command reads, or the relations after what it writes; KeyError if there is no such command."""
        name = command_name(command)
        if name not in COMMANDS:
            raise KeyError(f"unknown command {command}")
        return COMMANDS[name](self, *args, **kw)

    def write(self, spark: SparkSession, seq: int, command: str, key: str, *, member: bytes | None = None, value: bytes | None = None, num: float | None = None, args: dict | None = None) -> DataFrame:
        """The command as a row for the operation log."""
        name = command_name(command)
        if name not in WRITES:
            raise KeyError(f"{command} is no operation of the log")
        return spark.createDataFrame([(seq, self.now_ms, name, key, member, value, num, args)], OPLOG)
