"""Hash tags, CRC16 slots and their owners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16_384


def _table() -> list[int]:
    """CRC16 XMODEM: polynomial 0x1021, most significant bit first."""
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1
        out.append(crc & 0xFFFF)
    return out


CRC16 = _table()


def crc16_of(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc = crc << 8 & 0xFFFF ^ CRC16[crc >> 8 ^ byte]
    return crc


def hash_tag(key: Column) -> Column:
    """What stands between the first brace and the next closing one; null if nothing does."""
    return F.nullif(F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1), F.lit(""))


def crc16(data: Column) -> Column:
    """CRC16 of a binary value, byte by byte in the engine's own functions."""
    digits = F.hex(data)
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    table = F.array(*[F.lit(c) for c in CRC16])
    byte = lambda at: F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("int")
    step = lambda crc, at: F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(byte(at))))
    return F.when(data.isNotNull(), F.when(F.length(digits) > 0, F.aggregate(places, F.lit(0), step)).otherwise(0))


def hash_slot(key: Column) -> Column:
    return F.pmod(crc16(F.encode(F.coalesce(hash_tag(key), key), "UTF-8")), F.lit(SLOTS)).cast("int")


def even_owner(slot: Column, nodes: int) -> Column:
    """The node that holds a slot when each has as many and the last the rest."""
    return F.least(F.floor(slot / (SLOTS // nodes)), F.lit(nodes - 1)).cast("int")
