"""Checksums of binary values in the engine's own functions, and of whole relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _table() -> list[int]:
    """CRC-64/XZ: polynomial 0x42F0E1EBA9EA3693, least significant bit first."""
    out = []
    for byte in range(256):
        crc = byte
        for _ in range(8):
            crc = crc >> 1 ^ 0xC96C5795D7870F42 if crc & 1 else crc >> 1
        out.append(crc)
    return out


CRC64 = _table()


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def crc64_of(data: bytes) -> int:
    crc = (1 << 64) - 1
    for byte in data:
        crc = CRC64[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ (1 << 64) - 1


def crc64(data: Column) -> Column:
    """CRC64 of a binary value as 16 hexadecimal digits."""
    digits = F.hex(data)
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    table = F.array(*[F.lit(_long(c)).cast("long") for c in CRC64])
    byte = lambda at: F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("long")
    step = lambda crc, at: F.get(table, crc.bitwiseXOR(byte(at)).bitwiseAND(F.lit(0xFF).cast("long")).cast("int")).bitwiseXOR(F.shiftrightunsigned(crc, 8))
    whole = F.aggregate(places, F.lit(-1).cast("long"), step).bitwiseXOR(F.lit(-1).cast("long"))
    found = F.when(F.length(digits) > 0, whole).otherwise(F.lit(0).cast("long"))
    return F.when(data.isNotNull(), F.lower(F.lpad(F.hex(found), 16, "0")))


def checksum(relation: DataFrame) -> DataFrame:
    """rows, checksum: one number for all rows in whatever order, to tell whether a copy is the same."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in relation.columns])
    return relation.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0).cast("long")).alias("checksum"))
