"""Bits of a binary value.

Single bits are numbered from a byte's most significant one; the integer fields of
``field_get`` and its companions number them from the least significant one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(value: Column, at: Column) -> Column:
    """A byte as a number; 0 beyond the end."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(value, (at + 1).cast("int"), F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(0))


def get_bit(value: Column, offset: Column) -> Column:
    byte = _byte(value, F.floor(offset / 8))
    return F.shiftright(byte * F.expr("1"), 0).bitwiseAND(_power(7 - F.pmod(offset, F.lit(8)))) / _power(7 - F.pmod(offset, F.lit(8)))


def _power(n: Column) -> Column:
    return F.get(F.array(*[F.lit(1 << i) for i in range(8)]), n.cast("int"))


def bit_count(value: Column) -> Column:
    """Set bits of a binary value."""
    digits = F.split(F.hex(value), "")
    ones = F.array(*[F.lit(bin(i).count("1")) for i in range(16)])
    return F.aggregate(digits, F.lit(0), lambda n, d: n + F.coalesce(F.get(ones, F.conv(F.nullif(d, F.lit("")), 16, 10).cast("int")), F.lit(0)))


def check_width(width: int, signed: bool) -> None:
    if not 1 <= width <= (64 if signed else 63):
        raise ValueError("a field has 1 to 64 bits if signed, else 1 to 63")


def _bytes(value: Column, first: int, last: int) -> list[Column]:
    """Bytes as numbers, 0 beyond the end."""
    digits = F.hex(value)
    return [F.coalesce(F.conv(F.nullif(F.substring(digits, 2 * at + 1, 2), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long")) for at in range(first, last + 1)]


def _signed(bits: Column, width: int) -> Column:
    return F.shiftright(F.shiftleft(bits, 64 - width), 64 - width)


def _unsigned(bits: Column, width: int) -> Column:
    return bits.bitwiseAND(F.lit((1 << width) - 1).cast("long")) if width < 64 else bits


def field_get(value: Column, offset: int, width: int, signed: bool = False) -> Column:
    """A field, least significant bit first; 0 if it passes the end or there is no value."""
    check_width(width, signed)
    first, last, shift = offset // 8, (offset + width - 1) // 8, offset % 8
    parts = _bytes(value, first, last)
    low = parts[0]
    for k, byte in enumerate(parts[1:8], 1):
        low = low.bitwiseOR(F.shiftleft(byte, 8 * k))
    bits = F.shiftrightunsigned(low, shift) if shift else low
    if len(parts) > 8:  # a field of 64 bits or less lies in nine bytes at most
        bits = bits.bitwiseOR(F.shiftleft(parts[8], 64 - shift))
    found = _signed(bits, width) if signed else _unsigned(bits, width)
    return F.when(F.octet_length(value) > last, found).otherwise(F.lit(0).cast("long"))


def field_set(value: Column, offset: int, width: int, new: Column | int) -> Column:
    """The value with its field set; grows as needed, by zero bytes."""
    check_width(width, True)
    new = (F.lit(new) if isinstance(new, int) else new).cast("long")
    old = F.coalesce(value, F.expr("X''"))
    first, last, shift = offset // 8, (offset + width - 1) // 8, offset % 8
    out = []
    for k, byte in enumerate(_bytes(old, first, last)):
        begins, ends = max(0, shift - 8 * k), min(8, shift + width - 8 * k)  # bits of this byte the field has
        mask = ((1 << ends) - 1) & ~((1 << begins) - 1)
        done = 8 * k - shift  # bits of the field in the bytes before
        part = F.shiftrightunsigned(new, done) if done > 0 else F.shiftleft(new, -done) if done < 0 else new
        both = byte.bitwiseAND(F.lit(0xFF & ~mask)).bitwiseOR(part.bitwiseAND(F.lit(mask)))
        out.append(F.lpad(F.hex(both), 2, "0"))
    gap = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(first) - F.octet_length(old), F.lit(0))))
    tail = F.substring(old, F.lit(last + 2), F.greatest(F.octet_length(old) - last - 1, F.lit(0)))
    return F.concat(F.substring(old, F.lit(1), F.lit(first)), gap, F.unhex(F.concat(*out)), tail)


def field_added(value: Column, increment: int, width: int, signed: bool, overflow: str) -> Column:
    """WRAP goes round, SAT stays at the limit, FAIL gives null."""
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    wide = lambda x: F.lit(str(x)).cast("decimal(30,0)")
    total = value.cast("decimal(30,0)") + wide(increment)
    if overflow == "WRAP":
        total = F.pmod(total - wide(low), wide(1 << width)) + wide(low)
    elif overflow == "SAT":
        total = F.least(F.greatest(total, wide(low)), wide(high))
    else:
        total = F.when((total >= wide(low)) & (total <= wide(high)), total)
    return total.cast("long")


def field_incrby(value: Column, offset: int, width: int, signed: bool, increment: int, overflow: str = "WRAP") -> Column:
    """struct(result, value): the field after the increment, null where FAIL refused it."""
    check_width(width, signed)
    total = field_added(field_get(value, offset, width, signed), increment, width, signed, overflow)
    put = F.when(total.isNull(), F.coalesce(value, F.expr("X''"))).otherwise(field_set(value, offset, width, total))
    return F.struct(total.alias("result"), put.alias("value"))
