"""Expiry arithmetic in epoch milliseconds; ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_expired(expires_at_ms: Column, now_ms: int) -> Column:
    """Inclusive: a value is gone the moment it expires."""
    return F.coalesce(expires_at_ms <= F.lit(now_ms), F.lit(False))


def is_live(expires_at_ms: Column, now_ms: int) -> Column:
    return expires_at_ms.isNull() | (expires_at_ms > F.lit(now_ms))


def ttl_seconds(expires_at_ms: Column, now_ms: int) -> Column:
    """Whole seconds left, 0 if overdue, null if it never expires."""
    return F.when(expires_at_ms.isNotNull(), F.greatest(F.expr("0L"), F.floor((expires_at_ms - now_ms) / 1000)))


def ttl_millis(expires_at_ms: Column, now_ms: int) -> Column:
    return F.when(expires_at_ms.isNotNull(), F.greatest(F.expr("0L"), expires_at_ms - now_ms))


def expires_at(now_ms: int, *, ex: int | None = None, px: int | None = None, exat: int | None = None, pxat: int | None = None) -> int | None:
    """The one expiry option that is given, as epoch milliseconds; no more than a long holds."""
    most = (1 << 63) - 1
    if ex is not None:
        return min(most, now_ms + ex * 1000)
    if px is not None:
        return min(most, now_ms + px)
    if exat is not None:
        return min(most, exat * 1000)
    return pxat


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))
