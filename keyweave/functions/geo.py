"""Coordinates packed into a score, distances and geohashes, all as expressions.

A score holds 26 bits of latitude above 26 bits of longitude, rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 26
#: Metres in a unit of a query's radius or box.
METRES = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
#: The earth's radius in each unit a distance is told in.
EARTH = {"m": 6_371_000.0, "km": 6_371.0, "mi": 3_959.0, "ft": 20_902_231.0}
METRES_PER_DEGREE = 111_000.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def encode(lat: Column, lon: Column) -> Column:
    def scaled(x: Column, offset: float, span: float) -> Column:
        inside = F.least(F.greatest(x + offset, F.lit(0.0)), F.lit(span))
        return F.floor(inside * CELLS / span + 0.5).cast("long")

    return F.shiftleft(scaled(lat, 90.0, 180.0), 26).bitwiseOR(scaled(lon, 180.0, 360.0)).cast("double")


def latitude(score: Column) -> Column:
    return F.shiftright(score.cast("long"), 26).cast("double") * 180.0 / CELLS - 90.0


def longitude(score: Column) -> Column:
    return score.cast("long").bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("double") * 360.0 / CELLS - 180.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "m") -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    up, across = F.sin((a2 - a1) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * F.asin(F.sqrt(up * up + F.cos(a1) * F.cos(a2) * across * across)) * EARTH[unit]


def geohash(lat: Column, lon: Column, length: int = 11) -> Column:
    """Interleaved halvings, longitude first, five bits to a character."""
    bits = 5 * length
    wide, high = (bits + 1) // 2, bits // 2

    def halved(x: Column, offset: float, span: float, n: int) -> Column:
        cell = F.floor((x + offset) / span * float(1 << n)).cast("long")
        return F.least(F.greatest(cell, F.lit(0).cast("long")), F.lit((1 << n) - 1).cast("long"))

    across, up = halved(lon, 180.0, 360.0, wide), halved(lat, 90.0, 180.0, high)

    def bit(i: int) -> Column:
        source, n = (across, wide) if i % 2 == 0 else (up, high)
        return F.shiftright(source, n - 1 - i // 2).bitwiseAND(F.lit(1).cast("long"))

    letters = []
    for c in range(length):
        value = F.lit(0).cast("long")
        for b in range(5):
            value = value * 2 + bit(5 * c + b)
        letters.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)
