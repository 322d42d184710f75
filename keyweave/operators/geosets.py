"""Geo sets: sorted sets whose scores are packed coordinates."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .paging import requested
from .zsets import zadd


def geoadd(places: DataFrame) -> DataFrame:
    """zset(key, member, score) of places(key, member, lat, lon); a coordinate out of range raises."""
    fits = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    checked = F.when(fits, geo.encode(F.col("lat"), F.col("lon"))).otherwise(F.raise_error(F.lit("a coordinate is out of range")).cast("double"))
    return places.select("key", "member", checked.alias("score"))


def geoadd_into(geos: DataFrame, places: DataFrame, *, nx: bool = False, xx: bool = False, ch: bool = False) -> tuple[DataFrame, DataFrame]:
    """GEOADD with its options: how many members of each key were added (with ``ch``: added or moved), and the geo sets after."""
    after = zadd(geos, geoadd(places), nx=nx, xx=xx)
    counted = F.col("changed") if ch else F.col("added")
    counts = after.groupBy("key").agg(F.count(F.when(counted, 1)).alias("n")).join(places.select("key").distinct(), "key", "left_semi")
    return counts, after.select("key", "member", "score")


def located(geos: DataFrame) -> DataFrame:
    return geos.withColumns({"lat": geo.latitude(F.col("score")), "lon": geo.longitude(F.col("score"))})


def geopos(geos: DataFrame, key: str, members: list[bytes]) -> DataFrame:
    found = requested(geos.filter(F.col("key") == key), members, "member", "score")
    return located(found).drop("score")


def geohash(geos: DataFrame, length: int = 11) -> DataFrame:
    return located(geos).select("key", "member", geo.geohash(F.col("lat"), F.col("lon"), length).alias("geohash"))


def geodist(geos: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """Distances of pairs(key, member1, member2); null if a member is absent."""
    at = located(geos)
    a = at.select("key", F.col("member").alias("member1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = at.select("key", F.col("member").alias("member2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    joined = pairs.join(a, ["key", "member1"], "left").join(b, ["key", "member2"], "left")
    return joined.select("key", "member1", "member2", geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), unit).alias("distance"))


def _nearest(found: DataFrame, count: int | None, descending: bool) -> DataFrame:
    by = F.col("distance").desc() if descending else F.col("distance").asc()
    ordered = found.orderBy(by, "member")
    return ordered.limit(count) if count is not None else ordered


def georadius(geos: DataFrame, lat: float, lon: float, radius: float, unit: str = "m", *, count: int | None = None, descending: bool = False) -> DataFrame:
    """Members within the radius, by true distance. A box of degrees around the circle goes first.

    The box is on the decoded coordinates; where it passes a pole or the date line only
    the distance decides.
    """
    metres = radius * geo.METRES[unit]
    at = located(geos)
    up = metres / geo.METRES_PER_DEGREE * 1.01
    box = F.col("lat").between(lat - up, lat + up)
    if abs(lat) + up < 89:
        across = up / cos(radians(abs(lat) + up))
        if lon - across > -180 and lon + across < 180:
            box = box & F.col("lon").between(lon - across, lon + across)
    here = F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")
    found = at.filter(box).filter(geo.haversine(*here) <= metres).withColumn("distance", geo.haversine(*here, unit))
    return _nearest(found, count, descending)


def georadiusbymember(geos: DataFrame, key: str, member: bytes, radius: float, unit: str = "m", *, count: int | None = None, descending: bool = False) -> DataFrame:
    """Around a member of one key: the centre is a single row, joined to the rest."""
    at = located(geos.filter(F.col("key") == key))
    centre = at.filter(F.col("member") == F.lit(member)).select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon")).limit(1)
    joined = at.crossJoin(F.broadcast(centre))
    here = F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")
    found = joined.filter(geo.haversine(*here) <= radius * geo.METRES[unit]).withColumn("distance", geo.haversine(*here, unit))
    return _nearest(found.drop("__lat", "__lon"), count, descending)


def geosearch_box(geos: DataFrame, lat: float, lon: float, width: float, height: float, unit: str = "m", *, count: int | None = None, descending: bool = False) -> DataFrame:
    """Members in a box around a point, sides in ``unit``, 111 km to a degree."""
    half_height = height * geo.METRES[unit] / 2 / geo.METRES_PER_DEGREE
    half_width = width * geo.METRES[unit] / 2 / (geo.METRES_PER_DEGREE * cos(radians(lat)))
    inside = F.col("lat").between(lat - half_height, lat + half_height) & F.col("lon").between(lon - half_width, lon + half_width)
    found = located(geos).filter(inside).withColumn("distance", geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"), unit))
    return _nearest(found, count, descending)


def geosearch(geos: DataFrame, key: str, *, member: bytes | None = None, at: tuple[float, float] | None = None, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, descending: bool = False) -> DataFrame:
    """GEOSEARCH: around a member or a point (lat, lon), within a radius or a box (width, height).

    Exactly one of each pair is given.  A member that is absent is around nothing.
    """
    if (member is None) == (at is None) or (radius is None) == (box is None):
        raise ValueError("a search has one centre and one shape")
    own = geos.filter(F.col("key") == key)
    if member is not None:
        if radius is not None:
            return georadiusbymember(own, key, member, radius, unit, count=count, descending=descending)
        centre = located(own.filter(F.col("member") == F.lit(member))).select("lat", "lon").first()
        if centre is None:
            return located(own.limit(0)).withColumn("distance", F.lit(0.0))
        at = (centre["lat"], centre["lon"])
    if radius is not None:
        return georadius(own, *at, radius, unit, count=count, descending=descending)
    return geosearch_box(own, *at, *box, unit, count=count, descending=descending)


def stats(geos: DataFrame) -> DataFrame:
    return geos.agg(F.countDistinct("key").alias("total_keys"), F.count(F.lit(1)).alias("total_locations"))
