"""Pure functions: patterns, ranges, bits, slots, coordinates."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyweave.functions import bits, geo, glob, slots, topics, ttl
from keyweave.functions.ranges import within


def matches(pattern, text):
    """Glob matching by recursion on bytes of ASCII text."""
    if not pattern:
        return not text
    if pattern[0] == "*":
        return matches(pattern[1:], text) or bool(text) and matches(pattern, text[1:])
    if not text:
        return False
    if pattern[0] == "?":
        return matches(pattern[1:], text[1:])
    if pattern[0] == "\\" and len(pattern) > 1:
        return pattern[1] == text[0] and matches(pattern[2:], text[1:])
    return pattern[0] == text[0] and matches(pattern[1:], text[1:])


@given(st.text("ab*?.", max_size=7), st.text("ab.", max_size=7))
def test_globs_match_as_defined(pattern, text):
    java = glob.glob_regex(pattern).replace(r"\z", r"\Z")
    assert bool(re.search(java, text)) == matches(pattern, text)


@pytest.mark.parametrize(
    "pattern, text, fits",
    [("h?llo", "hello", True), ("h[ae]llo", "hallo", True), ("h[^e]llo", "hello", False), ("h[a-c]t", "hbt", True), ("a[", "a[", False), ("[]x", "x", False), (r"a\*b", "a*b", True), (r"a\*b", "aab", False)],
)
def test_glob_classes(spark, pattern, text, fits):
    assert spark.range(1).select(glob.glob_match(F.lit(text), pattern)).first()[0] is fits


@pytest.mark.parametrize(
    "pattern, topic, fits",
    [("a.*", "a.b", True), ("a.*", "a.b.c", False), ("a.#", "a", True), ("a.#", "a.b.c", True), ("a.#", "ab", False), ("#", "x.y", True), ("a.us*.c", "a.user.c", True), ("a.us*.c", "a.u.c", False), ("a.b", "a.b", True)],
)
def test_topics(spark, pattern, topic, fits):
    assert spark.range(1).select(F.lit(topic).rlike(topics.topic_regex(pattern))).first()[0] is fits


def test_topic_patterns_that_are_refused():
    for bad in ("a.#.b", "#.#"):
        with pytest.raises(ValueError):
            topics.topic_regex(bad)


@given(st.integers(-6, 6), st.integers(-6, 6))
def test_ranges_are_slices(start, stop):
    size = 4
    first = start if start >= 0 else max(size + start, 0)
    last = min(stop, size - 1) if stop >= 0 else size + stop
    assert [i for i in range(size) if first <= i <= last] == list(range(size))[first : last + 1 if last >= 0 else 0]


def test_ranges_in_columns(spark):
    rows = spark.range(5).withColumn("n", F.lit(5).cast("long"))
    assert [r[0] for r in rows.filter(within(F.col("id"), F.col("n"), -2, -1)).collect()] == [3, 4]
    assert [r[0] for r in rows.filter(within(F.col("id"), F.col("n"), 1, 99)).collect()] == [1, 2, 3, 4]


def test_crc16_by_brute_force(spark):
    words = [b"", b"123456789", "é日本".encode(), bytes(range(256)), b"a" * 1000]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w binary").select("i", slots.crc16(F.col("w")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: slots.crc16_of(w) for i, w in enumerate(words)}


def test_crc16_and_tags(spark):
    assert slots.crc16_of(b"123456789") == 0x31C3
    rows = spark.createDataFrame([("{user}:a",), ("user",), ("{}{x}",), ("no{close",)], "key string")
    got = {r.key: r.slot for r in rows.select("key", slots.hash_slot(F.col("key")).alias("slot")).collect()}
    assert got["{user}:a"] == got["user"] == slots.crc16_of(b"user") % 16384
    assert got["{}{x}"] == slots.crc16_of(b"{}{x}") % 16384
    owners = spark.createDataFrame([(0,), (5460,), (5461,), (16383,)], "slot int").select(slots.even_owner(F.col("slot"), 3)).collect()
    assert [r[0] for r in owners] == [0, 0, 1, 2]


def field_of(data, offset, width, signed):
    """A field of a whole number, least significant bit first; 0 if it passes the end."""
    if (offset + width - 1) // 8 >= len(data):
        return 0
    value = int.from_bytes(data, "little") >> offset & ((1 << width) - 1)
    return value - (1 << width) if signed and value >> (width - 1) else value


def field_put(data, offset, width, value):
    size = max(len(data), (offset + width - 1) // 8 + 1)
    mask = (1 << width) - 1
    return (int.from_bytes(data, "little") & ~(mask << offset) | (value & mask) << offset).to_bytes(size, "little")


def test_fields_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, bytes(r.randrange(256) for _ in range(r.randrange(0, 14))), r.randrange(-(1 << 62), 1 << 62)) for i in range(40)] + [(99, None, 5)]
    df = spark.createDataFrame(rows, "i int, v binary, n long").repartition(1).cache()
    for offset, width, signed in [(0, 8, False), (4, 12, True), (3, 1, False), (7, 64, True), (1, 63, False), (13, 33, True), (40, 5, False), (0, 64, True), (6, 63, True)]:
        for mode, more in (("WRAP", 1000), ("SAT", -7), ("FAIL", 3), ("SAT", 1 << 62)):
            got = df.select(
                "i",
                bits.field_get(F.col("v"), offset, width, signed).alias("got"),
                bits.field_set(F.col("v"), offset, width, F.col("n")).alias("put"),
                bits.field_incrby(F.col("v"), offset, width, signed, more, mode).alias("a"),
            ).collect()
            low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
            for x, (_, v, n) in zip(sorted(got, key=lambda x: x.i), rows):
                data = v or b""
                old = field_of(data, offset, width, signed)
                assert x.got == old and bytes(x.put) == field_put(data, offset, width, n), (offset, width, signed)
                total = old + more
                if not low <= total <= high:
                    total = (total - low) % (1 << width) + low if mode == "WRAP" else min(max(total, low), high) if mode == "SAT" else None
                assert x.a.result == total
                assert bytes(x.a.value) == (data if total is None else field_put(data, offset, width, total))
    with pytest.raises(ValueError):
        bits.check_width(64, False)


def test_bits_of_values(spark):
    row = spark.createDataFrame([(b"\x80\x01",)], "v binary").select(bits.bit_count(F.col("v")), bits.get_bit(F.col("v"), F.lit(0)), bits.get_bit(F.col("v"), F.lit(15)), bits.get_bit(F.col("v"), F.lit(99))).first()
    assert row[0] == 2 and [int(x) for x in row[1:]] == [1, 1, 0]


def test_distances_and_geohash(spark):
    cities = spark.createDataFrame([(37.7749, -122.4194, 40.7128, -74.0060)], "a double, b double, c double, d double")
    km, code = cities.select(geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"), "km"), geo.geohash(F.col("a"), F.col("b"))).first()
    assert abs(km - 4129) < 5
    assert code.startswith("9q8yy")
    score = geo.encode(F.col("a"), F.col("b"))
    lat, lon = cities.select(geo.latitude(score), geo.longitude(score)).first()
    assert abs(lat - 37.7749) < 1e-5 and abs(lon + 122.4194) < 1e-5


def test_expiry():
    assert ttl.expires_at(1000, ex=2) == 3000 and ttl.expires_at(1000, px=5) == 1005
    assert ttl.expires_at(0, exat=7) == 7000 and ttl.expires_at(0, pxat=8) == 8 and ttl.expires_at(0) is None
