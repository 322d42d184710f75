"""Inclusive index ranges in which negative numbers count from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_index(start: int, size: Column) -> Column:
    return F.lit(start).cast("long") if start >= 0 else F.greatest(size + start, F.lit(0).cast("long"))


def last_index(stop: int, size: Column) -> Column:
    return F.least(F.lit(stop).cast("long"), size - 1) if stop >= 0 else size + stop


def within(index: Column, size: Column, start: int, stop: int) -> Column:
    return (index >= first_index(start, size)) & (index <= last_index(stop, size))
