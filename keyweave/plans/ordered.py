"""Ordered folds: state carried over the rows of a key, in the order of their seq.

Rows are dealt out by key and sorted, and each task reads its keys one after the
other; only one key's state is held at a time, and no key's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrow's types of the columns that folds give out.
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "timestamp_ntz": pa.timestamp("us")}
#: Rows given out at once.
BATCH = 10_000
#: Groups of keys that stretches are cut at.
GROUPS = 4096


def listed(column: pa.Array) -> list:
    """What ``to_pylist`` gives, without a scalar for each value where that can be."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type) or (not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def stretches(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Rows in order of (group, key, by), cut into compressed stretches: __group, __key, __by, __nth of the first row, __rows.

    They are sorted where they fell by range, so that no task sorts all rows of a key; what
    is sorted afterwards are a few bytes for each row.
    """
    grouped = rows.withColumn("__group", F.pmod(F.hash(key), F.lit(GROUPS)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, so that they are not merged into large ones
    dealt = grouped.repartitionByRange(parts, "__group", key, by).sortWithinPartitions("__group", key, by)
    types = rows.select(key, by).schema
    schema = f"__group int, __key {types[0].dataType.simpleString()}, __by {types[1].dataType.simpleString()}, __nth long, __rows binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options, nth = pa.ipc.IpcWriteOptions(compression="zstd"), 0
        for batch in batches:
            inner, at = batch.drop_columns(["__group"]), 0
            for group, run in groupby(batch.column("__group").to_pylist()):
                part = inner.slice(at, sum(1 for _ in run))
                at += part.num_rows
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                first = [part.column(c).slice(0, 1) for c in (key, by)]
                told = [pa.array([group], pa.int32()), *first, pa.array([nth], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(told, names=["__group", "__key", "__by", "__nth", "__rows"])
                nth += 1

    return dealt.mapInArrow(cut, schema)


def folded(rows: DataFrame, key: str, start: Callable, step: Callable, finish: Callable, schema: str, by: str = "seq", large: bool = False) -> DataFrame:
    """Rows of ``schema`` from ``step(state, row)`` and, after a key's last row, ``finish(state, key)``.

    Both give tuples; ``start()`` makes a key's state.  Rows are dicts in which absent
    values are None, integers stay integers and NaN is a number.  Where a key may hold a
    ``large`` share of all rows, they come to its task as sorted stretches.
    """
    fields = [part.split() for part in schema.split(", ")]
    names, types = [f[0] for f in fields], [TYPES[f[1]] for f in fields]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch in batch.column("__rows"):
                yield from pa.ipc.open_stream(stretch.as_buffer())

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        current, state = None, None
        for batch in batches:
            for values in zip(*map(listed, batch.columns)):
                row = dict(zip(batch.schema.names, values))
                if state is None or row[key] != current:
                    if state is not None:
                        yield from finish(state, current)
                    current, state = row[key], start()
                yield from step(state, row)
        if state is not None:
            yield from finish(state, current)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = told(opened(batches) if large else batches)
        while some := list(islice(out, BATCH)):
            yield packed(some)

    if large:
        dealt = stretches(rows, key, by).repartition("__group").sortWithinPartitions("__group", "__key", "__by", "__nth").select("__rows")
    else:
        dealt = rows.repartition(key).sortWithinPartitions(key, by)
    return dealt.mapInArrow(run, schema)
