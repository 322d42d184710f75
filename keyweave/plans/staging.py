"""Tables written between steps, and places in a total order that no single task sorts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse
from urllib.request import url2pathname

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_OWN: dict[str, str] = {}
#: Tables staged inside the open ``scratch`` blocks.
_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def _made(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    except Py4JJavaError:
        return False


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset a folder in the warehouse, which executors share.

    Only a local master, whose driver and executors are one process, may do without a
    warehouse it can write to.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = sc.applicationId
    if app not in _OWN:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_steps/{app}"
        if not _made(spark, own) and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            own = "file:" + tempfile.mkdtemp(prefix="steps-")
        _OWN[app] = own
        where = urlparse(own)
        if where.scheme in ("", "file"):  # no other session reads it: it goes with this one
            atexit.register(shutil.rmtree, url2pathname(where.path), ignore_errors=True)
    return _OWN[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there.

    A lost executor then costs the tasks it was running, not the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_staged(*dfs: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in dfs:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at its end: what is made of them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for spark, path in _SCRATCH.pop():
            _delete(spark, path)


def written(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The DataFrame that ``make()`` returns, staged; the tables it staged on its way are gone then."""
    with scratch():
        df = make()
        spark, schema = df.sparkSession, df.schema
        path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append((spark, path))
    return spark.read.schema(schema).parquet(path)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums of columns, this row's included, in a total order.

    Rows are dealt out by range, the partition each fell into is written with them, and
    only one row for each partition meets in a single task.
    """
    named = {f"__of_{n}": c for n, c in sums.items()}
    dealt = df.withColumns(named).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = staged(dealt, "running")
    totals = parts.groupBy("__part").agg(*[F.sum(c).alias(c) for c in named])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__of_{n}").over(before), F.lit(0)).alias(f"__start_{n}") for n in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = parts.withColumns({f"__in_{n}": F.sum(f"__of_{n}").over(inside) for n in sums})
    joined = summed.join(starts, F.col("__part") == F.col("__p"))
    out = joined.withColumns({n: F.col(f"__in_{n}") + F.col(f"__start_{n}") for n in sums})
    return out.drop("__part", "__p", *[f"__{k}_{n}" for n in sums for k in ("of", "start", "in")])


def running_within(df: DataFrame, key: list[str], by: list[Column], sums: dict[str, Column]) -> DataFrame:
    """The same within each key, however large one is: sums over all keys, less what was there before the key began.

    The summed columns may not be negative.
    """
    whole = running(df, [*[F.col(k) for k in key], *by], {f"__all_{n}": c for n, c in sums.items()})
    before = {n: F.col(f"__all_{n}") - c for n, c in sums.items()}
    first = whole.groupBy(*key).agg(*[F.min(b).alias(f"__before_{n}") for n, b in before.items()])
    first = first.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(key)], *[f"__before_{n}" for n in sums])
    same = [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(key)]
    on = same[0]
    for more in same[1:]:
        on = on & more
    joined = whole.join(first, on)
    out = joined.withColumns({n: F.col(f"__all_{n}") - F.col(f"__before_{n}") for n in sums})
    return out.drop(*[f"__{k}_{n}" for n in sums for k in ("all", "before")], *[f"__key_{i}" for i in range(len(key))])


def placed(df: DataFrame, key: list[str], by: list[Column], name: str) -> DataFrame:
    """A 0-based place within each key in a total order; ``by`` should tell rows apart."""
    counted = running_within(df, key, by, {name: F.lit(1).cast("long")})
    return counted.withColumn(name, F.col(name) - 1)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers rows from 0 in a total order."""
    counted = running(df, order, {name: F.lit(1).cast("long")})
    return counted.withColumn(name, F.col(name) - 1)
