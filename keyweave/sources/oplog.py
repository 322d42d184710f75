"""The operation log and snapshots: the durable form of all collections.

A log is a folder of Parquet files, each appended in one commit; its rows are totally
ordered by ``seq``.  A snapshot is a folder with a table for each relation and the
``seq`` it holds.  State is the newest snapshot with the log's tail folded over it.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class OffsetTooOld(LookupError):
    """A follower asks for operations the log no longer holds."""


def append(operations: DataFrame, path: str) -> None:
    """One batch, one commit: readers see all of it or nothing."""
    operations.write.mode("append").parquet(path)


def claim(spark: SparkSession, path: str, seq: int) -> bool:
    """Whether this caller, and no other, may write the operations from ``seq`` on.

    The claim is a file whose creation fails if it is there, in one step on local and
    distributed file systems; an object store must be one that creates conditionally.
    Readers of the log pass over the folder it lies in.
    """
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{seq:020d}")
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(file.getParent())
    try:
        if fs.getUri().getScheme() == "file":
            none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(file.toUri().getPath()).toPath(), none)
        else:
            fs.create(file, False).close()
    except Py4JJavaError:
        if fs.exists(file):
            return False
        raise
    return True


def release(spark: SparkSession, path: str, seq: int) -> bool:
    """Gives up the claim of a client that died before it wrote."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{seq:020d}")
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, False)


def replay(spark: SparkSession, path: str, from_seq: int = 0) -> DataFrame:
    """Operations from ``seq`` on; the filter prunes files by their statistics."""
    return spark.read.parquet(path).filter(F.col("seq") >= from_seq)


def truncate(spark: SparkSession, path: str, new_path: str, after_seq: int) -> None:
    """The log without what a snapshot already holds, as a new folder."""
    replay(spark, path, after_seq + 1).write.mode("overwrite").parquet(new_path)


def tail(spark: SparkSession, path: str, from_seq: int) -> DataFrame:
    """What a follower at ``from_seq`` lacks; OffsetTooOld if the log starts later."""
    log = spark.read.parquet(path)
    first = log.agg(F.min("seq")).first()[0]
    if first is not None and from_seq + 1 < first:
        raise OffsetTooOld(f"the log starts at {first}, {from_seq + 1} was asked for")
    return log.filter(F.col("seq") > from_seq)


def lag(log: DataFrame, replica_seq: int) -> DataFrame:
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) - replica_seq).alias("lag"))


def ring(log: DataFrame, size: int) -> DataFrame:
    """The last ``size`` operations; seq is dense, so no row is ranked."""
    end = log.agg(F.max("seq").alias("__end"))
    return log.crossJoin(F.broadcast(end)).filter(F.col("seq") > F.col("__end") - size).drop("__end")


def save_snapshot(relations: dict[str, DataFrame], path: str, seq: int) -> str:
    """Writes every relation below ``path``/seq, the marker last: without it there is no snapshot."""
    at = f"{path}/{seq:020d}"
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    spark = next(iter(relations.values())).sparkSession
    spark.createDataFrame([(seq, sorted(relations))], "seq long, relations array<string>").coalesce(1).write.mode("overwrite").parquet(f"{at}/_done.parquet")
    return at


def _folders(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_done.parquet"))]
    return fs, sorted(done, key=lambda p: p.getName())


def load_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], int] | None:
    """The newest complete snapshot and its seq."""
    _, done = _folders(spark, path)
    if not done:
        return None
    at = done[-1].toString()
    row = spark.read.parquet(f"{at}/_done.parquet").first()
    return {name: spark.read.parquet(f"{at}/{name}") for name in row["relations"]}, row["seq"]


def prune_snapshots(spark: SparkSession, path: str, keep: int) -> int:
    fs, done = _folders(spark, path)
    old = done[: max(0, len(done) - keep)]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def export(relation: DataFrame, path: str, codec: str = "zstd") -> None:
    """A relation as Parquet, compressed by ``codec`` (lz4, zstd, snappy, ...)."""
    relation.write.mode("overwrite").option("compression", codec).parquet(path)
