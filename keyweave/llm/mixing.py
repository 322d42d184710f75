"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources get a target number of words in proportion to their weights.  A source
whose target would exceed ``max_epochs`` times its own size is clamped there, and
what it could not use is shared among the others by weight, until none is above.
A target of 2.3 epochs takes every document twice, and a seeded sample of
whole documents, holding 0.3 of the source's words, a third time.

The sample of a source is the beginning of its documents in the order of a seeded
hash, up to the document that ends nearest to the wanted number of words.  The
place of that end is found by summing the sizes of hash buckets, then within the
one bucket it falls in; so no task sorts or holds a whole source, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stage import as_row, drop_staged, numbered, running, staged, unpacked, word_count


def cyclic_weights(weights: tuple[float, ...] = (5, 2, 1)):
    """A weight function: sources by code point, null last, take the weights in turn."""

    def weigh(sources: DataFrame) -> DataFrame:
        named = F.col("source")
        placed = numbered(sources, [named.isNull().asc(), named.asc()], "__place")
        at = F.pmod(F.col("__place"), F.lit(len(weights))).cast("int")
        return placed.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), at)).drop("__place")

    return weigh


def seeded_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Hex digits that order the documents at random, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))


def water_fill(sources: DataFrame, total: float | None = None, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to sources(source, weight, source_size).

    ``total`` words are shared (all words there are, if None).  In the order of what a
    source can take for its weight, those that are clamped come first; running sums give
    for each the share a weight would have if all before it were clamped, and the first
    that can take its share ends them.  So one pass finds the level, however many
    sources there are.  If even all sources at the cap hold less than ``total``, all are
    clamped.
    """
    room = F.col("source_size") * F.lit(max_epochs)
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    shared = (whole["size"] or 0) if total is None else total
    ratio = F.col("__room") / F.col("weight")
    ordered = running(
        sources.select("source", "weight", room.alias("__room")),
        [ratio.asc(), F.col("source").isNull().asc(), F.col("source").asc()],
        {"__upto": F.col("__room"), "__weights": F.col("weight")},
    )
    free = F.lit(float(shared)) - (F.col("__upto") - F.col("__room"))
    share = free / (F.lit(float(whole["weight"] or 0)) - (F.col("__weights") - F.col("weight")))
    place = F.struct(ratio.alias("ratio"), F.col("source").isNull(), "source")
    level = ordered.select(share.alias("share"), ratio.alias("ratio"), place.alias("place")).filter("share <= ratio").agg(F.min_by("share", "place")).first()[0]
    reached = F.lit(level) * F.col("weight") if level is not None else room.cast("double")
    return sources.withColumn("target", F.least(reached, room.cast("double")))


def plan_mix(docs: DataFrame, *, weigh=None, total: float | None = None, max_epochs: int = 3, seed: int = 7, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The sizes of the documents, and for each source what is taken of it.

    Returns sizes(doc_id, source, size, key) and
    sources(source, source_size, weight, target, whole, last_key): every document is
    taken ``whole`` times, and once more if its key is not above ``last_key``.
    ``digits`` of the key make a bucket: by default about as many buckets as a bucket of
    the largest source has rows, so that neither is a task's burden.
    """
    sizes = staged(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), F.col("text"), seed).alias("key")),
        "sizes",
    )
    # null sources group as one; the weights need each source's name once
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    weighted = staged((weigh or cyclic_weights())(sources), "weights")
    size = F.col("source_size")
    filled = water_fill(weighted, total, max_epochs)
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    filled = staged(
        filled.withColumn("whole", F.least(epochs, F.lit(max_epochs)).cast("long"))
        .withColumn("__rest", F.col("target") - F.col("whole") * size),
        "filled",
    )
    if digits is None:
        largest = filled.agg(F.max("__rows")).first()[0] or 0
        digits = 1
        while largest > 16 ** (2 * digits):
            digits += 1
    bucket = F.substring("key", 1, digits)
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = sums.alias("s").join(filled.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")))
    # the bucket the wanted number of words ends in, one for each source
    ends = ends.filter((F.col("before") <= F.col("__rest")) & (F.col("before") + F.col("n") > F.col("__rest")) & (F.col("__rest") > 0))
    ends = ends.select(F.col("s.source").alias("source"), "bucket", "before", "__rest")
    near = sizes.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (bucket == F.col("e.bucket")))
    near = near.groupBy("d.source", "d.key", "e.before", "e.__rest").agg(F.sum("d.size").alias("n"))
    upto = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("middle", F.col("before") + F.sum("n").over(upto) - F.col("n") / 2)
    # "": nothing of the end bucket is taken, everything in the buckets before it is
    last = near.groupBy("source").agg(F.max(F.when(F.col("middle") <= F.col("__rest"), F.col("key"))).alias("within"))
    last = ends.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left")
    last = last.select(F.col("e.source").alias("source"), F.coalesce("within", "bucket").alias("last_key"))
    plan = filled.alias("f").join(last.alias("l"), F.col("f.source").eqNullSafe(F.col("l.source")), "left")
    plan = staged(plan.select("f.source", "source_size", "weight", "target", "whole", "last_key"), "mix")
    drop_staged(weighted, filled)
    return sizes, plan


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins the (few) sources to rows(row, __source, __key); Spark broadcasts them only below its size limit."""
    chosen = F.coalesce(F.col("__key") <= F.col("last_key"), F.lit(False))
    joined = rows.join(plan, F.col("__source").eqNullSafe(F.col("source")), "left")
    return joined.select("row", "source_size", "target", (F.col("whole") + chosen.cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies.

    Needs columns doc_id, text, source; others are ignored.  A null text has size 0;
    a null source is a source of its own, the last.  Rows that repeat a document are
    separate rows, all taken alike.  An empty table gives no rows.
    """
    sizes, plan = plan_mix(docs, **options)
    rows = sizes.select(F.struct("doc_id", "size").alias("row"), F.col("source").alias("__source"), F.col("key").alias("__key"))
    taken = F.col("row.size") * F.col("copies")
    return _copies(rows, plan).select("row.doc_id", "row.size", "source_size", "target", taken.alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document of ``docs`` as often as it is taken, all its columns kept.

    Nulls, ties, repeated rows and empty tables are treated as by ``mix``; other columns
    pass through, whatever their names.
    """
    seed = options.get("seed", 7)
    _, plan = plan_mix(docs, **options)
    rows = docs.select(as_row(docs).alias("row"), F.col("source").alias("__source"), seeded_key(F.col("doc_id"), F.col("text"), seed).alias("__key"))
    # a row for each copy; the copies of a document are equal rows
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    taken = _copies(rows, plan).filter("copies > 0").select("row", each)
    return unpacked(taken, docs.columns)
