"""Collections made of the driver's tables, so that every operator has real data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment all expiry is judged at: 1995-01-01 UTC in milliseconds.
NOW_MS = 788_918_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names; every third expires, at a time their key gives."""
    c = table(spark, sf_dir, "customer")
    at = F.when(F.col("c_custkey") % 3 == 0, F.lit(NOW_MS - 500_000) + F.col("c_custkey") * 1700)
    return c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").cast("binary").alias("value"), at.alias("expires_at_ms"))


def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("counter:"), F.col("o_custkey").cast("string")).alias("key"), F.floor("o_totalprice").cast("long").alias("num"), F.col("o_orderkey").alias("seq"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").cast("string").cast("binary").alias("value")) for f in ("brand", "type", "size")])
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.inline(fields))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types of each user in order."""
    from pyspark.sql import Window as W

    at = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), at.alias("idx"), F.col("event_type").cast("binary").alias("value"))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of each event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").cast("binary").alias("member")).distinct()


def zsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance in each nation."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    # the nations are a fixed list of 25
    joined = c.join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("n_name").alias("key"), F.col("c_name").cast("binary").alias("member"), F.col("c_acctbal").alias("score"))


def user_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their number of events of each type: sorted sets that share members."""
    e = table(spark, sf_dir, "events")
    grouped = e.groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").cast("binary").alias("member"))
    return grouped.agg(F.count(F.lit(1)).cast("double").alias("score"))


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("offset")).distinct()


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("element"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    lat = F.pmod(F.col("c_custkey") * 37, F.lit(1700)) / 10.0 - 85
    lon = F.pmod(F.col("c_custkey") * 91, F.lit(3600)) / 10.0 - 180
    return c.select(F.lit("customers").alias("key"), F.col("c_name").cast("binary").alias("member"), lat.alias("lat"), lon.alias("lon"))


def room_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.rooms import with_offsets

    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("room"), "event_id", "ts", F.col("props").cast("binary").alias("data"), F.col("user_id").cast("string").cast("binary").alias("key"))
    return with_offsets(rows, ["room"], ["ts", "event_id"])


def topic_events(spark: SparkSession, sf_dir: str, partitions: int = 8) -> DataFrame:
    from ..streaming.rooms import event_size, partition_by_md5, to_topic

    e = table(spark, sf_dir, "events")
    rows = e.select(F.lit("events").alias("topic"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("event_type").alias("event"), F.col("props").cast("binary").alias("data"), "ts", "event_id")
    rows = rows.withColumn("size_bytes", event_size(rows))
    return to_topic(rows, partitions, ["ts", "event_id"], partition_by_md5(F.col("key"), partitions))


def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    priority = (F.lit(11) - F.substring("o_orderpriority", 1, 1).cast("int") * 2).cast("int")
    return o.select(F.col("o_orderstatus").alias("queue"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("id"), priority.alias("priority"))


def queue_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications of all orders, then deliveries of half as many, then acknowledgements and refusals, by their keys."""
    m = queue_messages(spark, sf_dir)
    base = m.select("queue", "seq", F.lit(0).cast("long").alias("now"), F.lit("publish").alias("op"), "id", F.lit(None).cast("string").alias("consumer_id"), F.col("id").cast("binary").alias("payload"), "priority", F.lit(1).alias("max_retries"), F.lit(None).cast("boolean").alias("requeue"))

    def later(op: str, step: int, condition: str, consumer: str | None = None, requeue: bool | None = None, now: int = 0) -> DataFrame:
        return m.filter(condition).select(
            "queue", (F.col("seq") + step * 10_000_000).alias("seq"), F.lit(now).cast("long").alias("now"), F.lit(op).alias("op"), "id", F.lit(consumer).cast("string").alias("consumer_id"),
            F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("int").alias("priority"), F.lit(None).cast("int").alias("max_retries"), F.lit(requeue).cast("boolean").alias("requeue"),
        )

    steps = [
        later("consume", 1, "seq % 2 = 0", "c1", now=1),
        later("ack", 2, "seq % 6 = 0", now=2),
        later("nack", 3, "seq % 6 = 2", requeue=True, now=3),
        later("nack", 4, "seq % 6 = 4", requeue=False, now=4),
        later("consume", 5, "seq % 4 = 0", "c2", now=40),
        later("nack", 6, "seq % 6 = 2", requeue=True, now=41),
    ]
    for step in steps:
        base = base.unionByName(step)
    return base


def pubsub_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    topic = F.concat(F.lit("events."), "event_type", F.lit(".user"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), topic.alias("topic"), "ts")


# Subscriptions of the routing query.
SUBSCRIPTIONS = (
    ("s1", "events.*.user1"),
    ("s2", "events.error.#"),
    ("s3", "events.click.user*"),
    ("s4", "events.purchase.user7"),
    ("s1", "events.view.user1"),
    ("s5", "#"),
)


def tagged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("{"), F.col("c_nationkey").cast("string"), F.lit("}:"), F.col("c_custkey").cast("string")).alias("key"))
