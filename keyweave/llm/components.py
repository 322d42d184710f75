"""Connected components of a graph of links, by alternating large and small stars.

Every node's links are turned towards the smallest node it knows, first from its
larger neighbours, then from its smaller ones, until nothing changes.  The minimum of
a node is an aggregate, combined before it is shuffled, and joined back to its links;
those of hubs, few by their definition, go to the links instead, so that no task
gathers a hub's.  Only two numbers a round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import drop_staged, staged

#: Nodes with more links are hubs, and so many of them there are at most: of L links a hub has HUB, and L / HUBS.
HUB, HUBS = 100_000, 100_000


def _smallest(links: DataFrame, many: int) -> DataFrame:
    """links(u, v) with the smallest of u and its neighbours in ``low``; ``many`` is no less than their number."""
    low = links.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
    low = staged(low.select(F.col("u").alias("node"), F.least("u", "low").alias("low"), "n"), "low")
    limit = max(HUB, many // HUBS)
    # no more than many / limit rows, which HUBS bounds
    hubs = F.broadcast(low.filter(F.col("n") > limit).select("node", F.col("low").alias("hub_low")))
    marked = links.join(hubs, links["u"] == F.col("node"), "left").select("u", "v", "hub_low")
    rest = low.filter(F.col("n") <= limit).select("node", "low")
    others = marked.filter("hub_low IS NULL").join(rest, F.col("u") == F.col("node")).select("u", "v", "low")
    return marked.filter("hub_low IS NOT NULL").select("u", "v", F.col("hub_low").alias("low")).unionByName(others)


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node that has a link.

    Links may repeat and lead both ways; those of a node to itself say nothing.
    """
    one = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = staged(one, "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = staged(large, "large")
        small = _smallest(large, 2 * state[0])
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v")))
        new = staged(small.filter("u > v").distinct(), "links")
        drop_staged(now, large)
        before, state, now = state, _state(new), new
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
