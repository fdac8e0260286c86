"""Connected components of a links table, wholly in Spark.

Alternating large-star and small-star steps: every node is tied to the smallest
neighbour it knows, until the links are stars around the smallest node of each
component. Each step is one aggregate and one join on a node; a centre with very
many links is summed map-side and its join is split by AQE. Links and labels
never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pinned


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter("b < a")
    least = near.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("m"))
    tied = near.join(least, F.col("a") == F.col("node"))
    tied = tied.filter("b > a") if large else tied
    out = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, component) for every node that has a link;
    the component is its smallest node. Order and repeats don't matter. Steps go
    on until the links no longer change."""
    links = pinned(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "links")
    seen = _state(links)
    while True:
        links = pinned(_star(_star(links, True), False), "stars")
        state = _state(links)
        if state == seen:
            break
        seen = state
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
