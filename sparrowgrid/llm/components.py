"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before its shuffle) and an equi-join on a stored table, whose
skewed partitions the engine splits; every step is written to the shared folder, so that its lineage
is one table long. Nothing about the nodes reaches the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def star(pairs: DataFrame, *, large: bool) -> DataFrame:
    """Hang each node's (larger, or smaller) neighbours on the smallest of them and itself."""
    if large:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = common.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-min")
    out = both.join(low, "a")
    if large:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of an edge (a, b), the smallest node reachable; no row for others."""
    now = common.stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    state = now.agg(mark.alias("x")).first()["x"]
    while state[0]:
        now = common.stored(star(star(now, large=True), large=False), "cc-edges")
        new = now.agg(mark.alias("x")).first()["x"]
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
