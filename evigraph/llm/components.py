"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import persist_table


def _nearest(sides: DataFrame, label: str) -> DataFrame:
    """The least node each ``u`` touches, itself included; a table, so that the join with it can split a hot ``u``."""
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    return persist_table(least.select("u", F.least("u", "m").alias("m")), label)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b, both long) but the roots themselves; the root is the least node reached.

    A round is two joins, each against a table of one row per node; rounds grow with the logarithm of the longest path.
    """
    linked = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = persist_table(linked.distinct(), "links")
    state = None
    for _ in range(most_rounds):
        sides = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = sides.filter("v > u").join(_nearest(sides, "large"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = persist_table(larger.filter("u <> v").distinct(), "links")
        smaller = large.join(_nearest(large, "small"), "u")
        stars = smaller.select("u", "m").union(smaller.select(F.col("v").alias("u"), "m"))
        pairs = persist_table(stars.filter("u <> m").select("u", F.col("m").alias("v")).distinct(), "links")
        seen = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == (seen["n"], seen["h"]):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (seen["n"], seen["h"])
    raise RuntimeError("components did not settle")
