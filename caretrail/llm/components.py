"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is a join and a minimum per node; its result is written to the shared folder. Defined cases: no links give no
rows; loops are dropped; repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component) for every linked node but the components' own smallest nodes."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "stars")
