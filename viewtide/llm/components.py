"""Connected components by alternating large and small stars, in DataFrames.

Edges are rewired until each node points at the least of its component. Each round is two
aggregations and two joins over the edges that are left, written to the shared folder, so that no
plan grows and a lost executor costs a round at most. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.sources.staging import stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b) of orderable nodes -> node, component (the least node that it reaches), for each node that has an edge to another."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stage(edges.filter("a <> b").select(a, b).distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).collect()[0]
        if mark == seen or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
        # large star: every larger neighbour of a node is tied to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        tied = large.join(least, F.col("a") == F.col("n"))
        small = tied.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stage(small.filter("a <> b").distinct(), name)
