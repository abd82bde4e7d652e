"""Connected components of a graph of edges, by alternating stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, comp (the least node that it reaches) of every node of edges (a, b), long numbers. `save` cuts the lineage of each round; rounds grow with the logarithm of a component's length."""
    now = save(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    while True:
        ends = now.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(now.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
        least = ends.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("m"))
        # larger neighbours hang on the least neighbour, then every node's smaller ones on the least of them
        star = ends.where("other > node").join(least, "node").select(F.col("m").alias("lo"), F.col("other").alias("hi")).where("lo < hi").distinct()
        down = star.groupBy("hi").agg(F.min("lo").alias("m"))
        flat = star.join(down, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").unionByName(down.select(F.col("m").alias("lo"), "hi"))
        new = save(flat.distinct())
        marks = [t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first() for t in (now, new)]
        now = new
        if marks[0] == marks[1]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
