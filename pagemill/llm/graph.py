"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import drop_staged, stage

#: Edges of a task that writes a round's table.
TASK_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of an edge can reach.

    ``edges``: two columns of one type, in either direction; nulls and loops are left out.  Rounds of large-star and
    small-star moves hang every node on the smallest it knows, until the edges are stars: no node hangs on two, and none
    hangs on a node that hangs itself.  A longer chain takes more rounds, there is no last one.
    A node with many neighbours is only ever aggregated on the map side first and joined, which skewed joins split.
    Rounds write as many files as their edges fill, however many partitions a shuffle has.
    """
    a, b = edges.columns
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-now.count() // TASK_EDGES))
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that a join can split the rows of a node with many neighbours.
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "smallest")
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large.coalesce(tasks), "large-star")
        drop_staged(low)
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "smallest")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stage(small.unionByName(low.withColumnRenamed("m", "v")).distinct().coalesce(tasks), "small-star")
        drop_staged(large)
        drop_staged(low)
        drop_staged(now)
        now = after
    centres = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, and only on nodes that hang on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.max(F.col("up") + F.col("down"))).first()[0] in (None, 1)
