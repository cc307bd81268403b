"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import store


def _star(edges: DataFrame, *, small: bool) -> DataFrame:
    """Tie the larger (or smaller) neighbours of each node to the smallest node around it.

    The minima are written first, so the join has a shuffle on either side and Spark may split a node with very many
    edges over several tasks.
    """
    if small:
        around = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    else:
        around = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    least = store.cut(around.groupBy("node").agg(F.min("other").alias("m")), "star-minima").withColumn("m", F.least("node", "m"))
    joined = around.join(least, "node")
    if small:
        out = joined.select(F.col("other").alias("x"), "m").unionByName(joined.select(F.col("node").alias("x"), "m"))
    else:
        out = joined.where("other > node").select(F.col("other").alias("x"), "m")
    return out.where("x > m").select(F.col("x").alias("hi"), F.col("m").alias("lo")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of long ids to rows (node, component), the smallest id of each component; nodes without links are left out."""
    edges = store.cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while True:
        edges = store.cut(_star(edges, small=False), "large-star")
        edges = store.cut(_star(edges, small=True), "small-star")
        # done when all are stars: a larger end has one edge and is nobody's smaller end
        ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty():
            break
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
