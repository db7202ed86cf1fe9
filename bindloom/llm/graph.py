"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindloom.llm.common import dropped, written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of the links (a, b); the component is its least node.

    Each round hangs the neighbours of every node on its least neighbour, first the larger ones, then
    the smaller ones, and ends when nothing changes (a logarithmic number of rounds). Both steps are a
    partial aggregate and a join on the node whose link side can be split, so a node with very many
    links is no single task. The links of a round are written to the shared folder.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs = written(pairs, "links")
    seen = _state(pairs)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        last, pairs = pairs, written(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "links")
        dropped(pairs.sparkSession, last)
        now = _state(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    top = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = pairs.select(F.col("v").alias("node")).distinct().join(top, "node", "left_anti")
    return top.unionByName(roots.withColumn("component", F.col("node")))


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
