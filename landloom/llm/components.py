"""Connected components of a table of links, by alternating star rounds over written tables.

Each round makes every node point to the least node it knows, first from above (large star), then from
below (small star); it ends when all links point to centres of stars. A hub's links stay where they are: its least node is sent to them.
Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.staging import split_join, stage


#: Nodes (16 bytes each) whose least neighbours are broadcast at most; beyond, links meet them by a shuffle that splits hubs.
BROADCAST_NODES = 1_000_000


def _met(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``links`` with their node's least neighbour: there are no more nodes than ``total``, twice the links."""
    return links.join(F.broadcast(least.drop("n")), "u") if total <= BROADCAST_NODES else split_join(links, least, "u", "n", total)


def _large(e: DataFrame, total: int) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "large")
    return _met(both.where("v > u"), least, total).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
    moved = _met(down, least, total).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one other, and none that is pointed to points on: stars whose centre is their least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("centre").alias("centre")).where(F.col("points") + F.col("centre") > 1)
    return odd.limit(1).count() == 0


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) of every node in ``links`` (a, b: long)."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        if _settled(edges):
            break
        total = 2 * edges.count()
        edges = stage(_small(stage(_large(edges, total), "half"), total), "round")
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
