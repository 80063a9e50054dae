"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textorbit.session import cut

#: A graph of n nodes needs about log(n) squared rounds at worst; more means a fault.
MOST_ROUNDS = 200


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node that has an edge to another one.

    The component is its smallest node.  Each round hangs all larger neighbours of a
    node below its smallest one, then all smaller ones, until every tree is a star.
    A round is two aggregations and joins over the edges, whose number never grows;
    its result is written, so that a lost executor repeats one round at most.
    Edges with a null end and loops are left out; an empty graph has no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    now = cut(now.where("a is not null and b is not null and u != v").select("u", "v").distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = now.select(mark).first()
    for _ in range(MOST_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        found = now.select(mark).first()
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
