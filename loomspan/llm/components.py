"""Connected components by repeated contraction to smaller neighbours; every step is a shuffle, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of undirected edges (u, v); component is some node of the same component.

    Each round points every node at its smallest neighbour (if smaller than itself), follows the pointers to their
    roots by doubling, and maps the edges through them. Every node that is no root is merged into one, so a round at
    least halves the nodes of each component that is still split: rounds and doublings grow with logarithms.
    """
    edges = scratch.write(edges.filter("u != v"))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        jump = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("p"), F.lit(True).alias("moved")))
        while not jump.filter("moved").isEmpty():
            up = jump.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            further = scratch.write(jump.drop("moved").join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            scratch.drop(jump)
            jump = further
        left = jump.select(F.col("node").alias("u"), F.col("p").alias("pu"))
        right = jump.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(left, "u").join(right, "v").filter("pu != pv")
        small, large = F.least("pu", "pv").alias("v"), F.greatest("pu", "pv").alias("u")
        after = scratch.write(moved.select(large, small).distinct())
        scratch.drop(edges)
        edges = after
        maps.append(jump)
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[0].select("node", F.col("p").alias("component"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("component"), F.col("p").alias("next"))
        out = scratch.write(out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
    return out
