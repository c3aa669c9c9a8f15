"""Graph operators over vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.streaming.runs import shared_folder


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, ...): each edge from both ends."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *rest).union(edges.select(F.col("target"), F.col("source"), *rest))


def reinforce(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges with the counts and latest times of new sightings merged in, by an upsert on (source, target, predicate)."""
    key = ["source", "target", "predicate"]
    new = seen.groupBy(*key).agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    out = edges.join(new, key, "full_outer")
    return out.select(*key, (F.coalesce("obs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("obs"), F.greatest("last_confirmed", "ts").alias("last_confirmed"))


def qualified(edges: DataFrame, alive: float = 0.1, degree: int = 2) -> DataFrame:
    """(node, other, weight) of live edges between nodes of at least `degree` live edge ends."""
    live = both_ways(edges.filter(F.col("decay") > alive).withColumn("weight", F.col("decay") * F.log2(F.col("obs") + 1.0)).select("source", "target", "weight"))
    keep = live.groupBy("node").count().filter(F.col("count") >= degree).select("node")
    return live.join(keep, "node").join(keep.withColumnRenamed("node", "other"), "other").select("node", "other", "weight")


def propagate(adjacency: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, label) after synchronous weighted label rounds: own label on a tie, then the smallest.

    The adjacency and each round's labels are written once. Rounds end early when the labels stay, or swing between two
    states: which of the two the last round would leave is then known.
    """
    spark, folder = adjacency.sparkSession, shared_folder(adjacency.sparkSession, "labels")
    at = 0

    def written(df: DataFrame) -> DataFrame:
        nonlocal at
        at += 1
        df.write.parquet(f"{folder}/{at}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{at}")

    adjacency = written(adjacency)
    labels = written(adjacency.select("node").distinct().select("node", F.col("node").alias("label"), F.col("node").alias("before"), F.lit(None).cast("string").alias("two_before")))
    for done in range(1, rounds + 1):
        votes = adjacency.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.round(F.sum("weight"), 9).alias("votes"))
        ranked = votes.join(labels.select("node", F.col("label").alias("own"), "before"), "node")
        best = Window.partitionBy("node").orderBy(F.desc("votes"), (F.col("label") != F.col("own")), "label")
        labels = written(ranked.withColumn("r", F.row_number().over(best)).filter("r = 1").select("node", "label", F.col("own").alias("before"), F.col("before").alias("two_before")))
        moved, swung = labels.agg(F.count_if(F.col("label") != F.col("before")), F.count_if(F.col("label") != F.col("two_before"))).first()
        if not moved:
            break
        if not swung and done > 1:
            return labels.select("node", F.col("label" if (rounds - done) % 2 == 0 else "before").alias("label"))
    return labels.select("node", "label")


def clusters(labels: DataFrame, least: int = 3) -> DataFrame:
    """(node, label) of the labels that `least` nodes or more have."""
    return labels.join(labels.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("label"), "label").select("node", "label")


def walk(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, node, predicate, depth): distinct steps from the start nodes over both directions, depth two at most."""
    adjacent = both_ways(edges.select("source", "target", "predicate"))
    step = starts.join(adjacent, starts.start == adjacent.node).select("start", F.col("other").alias("at"), "predicate", F.lit(1).alias("depth"))
    out = step.distinct()
    for d in range(2, depth + 1):
        step = out.filter(F.col("depth") == d - 1).select("start", "at").distinct().join(adjacent, F.col("at") == F.col("node")).select("start", F.col("other").alias("at"), "predicate", F.lit(d).alias("depth"))
        out = out.union(step.distinct())
    return out.select("start", F.col("at").alias("node"), "predicate", "depth")


def shared_pairs(members: DataFrame, group: str, value: str) -> DataFrame:
    """(e1, e2, group): unordered pairs of values within a group; groups are bounded by construction."""
    a = members.select(group, F.col(value).alias("e1"))
    b = members.select(group, F.col(value).alias("e2"))
    return a.join(b, group).filter("e1 < e2")
