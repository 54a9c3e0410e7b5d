"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Scratch

SLIM = 50_000  # edges in a partition, so that small graphs do not leave a small file for every partition and round


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that it reaches) for the nodes of edges(a, b).

    Large-star and small-star rounds (alternating minimum contraction): minima are aggregated before the shuffle and
    joined back, so a node with very many edges is never gathered. Ends when a round changes nothing."""
    edges, before = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    parts = 1 + edges.count() // SLIM
    for _ in range(most_rounds):
        now = edges.coalesce(parts)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(parts).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        new = scratch.cut(joined.select("b", "m").where("b <> m").toDF("a", "b").union(joined.select("a", "m").toDF("a", "b")).coalesce(parts).distinct())
        scratch.drop(edges)
        edges = new
        state = edges.agg(F.count("*"), F.sum("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, parts = state, 1 + state[0] // SLIM
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.toDF("node", "component").union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
