"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy


#: Edges that a task of a round reads at the least: small graphs take few tasks.
EDGES = 1 << 15


def _shape(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node that each node reaches.

    Only nodes with an edge to another node are returned. Each round moves rows
    in proportion to the edges and nothing but a count and a checksum reaches
    the driver. Joins are merges by hint: estimates after a checkpoint are no bound
    that a broadcast could rest on. Neighbour minima are partial aggregates, so a hub is
    pre-aggregated before the shuffle and its join is left to skew handling.
    A round's edges stand in as many partitions as their number asks for, a count known from the round before.
    Null ends and self links are ignored; repeated edges count once.
    """
    edges = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _shape(edges)
    for _ in range(max_rounds):
        tasks = before[0] // EDGES + 1
        edges = edges.coalesce(tasks)
        # large-star: every larger neighbour of a node goes to the node's smallest neighbour, the node itself if it has no smaller one
        low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = edges.join(low.hint("merge"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        # small-star: smaller neighbours and the node itself go to the smallest neighbour
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(small_low.hint("merge"), "a")
        ends = F.when(F.col("b") == F.col("m"), F.array("a")).otherwise(F.array("a", "b"))
        edges = cut(met.select(F.explode(ends).alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks))
        now = _shape(edges)
        if now == before:
            break
        before = now
        tidy(edges.sparkSession)  # each round leaves several shuffles behind
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
