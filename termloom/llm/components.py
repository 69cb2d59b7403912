"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _minimum_of(edges: DataFrame) -> DataFrame:
    """u and the least of u and its partners, written out: the join that follows then has a shuffle on either
    side, which adaptive execution splits where one node has very many links."""
    return materialise(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every partner above u with the least node around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = both.where("v > u").join(_minimum_of(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and every partner below u with the least of them. Expects u > v."""
    least = _minimum_of(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) to (node, component): component is the least node that node reaches.

    Only nodes with a link to another node are returned; null ends and loops are no links. Every round is written
    to the shared folder, so lineage stays short. Raises RuntimeError if the graph isn't settled after `rounds`
    rounds (a settled one needs about log2 of its longest path).
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialise(edges.where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        edges = materialise(_small_star(materialise(_large_star(edges), "large")), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"components not settled after {rounds} rounds")
