"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.staging import join_summary, stage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of u with the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = join_summary(both, _least(both), ["u"]).where("v > u")
    return found.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect u and its smaller neighbours with the least of them (edges: u > v)."""
    found = join_summary(edges, _least(edges), ["u"])
    return (found.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(found.select("u", F.col("m").alias("v"))).where("u > v").distinct())


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id in the links (a, b).

    Union-find as joins: each round is staged, so neither links nor labels meet in
    one place, and a component of any size only shortens its paths.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        edges = stage(_small_star(stage(_large_star(edges))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
