"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.errors import CorpusError
from corpusloom.plans.staging import drop, join_hot, stage


def star_components(edges: DataFrame, rounds: int = 200, hot: int = 100_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots themselves.

    ``root`` is the smallest node reachable. Each round is a table in the shared
    folder that replaces the one before; a round joins edges with one minimum per node, so that no
    neighbourhood is gathered in one place, and nodes of over ``hot`` edges meet their minimum
    by broadcast. Rounds end when all edges form stars, and only then; edges that don't
    after ``rounds`` are an error.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if are_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "minima")
        large = join_hot(both, least, "u", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-stars")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "minima")
        small = join_hot(large, low, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = stage(small.where("u <> v").distinct(), "links")
        drop(edges, least, large, low)
        edges = after
    if not are_stars(edges):
        raise CorpusError("unsettled", f"components not settled after {rounds} rounds", what="rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def are_stars(edges: DataFrame) -> bool:
    """Whether each node but the roots has one edge, to a root."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
    return n == nodes and (n == 0 or edges.join(edges.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").isEmpty())
