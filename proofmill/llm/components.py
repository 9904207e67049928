"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def _step(edges: DataFrame, small: bool) -> DataFrame:
    """Links (a > b).  Large star: each node's larger neighbours move to its least neighbour; small star: its smaller ones do."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = both.join(least, both["a"] == least["u"])
    if small:
        out = moved.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    return out.filter(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b"))


def _is_stars(edges: DataFrame) -> bool:
    """Every node has one link, and to a node without any."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("x"), one.alias("up"), none.alias("down")).unionByName(edges.select(F.col("b").alias("x"), none.alias("up"), one.alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(F.col("up") + F.col("down") > 1).filter(F.col("up") > 0).isEmpty()


def components(links: DataFrame, stash: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.  Links have columns a and b.

    ``stash`` cuts the lineage.  Every round of both stars brings nodes nearer to
    their least one, so the rounds end; their number grows with the logarithm of
    the nodes, whatever the length of a chain.
    """
    links = links.filter(F.col("a") != F.col("b"))
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(edges):
        edges = stash(_step(_step(edges, small=False), small=True).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
