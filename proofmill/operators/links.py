"""What a source names against what is there: citations and entries, figures and files, positions and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WALL = 2


def unresolved(cited: DataFrame, entries: DataFrame, broken: DataFrame) -> DataFrame:
    """(paper, key, n) of cited keys without an entry; more than two of a paper in ``broken`` (paper), whose own list is missing, are one row without a key."""
    left = cited.select("paper", "key").distinct().join(entries.select("paper", "key"), ["paper", "key"], "left_anti")
    marked = left.join(broken.select("paper").distinct().withColumn("broken", F.lit(True)), "paper", "left")
    n = marked.groupBy("paper").agg(F.count(F.lit(1)).alias("m"))
    both = marked.join(n, "paper")
    wall = F.coalesce("broken", F.lit(False)) & (F.col("m") > WALL)
    return both.groupBy("paper", F.when(~wall, F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[A-Za-z]+$", "")


def figures(named: DataFrame, files: DataFrame, archived: DataFrame) -> DataFrame:
    """(paper, name, state): present by its name or stem, else archived, else missing."""
    there = files.select("paper", F.lower(stem(F.col("name"))).alias("stem")).distinct().withColumn("there", F.lit(True))
    inside = archived.select("paper", F.lower(stem(F.col("name"))).alias("stem")).distinct().withColumn("inside", F.lit(True))
    both = named.withColumn("stem", F.lower(stem(F.col("name")))).join(there, ["paper", "stem"], "left").join(inside, ["paper", "stem"], "left")
    return both.select("paper", "name", F.when(F.col("there"), "present").when(F.col("inside"), "archived").otherwise("missing").alias("state"))


def positions(listed: DataFrame, cited: DataFrame) -> DataFrame:
    """(paper, key, pos, rank) where an entry's place in the list isn't its key's place among first citations; ``listed``: paper, key, pos; ``cited``: paper, key, at."""
    first = cited.groupBy("paper", "key").agg(F.min("at").alias("at"))
    both = listed.join(first, ["paper", "key"])
    place = F.row_number().over(W.partitionBy("paper").orderBy("pos"))
    rank = F.row_number().over(W.partitionBy("paper").orderBy("at"))
    return both.withColumn("place", place).withColumn("rank", rank).filter("place <> rank").select("paper", "key", "place", "rank")
