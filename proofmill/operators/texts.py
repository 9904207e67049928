"""Checks over the words of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def acronyms(used: DataFrame, known: list[str]) -> DataFrame:
    """(doc_id, acronym, first, n) of acronyms with two uses at least and no expansion at the first; ``used``: doc_id, acronym, pos, expanded."""
    of = used.filter(~F.col("acronym").isin(known)).groupBy("doc_id", "acronym").agg(F.min(F.struct("pos", "expanded")).alias("f"), F.count(F.lit(1)).alias("n"))
    return of.filter("n >= 2 and not f.expanded").select("doc_id", "acronym", F.col("f.pos").alias("first"), "n")
