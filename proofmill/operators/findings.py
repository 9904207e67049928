"""Findings of checks: duplicates and walls of equal findings collapsed, those that edits resolve dropped, and tallies.

A finding has paper, pos (its order), check_id, severity, line (or null), original, message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofmill.functions import vocabulary as V

WALL = 3


def rank(severity: Column) -> Column:
    """0 for the worst."""
    return F.array_position(F.array(*map(F.lit, V.SEVERITIES)), severity) - 1


def collapse(findings: DataFrame) -> DataFrame:
    """One row of each (paper, check, line, first 120 characters of the original), the first; more than three without a line become their count under the worst severity.

    Columns paper, check_id, severity, line, original, n, in no order.  Minima and
    counts only: no window over a paper's findings.
    """
    key = F.substring(F.coalesce("original", F.lit("")), 1, 120)
    once = findings.groupBy("paper", "check_id", "line", key.alias("_key")).agg(F.min(F.struct("pos", "severity", "original")).alias("f")).select("paper", "check_id", "line", "f.*")
    located = once.filter("line is not null").select("paper", "check_id", "severity", "line", "original", F.lit(1).cast("long").alias("n"))
    bare = once.filter("line is null")
    n = bare.groupBy("paper", "check_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(rank(F.col("severity")).alias("r"), "pos", "severity", "original")).alias("worst"))
    walls = n.filter(F.col("n") > WALL).select("paper", "check_id", "worst.severity", F.lit(None).cast("int").alias("line"), "worst.original", "n")
    few = bare.join(n.filter(F.col("n") <= WALL).select("paper", "check_id"), ["paper", "check_id"], "left_semi").select("paper", "check_id", "severity", F.col("line").cast("int"), "original", F.lit(1).cast("long").alias("n"))
    return located.withColumn("line", F.col("line").cast("int")).unionByName(walls).unionByName(few)


def in_order(findings: DataFrame) -> DataFrame:
    """``findings`` with their place in their paper: worst first, then by check and line."""
    order = W.partitionBy("paper").orderBy(rank(F.col("severity")), "check_id", F.coalesce("line", F.lit(0)), "original")
    return findings.withColumn("place", F.row_number().over(order))


def unresolved(findings: DataFrame, edits: DataFrame, settled: DataFrame) -> DataFrame:
    """Findings that no edit of their check and paper resolves, and whose check isn't ``settled`` (paper, check_id) as a whole.

    An edit resolves a finding with the same text in it or around it, one on its
    line, and one without text and line.  ``edits``: paper, check_id, before, line.
    """
    f, e = findings.alias("f"), edits.alias("e")
    original, before = F.trim(F.coalesce("f.original", F.lit(""))), F.trim(F.coalesce("e.before", F.lit("")))
    same = (original != "") & (F.contains(F.coalesce("e.before", F.lit("")), original) | F.contains(original, before))
    met = same | (F.col("f.line") == F.col("e.line")) | ((original == "") & F.col("f.line").isNull())
    left = f.join(e, (F.col("f.paper") == F.col("e.paper")) & (F.col("f.check_id") == F.col("e.check_id")) & F.coalesce(met, F.lit(False)), "left_anti")
    return left.join(settled, ["paper", "check_id"], "left_anti")


def tally(findings: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("paper").agg(is_("error").alias("errors"), is_("warning").alias("warnings"), is_("info").alias("notes"))
