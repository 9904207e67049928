"""The corpus of papers: their two sides of files, which pairs can be learned from, revisions to pull, and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofmill.functions import texts as X, vocabulary as V
from proofmill.session import dealt

ROLES = ("original", "current")


def kind_of(ending: Column) -> Column:
    return X.lookup(F.lower(ending), list(V.KIND_OF_ENDING.items()))


def sides(files: DataFrame) -> DataFrame:
    """Per paper, of each role: how many files, and the main one.

    ``files``: paper, role, name, ext, size, sha.  The main file is the largest
    source; of equal sizes the first name.  One aggregation, so copies of a paper's
    rows are combined before the shuffle.
    """
    rank = F.struct("size", (-F.col("name")).alias("first"), "sha", kind_of(F.col("ext")).alias("kind"))
    made = []
    for role in ROLES:
        made += [F.count_if(F.col("role") == role).alias(f"n_{role}"), F.max(F.when((F.col("role") == role) & kind_of(F.col("ext")).isNotNull(), rank)).alias(role)]
    return files.groupBy("paper").agg(*made)


def usability(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(paper, kind, paired, changed, usable, reason) of every row of ``papers``."""
    both = papers.join(sides(files), "paper", "left").fillna(0, ["n_original", "n_current"])
    before, after = F.col("original"), F.col("current")
    paired = (F.col("n_original") > 0) & (F.col("n_current") > 0)
    changed = F.when(before.isNotNull() & after.isNotNull(), (before["size"] != after["size"]) | (before["sha"] != after["sha"]))
    reason = (
        F.when(F.col("n_original") == 0, "nothing submitted")
        .when(F.col("n_current") == 0, "only one revision")
        .when(before.isNull() | after.isNull(), "no source file")
        .when(before["kind"] != after["kind"], F.concat(F.lit("format changed: "), before["kind"], F.lit(" to "), after["kind"]))
        .when(~changed, "unchanged")
        .otherwise("")
    )
    kind = F.coalesce(before["kind"], after["kind"], F.when((F.col("n_original") > 0) | (F.col("n_current") > 0), "no-source").otherwise("missing"))
    return both.select(*papers.columns, kind.alias("kind"), paired.alias("paired"), F.when(paired, changed).alias("changed"), (reason == "").alias("usable"), reason.alias("reason"))


def sample(judged: DataFrame) -> DataFrame:
    """How many pairs each family of checks can be scored on: (family, pairs)."""
    n = judged.filter("usable").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("kind") == "latex").alias("latex"), F.count_if(F.col("kind") == "word").alias("word"))
    return n.select(F.expr("stack(4, 'all pairs', `all`, 'LaTeX source checks', latex, 'Word checks', word, 'reference and DOI checks', `all`) AS (family, pairs)"))


def summary(judged: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c).cast("string")
    usable = F.col("usable")
    line = F.concat(n(usable), F.lit(" usable of "), F.count(F.lit(1)).cast("string"), F.lit(": "), n(usable & (F.col("kind") == "latex")), F.lit(" LaTeX, "), n(usable & (F.col("kind") == "word")), F.lit(" Word"))
    return judged.agg(line.alias("line"))


def plan(revisions: DataFrame, which: str = "first-last") -> DataFrame:
    """The revisions to pull, with their roles.

    ``revisions``: paper, rev, created, n_files, further columns.  Only those with
    files count.  ``first-last``: the first as original and the last, if another, as
    current; ``latest``: the last as current; ``all``: each under its number.
    """
    of = W.partitionBy("paper")
    ranked = revisions.filter("n_files > 0").withColumn("up", F.row_number().over(of.orderBy("created", "rev"))).withColumn("n", F.count(F.lit(1)).over(of))
    first, last = F.col("up") == 1, F.col("up") == F.col("n")
    role = {
        "first-last": F.when(first, "original").when(last, "current"),
        "latest": F.when(last, "current"),
        "all": F.format_string("revision-%d", F.col("up")),
    }[which]
    return ranked.withColumn("role", role).filter("role is not null").drop("up", "n")


def to_pull(planned: DataFrame, present: DataFrame) -> DataFrame:
    """Planned files (paper, name, size) that aren't there in their size."""
    return planned.join(present.select("paper", "name", "size"), ["paper", "name", "size"], "left_anti")


def complete(planned: DataFrame, present: DataFrame) -> DataFrame:
    """(paper, complete): whether every planned file is there in its size.

    Both sides are rows of one table, dealt by paper once; a join would hold and sort each of them.
    """
    key = ["paper", "name", "size"]
    sides = planned.select(*key, F.lit(True).alias("asked"), F.lit(False).alias("there"))
    # What has no name or size is the same as nothing.
    sides = sides.unionByName(present.select(*key, F.lit(False).alias("asked"), F.lit(True).alias("there")).dropna(subset=key))
    files = dealt(sides, "paper").groupBy(*key).agg(F.bool_or("asked").alias("asked"), F.bool_or("there").alias("there"))
    return files.filter("asked").groupBy("paper").agg(F.bool_and("there").alias("complete"))


def tag_report(tagged: DataFrame) -> DataFrame:
    """(code, papers, status, checks, priority) of each code in ``tagged`` (paper, codes): what checks can do about it."""
    counts = tagged.select("paper", F.explode("codes").alias("code")).distinct().groupBy("code").agg(F.count(F.lit(1)).alias("papers"))
    spark = tagged.sparkSession
    checks = spark.createDataFrame(V.pairs(V.CHECKS_OF_TAG), "check_id string, code string").groupBy("code").agg(F.array_sort(F.collect_list("check_id")).alias("checks"))
    gaps = spark.createDataFrame(V.pairs(V.GAPS_OF_TAG), "code string, gap string")
    both = counts.join(F.broadcast(checks), "code", "left").join(F.broadcast(gaps), "code", "left")
    status = (
        F.when(F.col("code").isin(V.SERVICE_TAGS), "the editing service")
        .when(F.col("checks").isNotNull() & F.col("gap").isNull(), "covered")
        .otherwise(F.coalesce("gap", F.lit("editor's judgement")))
    )
    named = F.when(status.isin("covered", "partly covered"), F.array_join(F.slice("checks", 1, 4), ", ")).otherwise("")
    weight = X.lookup(F.col("status"), [(k, str(v)) for k, v in V.STATUS_WEIGHT.items()]).cast("int")
    return both.withColumn("status", status).select("code", "papers", "status", named.alias("checks"), (weight * 10_000 - F.col("papers")).alias("priority"))


def tag_ids(codes: DataFrame, live: DataFrame) -> DataFrame:
    """``codes`` (paper, code) with the id of the event's own tag, null where it has none; the service's codes are never written."""
    ours = codes.filter(~F.col("code").isin(V.SERVICE_TAGS))
    last = live.groupBy("code").agg(F.max("tag_id").alias("tag_id"))
    return ours.join(F.broadcast(last), "code", "left")


def proposed_tags(findings: DataFrame) -> DataFrame:
    """(paper, codes): the distinct tags of a paper's checks in the order of the vocabulary; ``findings``: paper, check_id."""
    code = X.lookup(F.col("check_id"), V.pairs(V.CHECKS_OF_TAG))
    # the map goes from check to tag
    place = X.lookup(code, [(c, f"{i:03d}") for i, c in enumerate(V.TAG_CODES)])
    tagged = findings.select("paper", F.struct(place.alias("place"), code.alias("code")).alias("t")).filter("t.code is not null")
    return tagged.groupBy("paper").agg(F.array_sort(F.collect_set("t")).alias("t")).select("paper", F.transform("t", lambda t: t["code"]).alias("codes"))
