"""Proposals held against the editors' hunks: matches, and scores with their denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofmill.functions import texts as X

LEAST_ANCHOR = 2


def _agreement(form: str, label: str) -> list[tuple[str, Column]]:
    """(how, condition) of one normal form, the stronger first."""
    pb, pa, hb, ha = (F.col(f"{side}.{c}_{form}") for side in "ph" for c in ("before", "after"))
    within = (pb != "") & (pa != "") & F.contains(hb, pb) & F.contains(ha, pa)
    covers = (hb != "") & (ha != "") & F.contains(pb, hb) & F.contains(pa, ha)
    return [(f"{label}exact", (pb == hb) & (pa == ha)), (f"{label}inside-hunk", within), (f"{label}covers-hunk", covers)]


def _formed(df: DataFrame, *more: str | Column) -> DataFrame:
    """Both texts in both normal forms, made once a row and not once a pair."""
    return df.select("paper", *more, *[form(F.col(c)).alias(f"{c}_{name}") for name, form in (("norm", X.norm), ("loose", X.loose)) for c in ("before", "after")])


def judge(proposals: DataFrame, hunks: DataFrame) -> DataFrame:
    """Each row of ``proposals`` (paper, pid, before, after, further columns) with ``how``, ``hunk`` and ``editors_did``.

    ``hunks``: paper, idx, before, after.  An exact match comes before containment
    and that before a contradiction; strict spacing comes before loose; then the
    lowest hunk.  A proposal with under two characters on both sides matches
    nothing.  Papers meet by an equi-join and the best match of a proposal is a
    partial minimum, so that no paper's pairs are gathered.  Hunks of a paper with equal
    texts meet a proposal once, as the lowest of them.  Null texts are empty.
    """
    levels = []
    for form, label in (("norm", ""), ("loose", "near ")):
        exact, inside, covers = _agreement(form, label)
        levels += [[exact], [inside, covers]]
    pb, hb = F.col("p.before_norm"), F.col("h.before_norm")
    against = ~F.col("h.large") & (hb != "") & ((hb == pb) | (F.contains(hb, pb) & (F.length(hb) <= 2 * F.length(pb) + 8)))
    levels.append([("contradicted", against)])
    best = None
    for rank, level in enumerate(levels):
        for how, holds in level:
            found = F.struct(F.lit(rank).alias("rank"), F.col("h.idx").alias("hunk"), F.lit(how).alias("how"))
            best = F.when(holds, found) if best is None else best.when(holds, found)
    p = _formed(proposals, "pid").filter((F.length("before_norm") >= LEAST_ANCHOR) | (F.length("after_norm") >= LEAST_ANCHOR))
    # Dealt by paper before equal texts are found, so that the join needs no further shuffle.
    texts = hunks.select("paper", "idx", *(X.text(F.col(c)).alias(c) for c in ("before", "after"))).repartition("paper")
    h = _formed(texts.groupBy("paper", "before", "after").agg(F.min("idx").alias("idx")), "idx", X.is_large(F.col("before"), F.col("after")).alias("large"))
    met = p.alias("p").join(h.alias("h"), F.col("p.paper") == F.col("h.paper"))
    met = met.select(F.col("p.paper").alias("paper"), F.col("p.pid").alias("pid"), best.alias("best"), F.substring("h.after_norm", 1, 120).alias("put")).filter("best is not null")
    won = met.groupBy("paper", "pid").agg(F.min(F.struct("best", "put")).alias("won"))
    how, contradicted = F.coalesce("won.best.how", F.lit("")), F.col("won.best.how") == "contradicted"
    return proposals.join(won, ["paper", "pid"], "left").withColumns({"how": how, "hunk": F.col("won.best.hunk"), "editors_did": F.when(contradicted, F.col("won.put")).otherwise("")}).drop("won")


def confirmed(how: Column) -> Column:
    return (how != "") & (how != "contradicted")


def explained(judged: DataFrame, hunks: DataFrame) -> DataFrame:
    """``hunks`` with ``large`` and ``explained``: whether any proposal met it, be it in contradiction."""
    met = judged.filter("hunk is not null").select("paper", F.col("hunk").alias("idx")).distinct().withColumn("explained", F.lit(True))
    return hunks.join(met, ["paper", "idx"], "left").withColumns({"explained": F.coalesce("explained", F.lit(False)), "large": X.is_large(F.col("before"), F.col("after"))})


def tally(judged: DataFrame, *by: str | Column) -> DataFrame:
    how = F.col("how")
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("proposals"), F.count_if(confirmed(how)).alias("confirmed"), F.count_if(how == "contradicted").alias("contradicted"))


def by_check(judged: DataFrame) -> DataFrame:
    """Record of each check: proposals, confirmations, contradictions, papers, rate, zone, verdict."""
    papers = judged.groupBy("check_id", "paper").agg(F.lit(1).alias("one")).groupBy("check_id").agg(F.count("one").alias("papers"))
    out = tally(judged, "check_id").join(papers, "check_id").withColumn("rate", X.rate(F.col("confirmed"), F.col("proposals"))).withColumn("zone", X.zone_of_check(F.col("check_id")))
    return out.withColumn("verdict", X.verdict(F.col("zone"), F.col("rate"), F.col("proposals"), F.col("contradicted")))


def by_zone(judged: DataFrame, hunks: DataFrame) -> DataFrame:
    """Proposals by their check's zone beside small corrections by their text's; ``hunks`` as ``explained`` gives them, with ``context``."""
    ours = tally(judged, X.zone_of_check(F.col("check_id")).alias("zone"))
    blob = F.concat_ws(" ", X.text(F.col("context")), X.text(F.col("before")), X.text(F.col("after")))
    theirs = hunks.filter("not large").groupBy(X.zone_of_text(blob).alias("zone")).agg(F.count(F.lit(1)).alias("corrections"), F.count_if("explained").alias("explained"))
    both = ours.join(theirs, "zone", "full").fillna(0)
    return both.withColumns({"rate": X.rate(F.col("confirmed"), F.col("proposals")), "recall": X.rate(F.col("explained"), F.col("corrections"))})


def by_editor(hunks: DataFrame, papers: DataFrame) -> DataFrame:
    """(editor, zone) with papers and corrections of the editor, and the zone's share.  A paper without an editor is '(unassigned)'."""
    named = papers.select("paper", F.coalesce("editor", F.lit("(unassigned)")).alias("editor"))
    blob = F.concat_ws(" ", X.text(F.col("context")), X.text(F.col("before")), X.text(F.col("after")))
    zoned = hunks.filter("not large").join(named, "paper").groupBy("editor", X.zone_of_text(blob).alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    totals = named.groupBy("editor").agg(F.count(F.lit(1)).alias("papers")).join(zoned.groupBy("editor").agg(F.sum("n").alias("corrections")), "editor", "left").fillna(0, ["corrections"])
    out = totals.join(zoned, "editor", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumns({"per_paper": X.rate(F.col("corrections"), F.col("papers")), "share": X.rate(F.col("n"), F.col("corrections"))})


def totals(judged: DataFrame, hunks: DataFrame) -> DataFrame:
    ours = tally(judged).withColumn("unconfirmed", F.col("proposals") - F.col("confirmed") - F.col("contradicted"))
    theirs = hunks.filter("not large").agg(F.count(F.lit(1)).alias("corrections"), F.count_if("explained").alias("explained"))
    return ours.join(theirs)  # one row each


def missed(hunks: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent signatures of small hunks that nothing explained; of equal counts the smaller signature."""
    left = hunks.filter("not explained and not large").groupBy(X.signature(F.col("before"), F.col("after")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    return left.orderBy(F.desc("n"), "signature").limit(top)


def gate(now: DataFrame, was: DataFrame, by: str, tolerance: float = 0.03, least: int = 30) -> DataFrame:
    """Rows of ``now`` whose rate fell by more than ``tolerance`` or whose contradictions rose; few proposals say nothing."""
    old = was.select(by, F.col("rate").alias("was_rate"), F.col("contradicted").alias("was_contradicted"))
    fell = (F.col("rate") < F.col("was_rate") - tolerance) | (F.col("contradicted") > F.col("was_contradicted"))
    return now.join(old, by).withColumn("failed", (F.col("proposals") >= least) & fell)
