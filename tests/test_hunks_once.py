"""Hunks of whole texts against the column form of paragraphs; work that several results share is done once."""

import random

from proofmill.functions import texts as X
from proofmill.operators import align, hunks, scoring
from proofmill.plans import dataset, scoring as plans
from proofmill.session import spread
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_paragraphs_are_those_of_the_column_form(spark):
    rng = random.Random(6)
    texts = ["", "\n", *("".join(rng.choice(["a", "b c", "\n", "\n\n", " ", "\t", "\xa0", "\x1c", "\r", "é"]) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", X.paragraphs_of(F.col("text")).alias("ps")).collect()
    for r in rows:
        assert hunks.paragraphs(r.text) == r.ps


def test_hunks_split_texts_once(spark):
    pairs = spark.createDataFrame([(1, "a b\n\nc", "a x\n\nc"), (2, None, "new"), (3, "same", "same  ")], "paper int, before string, after string")
    made = hunks.hunks(pairs)
    assert "split(" not in _plan(made)
    assert sorted(made.select("paper", "kind", "before", "after").collect()) == [(1, "replace", "b", "x"), (2, "insert", "", "new")]


def test_both_lengths_of_sequences_align_alike(monkeypatch):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        short = align.matches(a, b)
        monkeypatch.setattr(align, "SHORT", 0)
        assert align.matches(a, b) == short
        monkeypatch.undo()


def test_scores_align_and_judge_once(spark):
    assert "MapInArrow" not in _plan(dataset.scored_corrections(spark, SF))
    for query in (plans.score_by_zone, plans.score_totals):
        assert "contains(" not in _plan(query(spark, SF)).lower()


def test_spread_runs_nothing(spark):
    spark.sparkContext.setJobGroup("spread", "")
    spread(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    spark.sparkContext.setJobGroup("", "")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")


def test_equal_hunks_are_met_as_the_lowest(spark):
    p = spark.createDataFrame([("x", 1, "3 MeV", "3~MeV"), ("x", 2, None, "new words")], "paper string, pid int, before string, after string")
    h = spark.createDataFrame([("x", i, b, a) for i, b, a in ((7, "3 MeV", "3~MeV"), (4, "3 MeV", "3~MeV"), (9, None, "new words"), (8, "", "new words"))], "paper string, idx int, before string, after string")
    assert {r.pid: (r.hunk, r.how) for r in scoring.judge(p, h).collect()} == {1: (4, "exact"), 2: (8, "exact")}
