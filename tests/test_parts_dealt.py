"""Small files are all tasks' work, equal rows are worked on once, and one row for each conference is all that is sent about."""

import pytest

from proofmill.operators import papers, rules
from proofmill.plans import journals, latex, latex_text, protected

SF = "/root/testdata/sf0.001"
BY_NUM = "REPARTITION_BY_NUM"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [latex.source_checks, protected.house_unit_edits, latex_text.latex_sources_of_spans])
def test_sources_of_a_small_file_are_dealt_to_all_cores(spark, query):
    assert BY_NUM in _plan(query(spark, SF))


def test_house_styles_are_counted_without_a_join_by_file(spark):
    assert _plan(protected.house_unit_edits(spark, SF)).count("Join") == 1


def test_complete_pulls_hold_no_join(spark):
    kind = "paper int, name int, size int"
    planned = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 2, 6), (2, 1, 5), (3, None, 5), (None, 1, 1), (4, 1, 1)], kind)
    present = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 4), (3, None, 5), (None, 1, 1), (4, 1, 1), (4, 9, 9), (5, 1, 1)], kind)
    made = papers.complete(planned, present)
    assert "Join" not in _plan(made)
    assert {r.paper: r.complete for r in made.collect()} == {1: True, 2: False, 3: False, None: False, 4: True}


def test_equal_references_are_solved_once(spark, monkeypatch):
    held, kept = [], rules.stash
    monkeypatch.setattr(rules, "stash", lambda df, label: held.append((out := kept(df, label)).count()) or out)
    slip = 'A. Alpha, "A title of it", Vol. 5, 2014'
    refs = spark.createDataFrame([(i, slip) for i in range(6)] + [(6, None), (7, "")], "ref int, text string")
    got = {r.ref: (r.text, r.rounds) for r in rules.solved(refs).collect()}
    assert max(held) == 2 and len(got) == 8
    assert got[6] == (None, 0) and got[7] == ("", 0)
    assert len({got[i] for i in range(6)}) == 1 and got[0][0] != slip and got[0][1] > 0


def test_names_of_journals_are_made_from_parts_once(spark):
    assert not [f for f in journals.journal_names(spark, SF).inputFiles() if "part.parquet" in f]
