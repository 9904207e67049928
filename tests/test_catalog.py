import pytest

from oracle import same
from proofmill.operators import edits
from proofmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


def test_overlapping_edits_go_by_priority(spark):
    rows = [("f", 0, 3, "abc", "x", "a", 40), ("f", 2, 4, "cd", "y", "b", 10), ("f", 4, 4, "", "!", "c", 90), ("f", 5, 6, "z", "q", "d", 1)]
    proposed = spark.createDataFrame(rows, "file string, start int, end int, before string, after string, check_id string, priority int")
    sources = spark.createDataFrame([("f", "abcdef"), ("g", None)], "file string, text string")
    out = {r.file: (r.text, r.n_applied) for r in edits.apply(edits.resolve(edits.sound(proposed, sources)), sources).collect()}
    assert out == {"f": ("aby!ef", 2), "g": (None, 0)}
