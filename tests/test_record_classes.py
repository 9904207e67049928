"""Classes of references and records: rows whose forms agree are compared once, in rows of bounded size."""

from pyspark.sql import functions as F

from proofmill.operators import registry as R

REF = "ref int, title string, surname string, year int, volume string, page string, container string, kind string, k int"
WORK = "doi string, title string, surname string, year int, volume string, page string, type string, k int"
TITLE = "a long enough title of a work"


def told(df):
    return sorted(map(str, df.collect()))


def odd(spark):
    """References and records with empty, null and oddly spelt fields, several of each, and keys that are null or meet nothing."""
    refs = [(t, s, y, v, p, c, kind, k) for t in (TITLE, "A long  title", "", None) for s, y, v, p, c, kind, k in [("A", 2000, "1", "3", "Phys. Rev.", "journal", 1), ("a", None, "v1", "", "", None, 1), ("", 2000, None, "p3", None, "conference", 1), (None, 1999, "x", "3-4", "Proc. X", "", 1), ("A", None, None, "4", "", "journal", 1), ("A", 2000, "1", "3", "", "book", None), ("A", 2000, "1", "3", "", "book", 7)]]
    works = [(t, s, y, v, p, made, k) for t in (TITLE, TITLE + " on", "a long title", "") for s, y, v, p, made, k in [("A", 2000, "1", "3-9", "journal-article", 1), ("a", 2002, "v1", "3", "proceedings-article", 1), ("B", None, "", None, None, 1), (None, 2001, "x", "", "book", 1), ("A", 2000, "1", "3", "book", None)]]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(refs * 2)], REF), spark.createDataFrame([(f"d{i}", *r) for i, r in enumerate(works * 2)], WORK)


def test_classes_hold_a_bounded_number_of_ids_and_rows_whose_forms_agree(spark):
    refs = spark.createDataFrame([(i, TITLE, ("Zeta", "ZETA")[i % 2], 2000, ("1", "v1")[i % 2], "3", "Phys. Rev.", "journal", 1) for i in range(250)], REF)
    works = spark.createDataFrame([(f"d{i:03}", TITLE, "zeta", 2000, "1", ("3", "3-9")[i % 2], "journal-article", 1) for i in range(120)], WORK)
    rows = R.compared_classes(refs, works, ["k"]).collect()
    assert sorted((len(r.refs), len(r.dois)) for r in rows) == sorted((a, b) for a in (50, 100, 100) for b in (20, 100))
    pairs = R.compared(refs, works, ["k"])
    assert pairs.distinct().count() == pairs.count() == 250 * 120
    assert [(r.reason, r.doubt, r.points) for r in pairs.select("reason", "doubt", "points").distinct().collect()] == [("", "", 6)]


def test_classes_come_to_what_rows_come_to(spark):
    refs, works = odd(spark)
    pairs = R.compared(refs, works, ["k"])
    every = refs.join(works, "k").select("ref", "doi")
    assert told(pairs) == told(R.compared_given(every, refs, works, ["k"])) and pairs.count() == every.count()
    assert {"", "title", "volume", "page", "year"} <= {r.doubt for r in pairs.select("doubt").distinct().collect()}
    assert pairs.filter(F.col("reason") == "").count()
