"""Records against references: all authors count, and kinds and publishers speak against a record."""

from proofmill.operators import registry as R

REF = "ref string, title string, surname string, year int, volume string, page string, container string, kind string, publisher string, k int"
WORK = "doi string, title string, surname string, surnames array<string>, year int, volume string, page string, container string, type string, publisher string, k int"
TITLE = "a long enough title of a work"


def test_authors_kinds_and_publishers(spark):
    cases = [  # surname, container, kind, publisher; surnames, container, type, publisher; reason
        ("Muller", "Phys. Rev.", "journal", "", ["Smith", "Müller"], "", "journal-article", "", ""),
        ("Zeta", "Phys. Rev.", "journal", "", ["Smith", "van der Zeta"], "", "journal-article", "", ""),
        ("Zet", "Phys. Rev.", "journal", "", ["Smith", "van der Zeta"], "", "journal-article", "", "author"),
        ("Zet", "Phys. Rev.", "journal", "", None, "", "journal-article", "", ""),
        ("", "Phys. Rev.", "journal", "", ["Smith"], "", None, "", ""),
        ("A", "in Proc. X", "conference", "", ["A"], "J. of X", "journal-article", "", "kind"),
        ("A", "in Proc. X", "conference", "", ["A"], "Proceedings of X", "journal-article", "", ""),
        ("A", "in Proc. X", "conference_unpublished", "", ["A"], "", "Preprint", "", "kind"),
        ("A", "Nucl. Instrum.", "", "", ["A"], "", "ConferencePaper", "", "kind"),
        ("A", "Letters", "accepted", "", ["A"], "Workshop on X", "other", "", "kind"),
        ("A", "Some Place", "", "", ["A"], "", "proceedings-article", "", ""),
        ("A", "", "book", "", ["A"], "", "journal-article", "", "kind"),
        ("A", "", "book", "MIT Press", ["A"], "", "monograph", "The mit Press", ""),
        ("A", "", "book", "Wiley", ["A"], "", "monograph", "Springer", "kind"),
        ("A", "", "book_chapter", "Wiley", ["A"], "", "book-chapter", None, ""),
        ("A", "", "book_chapter", "", ["A"], "", "dataset", "", "kind"),
    ]
    refs = spark.createDataFrame([(str(i), TITLE, c[0], 2000, None, None, c[1], c[2], c[3], i) for i, c in enumerate(cases)], REF)
    works = spark.createDataFrame([(str(i), TITLE, (c[4] or [""])[0], c[4], 2000, None, None, c[5], c[6], c[7], i) for i, c in enumerate(cases)], WORK)
    got = {int(r.ref): r.reason for r in R.compared(refs, works, ["k"]).collect()}
    assert got == {i: c[8] for i, c in enumerate(cases)}
    assert R.compared(refs.limit(0), works, ["k"]).count() == 0


def test_copies_are_compared_once_and_lead_to_the_same_records(spark):
    rows = [(t, s, y, v) for t in (TITLE, "another long title of a work", "") for s in ("A", "B") for y in (2000, None) for v in ("1", "2")]
    refs = spark.createDataFrame([(f"{i}-{n}", t, s, y, v, "3", "Phys. Rev.", "journal", None, 1) for i, (t, s, y, v) in enumerate(rows) for n in range(i % 4)] + [("0-9", TITLE, "A", 2000, "2", "3", "", "", None, 1)] * 2, REF).drop("publisher")
    works = spark.createDataFrame([(f"{i}-{n}", t, s, None, y, v, "3-4", "", "journal-article", None, 1) for i, (t, s, y, v) in enumerate(rows) for n in range(i % 3)] + [("7-9", TITLE, "A", None, 2000, "1", "3", "", "", None, 1)], WORK).drop("surnames", "container", "publisher")
    pairs, classes = R.compared(refs, works, ["k"]), R.compared_classes(refs, works, ["k"])
    assert pairs.count() == refs.count() * works.count()
    assert classes.count() == refs.drop("ref").distinct().count() * works.drop("doi").distinct().count() < pairs.count()
    told = lambda df: sorted(map(tuple, df.collect()))
    found, possible = R.found(pairs), R.possible(pairs, R.found(pairs))
    assert told(R.found_in_classes(classes)) == told(found) and found.count() and told(R.possible_in_classes(classes, found)) == told(possible) and possible.count()
    given = pairs.select("ref", "doi").filter("ref like '1%'").unionByName(spark.createDataFrame([("x", "y")], "ref string, doi string"))
    assert told(R.compared_given(given, refs, works, ["k"]).distinct()) == told(pairs.filter("ref like '1%'").distinct())
    best = {r.ref: r.likeness for r in R.best_similarity(refs, works, ["k"]).collect()}
    assert best["1-0"] == 1.0 and best.keys() == {r.ref for r in refs.collect()}
