"""Span rules: literal cases, spans, disjoint choice, declared numbers, and that solved references stay."""

import pytest

from proofmill.operators import rules

CASES = [
    ("A. Alpha, “On beams,” Phys. Rev., Vol. 5, p. 3-9, 1999. doi: 10.1103/x.", "A. Alpha, “On beams”, Phys. Rev., vol. 5, pp. 3-9, 1999. doi:10.1103/x"),
    ("A. Alpha, “T”, J. X, vol. 1, 2001. https://doi.org/10.1103/ab.", "A. Alpha, “T”, J. X, vol. 1, 2001. doi:10.1103/ab"),
    ("Austin, Texas, USA, Sept. 2020.", "Austin, TX, USA, Sep. 2020."),
    ("Alpha, A. B., “T”, unpublished", "A. B. Alpha, “T”, unpublished."),
    ("A Alpha and B, Beta, “T”, unpublished.", "A. Alpha and B, Beta, “T”, unpublished."),
    ("Anna Alpha, “T”, unpublished.", "A. Alpha, “T”, unpublished."),
    ("A. Alpha and B. Beta and C. Gamma, “T”, unpublished.", "A. Alpha, B. Beta, and C. Gamma, “T”, unpublished."),
    ("A. Alpha, “T”, in Proceedings of the IPAC-22, Bangkok, Thailand, June 2022, pages 4–9.", "A. Alpha, “T”, in Proc. IPAC’22, Bangkok, Thailand, Jun. 2022, pp. 4-9."),
    ("A. Alpha, “T”, Proc. of SRF’19, Dresden, Germany, Jul., 2019, p. 4.", "A. Alpha, “T”, in Proc. SRF’19, Dresden, Germany, Jul. 2019, p. 4."),
    ("A. Alpha, “THE BEAM OF LIGHT”, in Phys. Rev. Lett., Volume 3, Number 4, pp. 12, 1999.", "A. Alpha, “The beam of light”, Phys. Rev. Lett., vol. 3, no. 4, p. 12, 1999."),
    ("A. Alpha, “The accel- erator”, Nature, vol. 3, (2001).", "A. Alpha, “The accelerator”, Nature, vol. 3, 2001."),
    ("A. Alpha, “T”, Nature, vol. 3, 2001. doi:10.1038/a1. doi:10.1038/a1", "A. Alpha, “T”, Nature, vol. 3, 2001. doi:10.1038/a1"),
    ("A. Alpha, “T”, Nature, vol. 3, 2001. DOI 1O.1038/a1", "A. Alpha, “T”, Nature, vol. 3, 2001. doi:10.1038/a1"),
    ("A. Alpha, “T”, Nature, vol. 3, 2001. doi:10.1038/a1, https://nature.example/doi/10.1038/a1", "A. Alpha, “T”, Nature, vol. 3, 2001. doi:10.1038/a1"),
    ("A. Alpha, “T”, presented at IPAC’14, Dresden, Germany, Jun. 2014, paper ID: MOP 057, unpublished.", "A. Alpha, “T”, presented at IPAC’14, Dresden, Germany, Jun. 2014, paper MOP057, unpublished."),
    ("A. Alpha, “T the the end”, the the words, U.S.A.", "A. Alpha, “T the the end”, the words, USA."),
    ("A. Alpha, doi:10.1038/a1, “T”, Nature, vol. 3, 2001.", "A. Alpha, “T”, Nature, vol. 3, 2001. doi:10.1038/a1"),
    (None, None),
    ("", ""),
]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "ref int, text string")


def test_solved_references_and_a_second_run(spark, refs):
    out = rules.solved(refs)
    got = {r.ref: r.text for r in out.collect()}
    assert {i: (CASES[i][0], got[i]) for i in got} == {i: c for i, c in enumerate(CASES)}
    assert rules.solved(spark.createDataFrame(list(got.items()), refs.schema)).filter("rounds > 0").isEmpty()


def test_spans_hold_their_excerpts(refs):
    texts = {r.ref: r.text for r in refs.collect()}
    found = rules.issues(refs).collect()
    assert found and all(texts[r.ref][r.start : r.end] == r.excerpt for r in found)
    assert all(r.put is None or r.put != r.excerpt for r in found)


def test_the_first_rule_wins_where_issues_touch(spark):
    rows = [(1, 5, "B", "error", 4, 9, "x", "late", True), (1, 2, "A", "error", 0, 4, "x", "first", True), (1, 7, "C", "error", 10, 12, "x", "apart", True), (1, 1, "D", "error", 12, 12, "", "at its edge", True), (2, 9, "B", "error", 4, 9, "x", "other", True)]
    found = spark.createDataFrame(rows, "ref int, rank int, code string, severity string, start int, end int, excerpt string, put string, frees boolean")
    assert sorted((r.file, r.after) for r in rules.apart(found).collect()) == [(1, "at its edge"), (1, "first"), (2, "other")]


def test_numbers_may_go_only_where_a_rule_says_so(spark):
    rows = [(1, "vol. 3", "vol. 4", False), (2, "vol. 3", "vol. 3", False), (3, "2023", "23", True), (4, "p. 1-2", None, False), (5, "12", "21", False)]
    found = spark.createDataFrame(rows, "ref int, excerpt string, put string, frees boolean")
    assert sorted(r.ref for r in rules.kept_facts(found).collect()) == [2, 3]


def test_reports(spark):
    rows = [(1, "Alpha Beta Gamma, “A. Ash, B. Birch, on rings”, in Proc. IPAC’22, Venice, Italy, May 2021."), (2, "A. Alpha, “T”, Nature, p. 4, vol. 3, \\emph{x}.")]
    refs = spark.createDataFrame(rows, "ref int, text string")
    codes = {(r.ref, r.code) for r in rules.issues(refs).filter("put is null").collect()}
    assert {(1, "REF-AUTH-FORM"), (1, "REF-TITLE-NAMES"), (1, "REF-PROC-YEAR"), (2, "REF-JOURNAL-ORDER"), (2, "REF-LATEX")} <= codes
    lost = {(r.ref, r.category, r.field, r.code) for r in rules.lacking(refs).collect()}
    assert lost == {(1, "conference", "pages", "REF-PAGES-MISSING"), (2, "journal", "year", "REF-YEAR-MISSING")}
