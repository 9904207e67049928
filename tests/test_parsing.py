"""References of every kind as fixed points of reading and writing; spans; what can't be read."""

import pytest

from proofmill.operators import parsing

KINDS = [
    ("conference", "M. Ash, “Rings, stops. And: colons”, in Proc. SRF’21, Grand Rapids, MI, USA, Jun.-Jul. 2021, pp. 3-9. doi:10.18429/JACoW-SRF2021-A1"),
    ("conference", "M. Ash et al., “No link”, in Proc. FEL’09, Liverpool, UK, Aug. 2009, paper MOPC01, p. 12."),
    ("conference_unpublished", "M. Ash and N. O. Birch, “A talk”, presented at IBIC’16, Barcelona, Spain, Sep. 2016, paper TUAL1, unpublished."),
    ("conference_current", "M. Ash, “A poster”, presented at IPAC’24, Nashville, TN, USA, May 2024, paper WEPG3, this conference."),
    ("journal", "M. Ash, N. Birch, and O.-P. Cedar, “On [square] things”, J. Synchrotron Radiat., vol. 9, no. 2, pp. 4-5, Mar. 2002. doi:10.1107/S0909049501"),
    ("accepted", "M. Ash, “Soon”, Nature, to be published."),
    ("submitted", "M. Ash, “Sooner”, submitted for publication."),
    ("arxiv", "M. Ash, “Early”, Feb. 2020. doi:10.48550/arXiv.2002.01234"),
    ("online", "MAD-X, https://mad.web.example.ch/mad"),
    ("book_chapter", "M. Ash, “Chapter”, in A Book of Trees, N. Birch and O. Cedar, Eds. Berlin, Germany: Springer, 2011, pp. 1-20."),
    ("book", "M. Ash, Trees and Their Rings, 4th ed., N. Birch, Ed. Oxford, UK: Oxford Press, 1999."),
    ("report", "M. Ash, “Losses”, Fermilab, Batavia, IL, USA, Rep. TM-2000, Nov. 1997. https://lss.example.gov/tm2000.pdf"),
    ("technical_report", "Ring Design Report, 2nd ed., M. Ash, Ed., Fermilab, Batavia, IL, USA, Rep. 88-1, 1988."),
    ("thesis", "M. Ash, “Slow waves”, Ph.D. thesis, Phys. Dept., Lund University, Lund, Sweden, 2018."),
    ("handbook", "Magnet Handbook, Magnets Ltd., Poland, 2003, pp. 7-8, http://magnets.example.pl/h"),
    ("manual", "Style Manual, Editors Union, Leeds, UK, Apr. 2001. https://editors.example.uk/m"),
    ("patent", "M. Ash, “A valve”, U.S. Patent 1 234 567, Feb. 3, 1990."),
    ("patent", "M. Ash, “A valve”, U.S. Patent, patent pending."),
    ("unpublished", "M. Ash, “Notes”, unpublished."),
    ("private", "M. Ash, private communication, Dec. 2019."),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(i, t) for i, (_, t) in enumerate(KINDS)]
    rows += [(100, None), (101, ""), (102, " , . "), (103, "some words, and more of them, 99"), (104, "“Title only”"), (105, "M. Ash “No comma” Phys. Rev. Lett., vol. 3, 2001"), (106, "é \U0001f600 X. Yew, “T”, unpublished.")]
    refs = spark.createDataFrame(rows, "ref int, text string")
    fields = parsing.parsed(refs).collect()
    return dict(rows), fields, {r.ref: (r.category, r.text) for r in parsing.rendered(parsing.parsed(refs)).collect()}


def test_every_kind_is_a_fixed_point(read):
    assert {i: read[2][i] for i in range(len(KINDS))} == dict(enumerate(KINDS))


def test_spans_hold_their_values(read):
    texts, fields, _ = read
    assert all(texts[r.ref][r.start : r.end] == r.value for r in fields)


def test_fields(read):
    of = lambda ref: {r.field: r.value for r in read[1] if r.ref == ref}
    assert of(9) == {"authors": "M. Ash", "title": "Chapter", "book": "A Book of Trees", "editors": "N. Birch and O. Cedar", "city": "Berlin", "country": "Germany", "publisher": "Springer", "year": "2011", "pages": "1-20"}
    assert of(14) == {"title": "Magnet Handbook", "organization": "Magnets Ltd.", "country": "Poland", "year": "2003", "pages": "7-8", "url": "http://magnets.example.pl/h"}
    assert of(105) == {"authors": "M. Ash", "title": "No comma", "journal": "Phys. Rev. Lett.", "volume": "3", "year": "2001"}


def test_what_cannot_be_read_is_left(read):
    kinds = {r.ref: r.category for r in read[1]}
    assert not {100, 101, 102} & set(kinds) and kinds[103] == ""
    assert [r.value for r in sorted((r for r in read[1] if r.ref == 103), key=lambda r: r.start)] == ["some words, and more of them, 99"]
    assert {r.field for r in read[1] if r.ref == 104} == {"title"}
