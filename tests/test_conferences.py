"""Conferences in texts by literal cases, names against all places, editions against a plain search."""

import random
from datetime import date

from proofmill.operators import conferences as C

LIST = [("IPAC", "International Particle Accelerator Conf"), ("PAC", "Particle Accelerator Conf"), ("NAPAC", "North American Particle Accelerator Conf"), ("FEL", "Free Electron Laser Conf"), ("HB", None), ("NA-PAC", "")]


def spans(text, kinds=("label", "name", "doi")):
    return [(k, s, y, w) for _, _, k, s, y, _, w in C.Series(LIST).found(text) if k in kinds]


def test_labels_and_dois():
    for written, series, year in [("IPAC’23", "IPAC", 2023), ("ipac'23", "IPAC", 2023), ("IPAC 2023", "IPAC", 2023), ("IPAC-99", "IPAC", 1999), ("FEL ‘61", "FEL", 1961), ("PAC2009", "PAC", 2009), ("na-pac 16", "NA-PAC", 2016)]:
        assert spans(f"in ({written}), p. 1") == [("label", series, year, written)], written
    for text in ["IPAC’60", "IPAC 1959", "IPAC 2041", "IPAC 123", "XIPAC23", "10.18429/JACoW-X-IPAC23", "IPAC", "", "IPAC23rd"]:
        assert spans(text) == [], text
    assert spans("doi:10.18429/JACoW-IPAC2023-MO1") == [("doi", "IPAC", 2023, "10.18429/JACoW-IPAC2023")]


def test_names():
    assert spans("the 2nd North-American\n Particle  accelerator CONFERENCE.") == [("name", "NAPAC", None, "North-American\n Particle  accelerator CONFERENCE")]
    assert spans("Particle Accelerator Confs and international particle accelerator conf") == [("name", "PAC", None, "Particle Accelerator Confs"), ("name", "IPAC", None, "international particle accelerator conf")]
    assert spans("Antiparticle Accelerator Conf; Free Electron Lasers Conf") == []


def test_issues_and_editions(spark):
    texts = spark.createDataFrame(
        [(1, "IPAC 2023, Venice, May 2024."), (2, "IPAC'23, 2023"), (3, "Particle Accelerator Conf., 10.18429/JACoW-PAC2009-A"), (4, "10.18429/JACoW-FEL2010-A, FEL’10"), (5, None), (6, ""), (7, "10.18429/JACoW-HB2010-A"), (8, "HB’12")],
        "file int, text string",
    )
    rows = C.found(texts, spark.createDataFrame(LIST, "series string, long string"))
    assert [(r.file, r.before, r.after) for r in C.label_issues(rows).collect()] == [(1, "IPAC 2023", "IPAC’23")]
    assert [(r.file, r.year, r.stated) for r in C.year_issues(rows).collect()] == [(1, 2023, 2024)]
    assert sorted((r.file, r.label, r.at) for r in C.unnamed(rows).collect()) == [(3, "PAC’09", 25), (7, "HB’10", None)]
    dates = spark.createDataFrame([(i, date(2012, 6, 1)) for i in range(1, 8)], "file int, date date")
    editions = spark.createDataFrame([("PAC", 2009, date(2009, 5, 4), "V"), ("PAC", 2011, date(2011, 3, 1), "N"), ("PAC", 2013, date(2013, 3, 1), "P"), ("IPAC", 2023, date(2023, 5, 1), "Z"), ("IPAC", 2023, date(2023, 4, 1), "A"), ("HB", 2012, None, "B"), (None, 1, date(2000, 1, 1), "")], "series string, year int, began date, place string")
    got = sorted((r.file, r.kind, r.year, r.place) for r in C.editions_meant(rows, dates, editions).collect())
    assert got == [(1, "label", 2023, "A"), (2, "label", 2023, "A"), (3, "name", 2011, "N"), (4, "label", 2010, None), (8, "label", 2012, None)]
    none = spark.createDataFrame([], "series string, long string")
    assert C.found(texts, none).count() == 0 and C.found(texts.limit(0), none).columns == rows.columns


def test_names_are_leftmost_longest(spark, monkeypatch):
    rng = random.Random(9)
    pool = ["a", "b", "ab", "c"]
    names = sorted({" ".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(25)})
    own = [(f"S{i}", n) for i, n in enumerate(names)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(200)]

    def plain(words):
        out, i = [], 0
        while i < len(words):
            rest = " ".join(words[i:])
            fits = [n for n in names if rest.startswith(n)]
            if fits:
                n = max(fits, key=len)
                out.append(n)
                i += len(n.split())
            else:
                i += 1
        return out

    code = dict(own)
    for t in texts:
        assert [code[s] for _, _, k, s, _, _, _ in C.Series(own).found(t)] == plain(t.split()), t
    monkeypatch.setattr(C, "NAMES", 2)
    docs = spark.createDataFrame([(1, "IPAC’23 FEL’24 HB 2020 PAC’01")], "file int, text string")
    assert sorted(r.series for r in C.found(docs, spark.createDataFrame(LIST, "series string, long string")).collect()) == ["FEL", "HB", "IPAC", "PAC"]
