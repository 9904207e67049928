"""Conferences in texts: labels, long names and DOIs of a series, and the edition that is meant.

A text is read once.  Labels are a series' code with a year of two or four digits; long
names are found by one automaton over the words of all names, of names that overlap the
leftmost and of these the longest, and a name's last word may go on (Conf, Conference).
A DOI of proceedings names its series and year.  Spans are half-open, in code points.

Editions meet a label by series and year.  A name without a year meets the last edition
that began by the text's date: an edition's place among its series' is found in the
series' sorted list, so that no series is a window of its own, however many texts name it.

Defined results: null texts have no rows.  Years outside 1960 to 2040 make no label.  A
list of series beyond ``NAMES`` is read in parts, by one automaton after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from proofmill.operators.edits import scanned

#: Names of one automaton.
NAMES = 20_000
#: Two digits of a year above this are of the last century; years that a label may have.
PIVOT, YEARS = 60, (1960, 2040)
#: Fixed value: the prefix of DOIs of proceedings.
PREFIX = "10.18429/"
#: Marks between a series and its year.
MARKS = "-'’‘`´"

_WORD = re.compile(r"[^\W_]+")
_STATED = re.compile(r"(?:(?<=[\s,(])|^)(?:19|20)[0-9]{2}(?=[\s,.)]|$)")


class Series:
    """What texts are searched for: codes, long names and DOIs of some series."""

    def __init__(self, rows: list[tuple[str, str | None]]) -> None:
        self.codes = {code.lower(): code for code, _ in rows}
        names = {" ".join(_WORD.findall(long.lower())): code for code, long in rows if long}
        self.names = ahocorasick.Automaton()
        for name, code in names.items():
            if name:
                self.names.add_word(f" {name}", (len(name), code))
        self.names.make_automaton()
        codes = "|".join(re.escape(c) for c in sorted(self.codes, key=lambda c: (-len(c), c)))
        year = r"((?:19|20)[0-9]{2}|[0-9]{2})(?!\w)"
        self.label = re.compile(rf"(?<![\w\-/])({codes})\s*(?:[{MARKS}]\s*)?(?:[{MARKS}]\s*)?{year}", re.I)
        self.doi = re.compile(rf"{re.escape(PREFIX)}[A-Za-z]+-({codes})((?:19|20)[0-9]{{2}})(?![0-9])", re.I)

    def dated(self, found: re.Pattern, text: str) -> Iterator[tuple[int, int, str, int]]:
        for m in found.finditer(text):
            year = int(m[2])
            year += (1900 if year > PIVOT else 2000) if len(m[2]) == 2 else 0
            if YEARS[0] <= year <= YEARS[1]:
                yield m.start(), m.end(), self.codes[m[1].lower()], year

    def found(self, text: str) -> Iterator[tuple]:
        """(start, end, kind, series, year, stated, written); ``stated`` is the first year written behind a label."""
        for start, end, code, year in self.dated(self.label, text):
            behind = _STATED.search(text, end)
            yield start, end, "label", code, year, int(behind[0]) if behind else None, text[start:end]
        for start, end, code, year in self.dated(self.doi, text):
            yield start, end, "doi", code, year, None, text[start:end]
        if not len(self.names):
            return
        spans = [m.span() for m in _WORD.finditer(text)]
        plain, places = [], []
        for i, (a, b) in enumerate(spans):
            word = text[a:b].lower()
            plain.append(f" {word}")
            places += [i] * (len(word) + 1)
        line, until = "".join(plain), -1
        hits: dict[int, tuple[int, str]] = {}
        for last, (size, code) in self.names.iter(line):
            hits[last - size] = max(hits.get(last - size, (0, "")), (size, code))
        for at in sorted(hits):
            size, code = hits[at]
            if at > until:
                until = at + size
                a, b = spans[places[at]][0], spans[places[at + size]][1]
                yield a, b, "name", code, None, None, text[a:b]


def found(texts: DataFrame, series: DataFrame) -> DataFrame:
    """(file, start, end, kind, series, year, stated, written) of ``texts`` (file, text).

    ``series``: series, long; a series may have several long names, or none (null).
    """
    own = series.filter("trim(series) <> ''").select("series", "long").distinct()
    parts = max(1, -(-own.count() // NAMES))
    fields = "start int, end int, kind string, series string, year int, stated int, written string"
    out = []
    for i in range(parts):
        rows = [tuple(r) for r in own.filter(F.pmod(F.xxhash64("series"), F.lit(parts)) == i).collect()]
        if rows:
            out.append(scanned(texts.select("file", "text"), Series(rows).found, fields))
    return reduce(DataFrame.unionByName, out) if out else scanned(texts.select("file", "text").limit(0), lambda _: iter(()), fields)


def label_of(series, year):
    return F.concat(series, F.lit("’"), F.lpad((year % 100).cast("string"), 2, "0"))


def label_issues(rows: DataFrame) -> DataFrame:
    """(file, start, end, before, after): labels that aren't written as their series and two digits; either apostrophe will do."""
    after = label_of(F.col("series"), F.col("year"))
    same = F.translate("written", "'", "’") == after
    return rows.filter(F.col("kind") == "label").select("file", "start", "end", F.col("written").alias("before"), after.alias("after"), same.alias("same")).filter("not same").drop("same")


def year_issues(rows: DataFrame) -> DataFrame:
    """(file, start, end, series, year, stated): labels whose year isn't the first one written behind them."""
    return rows.filter((F.col("kind") == "label") & (F.col("stated") % 100 != F.col("year") % 100)).select("file", "start", "end", "series", "year", "stated")


def unnamed(rows: DataFrame) -> DataFrame:
    """(file, series, year, label, at): texts whose DOI names a conference that no label names; ``at`` is the end of the series' first long name, or null."""
    dois = rows.filter(F.col("kind") == "doi").groupBy("file", "series").agg(F.min("year").alias("year"))
    labels = rows.filter(F.col("kind") == "label").select("file", "series").distinct()
    names = rows.filter(F.col("kind") == "name").groupBy("file", "series").agg(F.min_by("end", "start").alias("at"))
    lost = dois.join(labels, ["file", "series"], "left_anti").join(names, ["file", "series"], "left")
    return lost.select("file", "series", "year", label_of(F.col("series"), F.col("year")).alias("label"), "at")


def editions_meant(rows: DataFrame, dates: DataFrame, editions: DataFrame) -> DataFrame:
    """(file, start, end, kind, series, year, began, place): each label or name with its edition, if the list has it.

    ``dates``: file, date.  ``editions``: series, year, began, place; of rows with one series and year the
    first to begin counts.
    """
    one = editions.filter("series IS NOT NULL AND began IS NOT NULL").groupBy("series", "year").agg(F.min(F.struct("began", "place")).alias("e"))
    lists = one.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("e.began", "year", "e.place"))).alias("held"))
    asked = rows.filter(F.col("kind").isin("label", "name")).join(dates.select("file", "date"), "file", "left")
    fits = F.when(F.col("kind") == "label", F.filter("held", lambda e: e["year"] == F.col("year"))).otherwise(F.filter("held", lambda e: e["began"] <= F.col("date")))
    met = asked.join(lists, "series", "left").withColumn("e", F.try_element_at(fits, F.lit(-1)))
    return met.select("file", "start", "end", "kind", "series", F.coalesce("year", "e.year").alias("year"), "e.began", "e.place")
