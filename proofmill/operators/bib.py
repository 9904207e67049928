"""BibTeX files: entries, fields and values with their spans, and rewrites that leave all else alone.

A file is read once.  One pass over its braces pairs them by a stack; from then on
every brace knows its partner, so entries, nested values and broken ones cost
their length.  Braces count in quoted values too, and a backslash doesn't hide
them, as BibTeX has it.  An entry whose brace has no partner is reported as
unclosed, and reading goes on behind its opening, so one slip doesn't swallow the
entries after it.

Spans are half-open and count code points.  A value in one pair of braces or quotes
has the span between them; a number, a name or a concatenation has its own.
Rewrites are edits of spans, applied by ``edits.apply``: what no edit covers stays
byte for byte.

Defined results: a null or empty file has no rows.  Comments, preambles and text
between entries have none either.  A field that is given twice has two rows; an
entry without fields has one row without a field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from proofmill.operators import edits
from proofmill.operators.edits import scanned

_BRACE = re.compile(r"[{}]")
_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
_KEY = re.compile(r"\s*([^\s,{}()\"=#%]*)\s*(?=[,})]|\Z)")
_NAME = re.compile(r"[\s,]*([A-Za-z][^\s,={}()\"#%]*)\s*=\s*")
_BARE = re.compile(r"[^\s,#{}()\"=%@]+")
_JOIN = re.compile(r"\s*#\s*")
_SPACE = re.compile(r"\s*")
SKIPPED = ("comment", "preamble")


def paired(text: str) -> dict[int, int]:
    """The closing brace of each opening one that has one."""
    out, open_ = {}, []
    for m in _BRACE.finditer(text):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def _value(text: str, at: int, close: dict[int, int]) -> tuple[int, int, int, int] | None:
    """(start, end, inner start, inner end) of the value at ``at``; nothing if it isn't one."""
    start, parts = at, []
    while True:
        c = text[at : at + 1]
        if c == "{" and at in close:
            end = close[at] + 1
        elif c == '"':
            end = at + 1
            while end < len(text) and text[end] != '"':
                end = close[end] + 1 if text[end] == "{" and end in close else end + 1
            if end >= len(text):
                return None
            end += 1
        elif m := _BARE.match(text, at):
            end = m.end()
        else:
            return None
        parts.append((at, end, c in '{"' and c != ""))
        join = _JOIN.match(text, end)
        if not join:
            break
        at = join.end()
    first, last, wrapped = parts[0]
    return (start, end, first + 1, last - 1) if len(parts) == 1 and wrapped else (start, end, start, end)


def _entries_of(text: str) -> Iterator[tuple]:
    """(entry, kind, key, entry_start, entry_end, fault, n, field, start, end, value, name as written, its start)."""
    close, at, number = paired(text), 0, 0
    while m := _ENTRY.search(text, at):
        kind, opening = m[1].lower(), m.end() - 1
        if kind in SKIPPED and (opening in close or m[2] == "("):
            at = close[opening] + 1 if opening in close else m.end()
            continue
        if m[2] == "{" and opening not in close:
            yield number, kind, "", m.start(), m.end(), "unclosed", *[None] * 7
            number, at = number + 1, m.end()
            continue
        at, fields, fault = m.end(), [], None
        key = ""
        if kind != "string" and (k := _KEY.match(text, at)):
            key, at = k[1], k.end()
        while name := _NAME.match(text, at):
            found = _value(text, name.end(), close)
            if found is None:
                fault = "value"
                at = name.end()
                break
            fields.append((name[1], name.start(1), found[2], found[3]))
            at = found[1]
        if m[2] == "{":
            end = close[opening] + 1
        else:
            end = _SPACE.match(text, at).end()
            end = _SPACE.match(text, end + 1).end() if text[end : end + 1] == "," else end
            if text[end : end + 1] != ")":
                fault, end = fault or "unclosed", at
            else:
                end += 1
        if fault is None and text[at : end - 1].strip(", \t\r\n"):
            fault = "rest"
        head = (number, kind, key, m.start(), end, fault)
        for n, (name, at_name, a, b) in enumerate(fields):
            yield *head, n, name.lower(), a, b, text[a:b], name, at_name
        if not fields:
            yield *head, *[None] * 7
        number, at = number + 1, max(end, m.end())


def fields(files: DataFrame) -> DataFrame:
    """A row per field of ``files`` (file, text): entry number, kind, key and span, a fault of the entry, and the field with its value and span."""
    return scanned(files, _entries_of, "entry int, kind string, key string, entry_start int, entry_end int, fault string, n int, field string, start int, end int, value string, name string, name_start int")


# Months as .bib files name them.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _rule(code: str, where: Column, after: Column, priority: int) -> Column:
    return F.when(where & (after != F.col("value")), F.struct(F.lit(code).alias("check_id"), after.alias("after"), F.lit(priority).alias("priority")))


def proposals(found: DataFrame) -> DataFrame:
    """Edits of values of ``fields`` into the house's forms: (file, start, end, before, after, check_id, priority)."""
    value, field = F.col("value"), F.col("field")
    bare = F.regexp_replace(F.trim(value), r"^(?i:(?:https?://)?(?:dx\.|www\.)?doi\.org/|doi:\s*)(?=10\.)", "")
    rules = [
        _rule("DOI-FMT-03", (field == "doi") & value.rlike(r"10\."), bare, 40),
        _rule("REF-PAGES-01", (field == "pages") & value.rlike(r"^\s*\w+\s*[-–—]+\s*\w+\s*$"), F.regexp_replace(value, r"^\s*(\w+)\s*[-–—]+\s*(\w+)\s*$", "$1--$2"), 50),
        _rule("FMT-YEAR", field == "year", F.regexp_replace(value, r"^\s*\(?((?:19|20)[0-9]{2})\)?\s*$", "$1"), 60),
    ]
    rows = found.filter("field is not null").select("file", "start", "end", F.col("value").alias("before"), F.explode(F.array_compact(F.array(*rules))).alias("r"))
    return rows.select("file", "start", "end", "before", "r.after", "r.check_id", "r.priority")


def addresses(found: DataFrame) -> DataFrame:
    """Edits for entries whose address is a DOI that no field of theirs gives: the field ``url`` becomes ``doi`` with the DOI alone."""
    doi = F.regexp_extract("value", r"^\s*(?i:https?://(?:dx\.|www\.)?doi\.org/)(10\.\S+?)\s*$", 1)
    links = found.filter(F.col("field") == "url").withColumn("doi", doi).filter("doi <> ''")
    given = found.filter(F.col("field") == "doi").select("file", "entry").distinct()
    own = links.join(given, ["file", "entry"], "left_anti")
    edit = lambda start, end, before, after: F.struct(start.alias("start"), end.alias("end"), before.alias("before"), after.alias("after"))
    both = F.array(edit(F.col("start"), F.col("end"), F.col("value"), F.col("doi")), edit(F.col("name_start"), F.col("name_start") + F.length("name"), F.col("name"), F.lit("doi")))
    return own.select("file", F.explode(both).alias("e")).select("file", "e.*", F.lit("URL-AS-DOI-01").alias("check_id"), F.lit(45).alias("priority"))


def rewritten(files: DataFrame) -> DataFrame:
    """(file, text, n_applied) of ``files`` (file, text) with all proposed values put in; whatever no edit covers stays."""
    found = fields(files)
    return edits.apply(edits.resolve(proposals(found).unionByName(addresses(found))), files)


def faults(files: DataFrame) -> DataFrame:
    """(file, entry, kind, key, fault) of entries that couldn't be read whole."""
    return fields(files).filter("fault is not null").select("file", "entry", "kind", "key", "fault").distinct()
