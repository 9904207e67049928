"""LaTeX as plain text, with a map of offsets back to the source.

A source is read once: comments and structural commands go, accents are composed,
special letters, dashes, quotation marks, ties and escapes become what they print,
groups are opened, arguments of known commands are kept or dropped.  What was copied,
composed or dropped is a run: (out_start, out_end, start, end), half-open, in code
points of the text and the source.  Runs are in order on both sides and cover the text, so
any span of the text has its span in the source, and edits that were found in the
text can be made in the source.

Defined results: a null source has no text; an empty one is empty.  An accent on a
letter that Unicode has no form for keeps the combining mark.  Commands that aren't
known go, their arguments stay.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from proofmill.operators.edits import scanned_pairs
from proofmill.session import dealt

# Accents by their command, as combining marks.
ACCENTS = {"`": "̀", "'": "́", "^": "̂", "~": "̃", '"': "̈", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "d": "̣", "b": "̱", "r": "̊", "k": "̨", "t": "͡"}
# Letters and signs by their command.
LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "dots": "…", "ldots": "…", "textendash": "–", "textemdash": "—", "textquoteright": "’", "textquoteleft": "‘", "S": "§", "copyright": "©", "textdegree": "°", "textmu": "µ"}
# Signs that print as others, longest first.
SIGNS = {"---": "—", "--": "–", "``": "“", "''": "”", "`": "‘", "'": "’", "~": " "}
DROPPED = "cite|citep|citet|label|ref|eqref|cref|autoref|vspace|hspace|includegraphics|bibliographystyle|usepackage|documentclass|begin|end|footnotemark|thanks|pagestyle|input|include"
SECOND = "href|textcolor"

_TOKEN = re.compile(
    r"(?P<comment>(?<!\\)%[^\n]*\n?[ \t]*)"
    rf"|(?P<dropped>\\(?:{DROPPED})\*?\s*(?:\[[^\[\]]*\])?\s*\{{[^{{}}]*\}})"
    rf"|(?P<second>\\(?:{SECOND})\s*\{{[^{{}}]*\}}\s*(?=\{{))"
    r"|\\(?P<mark>[`'^~\"=.]|[uvHcdbrkt](?![A-Za-z]))\s*(?:\{\s*\\?(?P<in>[^\W\d_])\s*\}|\\?(?P<on>[^\W\d_]))"
    rf"|\\(?P<letter>{'|'.join(sorted(LETTERS, key=len, reverse=True))})(?![A-Za-z])(?:\{{\}}|[ \t]+)?"
    r"|\\(?P<escaped>[%&$#_{}])|(?P<space>\\[,;:! ]|\\\\(?:\[[^\]]*\])?|\\(?:quad|qquad|newline|par)(?![A-Za-z])[ \t]*)"
    r"|(?P<command>\\[A-Za-z]+\*?[ \t]*|\\.)|(?P<sign>---|--|``|''|[`'~])|(?P<gone>[{}$])",
    re.S,
)


def _printed(m: re.Match) -> str:
    kind = m.lastgroup
    if kind in ("in", "on"):
        base = {"i": "i", "j": "j"}.get(m[kind], m[kind])
        return unicodedata.normalize("NFC", base + ACCENTS[m["mark"]])
    if kind == "letter":
        return LETTERS[m["letter"]]
    if kind == "escaped":
        return m["escaped"]
    if kind == "space":
        return " "
    return SIGNS[m["sign"]] if kind == "sign" else ""


def plain(source: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text, and its runs."""
    out, runs, at, size = [], [], 0, 0

    def add(text: str, start: int, end: int) -> None:
        nonlocal size
        if text or start < end:
            out.append(text)
            runs.append((size, size + len(text), start, end))
            size += len(text)

    for m in _TOKEN.finditer(source):
        add(source[at : m.start()], at, m.start())
        add(_printed(m), m.start(), m.end())
        at = m.end()
    add(source[at:], at, len(source))
    return "".join(out), runs


def source_span(runs: list[tuple[int, int, int, int]], start: int, end: int, copied: list[bool] | None = None) -> tuple[int, int]:
    """The span of the source behind a span of the text: exact where text was copied, whole runs where it was made."""
    shown = [r for r in runs if r[1] > r[0]]
    begins = [r[0] for r in shown]
    if not shown:
        return (0, 0)

    def place(at: int, left: bool) -> int:
        i = max(0, (bisect.bisect_right(begins, at) if left else bisect.bisect_left(begins, at)) - 1)
        a, b, s, e = shown[i]
        if b - a == e - s:
            return s + min(at, b) - a
        return s if left else e

    first = place(start, True)
    return (first, first) if start == end else (first, place(end, False))


def texts(sources: DataFrame) -> DataFrame:
    """(file, text, out_starts, starts, ends) of ``sources`` (file, text): the text and its runs, as arrays."""

    def scan(source: str) -> Iterator[tuple]:
        text, runs = plain(source)
        yield text, " ".join(f"{a}:{b}:{s}:{e}" for a, b, s, e in runs)

    made = scanned_pairs(sources.select("file", "text"), scan, "text string, runs string")
    parts = F.transform(F.filter(F.split("runs", " "), lambda r: r != ""), lambda r: F.transform(F.split(r, ":"), lambda n: n.cast("int")))
    return made.select("file", "text", F.transform(parts, lambda p: F.struct(p[0].alias("out_start"), p[1].alias("out_end"), p[2].alias("start"), p[3].alias("end"))).alias("runs"))


def in_source(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, start, end, from, to): spans of the text (file, start, end) with theirs in the source."""
    own = dealt(spans, "file").groupBy("file").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = dealt(sources, "file").join(own, "file").select("file", "text", F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["end"]).alias("ends"))

    def scan(source: str, starts: list[int], ends: list[int]) -> Iterator[tuple]:
        _, runs = plain(source)
        for a, b in zip(starts, ends, strict=True):
            yield a, b, *source_span(runs, a, b)

    return scanned_pairs(rows, scan, "start int, end int, from int, to int")
