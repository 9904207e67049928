"""Protected text of LaTeX sources, and edits of measurements outside it.

A source is scanned once, from left to right.  Comments, mathematics, verbatim text,
environments of these kinds and arguments of commands that aren't prose are intervals
with a kind; an escaped sign opens nothing, and what is never closed protects
nothing.  Intervals are half-open, in code points, in order and apart from one
another.  The list of references is an interval of its own, which may hold others.

A measurement is a number, a separator and a known unit.  It becomes one edit, which
settles spacing and case together.  Case is only offered where one unit alone has the
spelling in lower case: which of mT and MT was meant can't be told from the letters.  A number behind a
word like Fig. is a label, be it by a space or a tie.
Which form is written is a paper's house style: a macro, or a tie.

Defined results: null sources have no rows.  Edits without a span are outside.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from proofmill.operators.edits import in_blocks, scanned, scanned_pairs

# Environments whose text isn't prose, and commands whose argument isn't.
ENVIRONMENTS = "equation|equation*|align|align*|eqnarray|eqnarray*|gather|gather*|multline|multline*|split|verbatim|lstlisting|Verbatim|minted|tabular|tabularx|array"
COMMANDS = "label|ref|eqref|cref|Cref|autoref|pageref|includegraphics|input|include|bibliography|addbibresource|documentclass|usepackage|url|href|nolinkurl|path|verb"
# Units by what they measure.
UNITS = (
    "eV meV keV MeV GeV TeV PeV Hz kHz MHz GHz THz m pm nm um mm cm km s fs ps ns us ms min h A pA nA uA mA kA MA V uV mV kV MV GV TV "
    "W uW mW kW MW GW TW PW T nT uT mT kT MT GT G uG mG kG MG K mK uK Pa hPa kPa MPa GPa bar mbar Torr mTorr rad urad mrad sr deg "
    "Gy mGy kGy Bq Sv mSv uSv C pC nC uC mC g mg ug kg mol cd lm lx F pF nF uF mF H nH uH mH ohm kohm Mohm J mJ uJ kJ MJ GJ N mN kN dB dBm ppm ppb rpm eVs"
).split()
# Words before a number that make it a label.
COUNTERS = "fig figs figure figures tab tabs table tables sec secs section sections eq eqs equation equations ref refs reference references chap chaps chapter chapters app appendix no nos page pages p pp vol volume item step phase type class mode run shot case option version v".split()
#: Classes of documents that load the macros of units.
MACRO_CLASSES = ("jacow",)

_ZONE = re.compile(
    r"(?P<verbatim>\\verb(?P<bar>[|!]).*?(?P=bar))|(?P<display>\\\[.*?\\\])"
    rf"|(?P<environment>\\begin\{{(?P<name>{'|'.join(re.escape(e) for e in ENVIRONMENTS.split('|'))})\}}.*?\\end\{{(?P=name)\}})"
    rf"|(?P<argument>\\(?:cite[a-z*]*|{COMMANDS})(?![A-Za-z])\s*(?:\[[^\]]*\])?\s*\{{[^{{}}]*\}})"
    r"|\\.|(?P<comment>%[^\n]*)|(?P<inline>\$(?:\\.|[^$\\])*\$)",
    re.S,
)
_KINDS = ("verbatim", "display", "environment", "argument", "comment", "inline")
_LIST = re.compile(r"\\begin\{thebibliography\}.*?\\end\{thebibliography\}", re.S)
_MEASURE = re.compile(r"(?<![\\\w.])(?P<number>[+-]?(?:\d+(?:\.\d+)?|\.\d+))(?:(?P<gap>[ \t]+|\\,|~)(?P<unit>[A-Za-zµΩ]+)(?![A-Za-z])|(?P<space>[ \t]+)\\%)")
_BEFORE = re.compile(r"([A-Za-z]+)\.?[\s~]*$")
_MACRO = re.compile(r"\\(?:qty|SI)\s*(?:\[[^\]]*\])?\{")
_LOADED = re.compile(rf"\\usepackage\s*(?:\[[^\]]*\])?\{{[^}}]*\bsiunitx\b|\\documentclass\s*(?:\[[^\]]*\])?\{{(?:{'|'.join(MACRO_CLASSES)})\}}")


def _spellings() -> dict[str, list[str]]:
    by: dict[str, list[str]] = {}
    for u in UNITS:
        by.setdefault(u.lower(), []).append(u)
    return by


SPELLINGS = _spellings()


def zones(source: str) -> Iterator[tuple[int, int, str]]:
    for m in _ZONE.finditer(source):
        kind = next((k for k in _KINDS if m[k] is not None), None)
        if kind:
            yield m.start(), m.end(), kind


def protected_spans(sources: DataFrame) -> DataFrame:
    """(file, start, end, kind) of ``sources`` (file, text), the lists of references among them."""

    def scan(source: str) -> Iterator[tuple]:
        yield from zones(source)
        for m in _LIST.finditer(source):
            yield m.start(), m.end(), "references"

    return scanned(sources, scan, "start int, end int, kind string")


def outside(edits: DataFrame, spans: DataFrame) -> DataFrame:
    """Those of ``edits`` (file, start, end, ...) that share no character with any of ``spans``; an insertion may not be within one.

    Both meet by the blocks of text that they reach into, so that a long file is many keys.
    """
    own = [c for c in edits.columns if c not in ("file", "start", "end")]
    asked = edits.select("file", "start", "end").filter("start IS NOT NULL AND end IS NOT NULL").distinct()
    s = in_blocks(spans.select("file", F.col("start").alias("from"), F.col("end").alias("to")), "from", "to")
    touch = (F.col("from") < F.col("end")) & (F.col("start") < F.col("to"))
    hit = in_blocks(asked, "start", "end").join(s, ["file", "block"]).filter(touch).select("file", "start", "end").distinct()
    return edits.join(hit, ["file", "start", "end"], "left_anti").select("file", "start", "end", *own)


def measured(source: str) -> Iterator[tuple[re.Match, str]]:
    """Measurements of the prose of a source, each with the unit's right spelling (empty for a share in percent)."""
    held = list(zones(source))
    starts = [z[0] for z in held]
    lists = [m.span() for m in _LIST.finditer(source)]
    for m in _MEASURE.finditer(source):
        i = bisect_right(starts, m.end() - 1) - 1
        if i >= 0 and held[i][1] > m.start():
            continue
        if m["unit"] is None:
            yield m, ""
            continue
        known = SPELLINGS.get(m["unit"].lower())
        word = _BEFORE.search(source, max(0, m.start() - 24), m.start())
        if known is None or (word and word[1].lower() in COUNTERS) or any(a <= m.start() < b for a, b in lists):
            continue
        right = known[0] if len(known) == 1 and len(known[0]) > 1 else m["unit"]
        yield m, right


def unit_forms(sources: DataFrame, by: str = "file") -> DataFrame:
    """(``by``, macro, tie, thin, plain, loaded), a row for each source: how often it writes measurements in each form, and whether its macros are there."""

    def scan(source: str) -> Iterator[tuple]:
        gaps = [m["gap"] for m, right in measured(source) if right]
        macros = sum(1 for _ in _MACRO.finditer(source))
        tie, thin = gaps.count("~"), gaps.count("\\,")
        yield macros, tie, thin, len(gaps) - tie - thin, int(macros > 0 or _LOADED.search(source) is not None)

    counts = scanned_pairs(sources.select(by, "text"), scan, "macro bigint, tie bigint, thin bigint, plain bigint, loaded int")
    return counts.withColumn("loaded", F.col("loaded") == 1)


def house_styles(sources: DataFrame, by: str, profiles: DataFrame | None = None) -> DataFrame:
    """(by, style): what most measurements of a conference's files use, 'macro' or 'tie'; 'auto' where as many use either.

    ``sources``: file, text and the column ``by``.  A row of ``profiles`` (by, style) goes first.
    """
    counts = unit_forms(sources, by).groupBy(by).agg(F.sum("macro").alias("macro"), F.sum("tie").alias("tie"))
    most = F.when(F.col("macro") > F.col("tie"), "macro").when(F.col("tie") > F.col("macro"), "tie").otherwise("auto")
    found = counts.select(by, most.alias("style"))
    if profiles is None:
        return found
    return found.join(profiles.select(by, F.col("style").alias("__given")), by, "left").select(by, F.coalesce("__given", "style").alias("style"))


def unit_edits(sources: DataFrame, priority: int = 60) -> DataFrame:
    """Edits of measurements: file, start, end, before, after, check_id, priority, tier.

    ``sources``: file, text, and ``style``, if given: 'macro', 'tie' or 'auto' (a macro where the
    source has macros; so does null).  A macro is only written where a source has them.
    """
    style = F.coalesce("style", F.lit("auto")) if "style" in sources.columns else F.lit("auto")

    def scan(source: str, style: str) -> Iterator[tuple]:
        macros = style != "tie" and (_MACRO.search(source) is not None or _LOADED.search(source) is not None)
        for m, right in measured(source):
            number, gap, unit = m["number"], m["gap"], m["unit"]
            if not right:
                yield m.start(), m.end(), m.group(), f"{number}~\\%", "FMT-UNIT-01", priority, "auto"
            elif gap not in ("~", "\\,") or right != unit:
                after = f"\\qty{{{number}}}{{{right}}}" if macros else f"{number}{gap if gap in ('~', chr(92) + ',') else '~'}{right}"
                check_id, tier = ("FMT-UNIT-02", "suggest") if right != unit else ("FMT-UNIT-01", "auto")
                yield m.start(), m.end(), m.group(), after, check_id, priority, tier

    rows = sources.select("file", "text", style.alias("style"))
    return scanned_pairs(rows, scan, "start int, end int, before string, after string, check_id string, priority int, tier string")
