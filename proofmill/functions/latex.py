"""What a LaTeX source holds, and its checks as a table of patterns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from proofmill.functions import texts as X


class Check(NamedTuple):
    check_id: str
    tier: str  # auto, suggest, or report
    pattern: str
    put: str


# Units, and the forms that the checks find and write.
UNITS = "MeV|GeV|keV|TeV|MHz|GHz|kHz|mm|cm|µm|pC|nC|mA|kV|MV|ms|ns|fs"
CHECKS = [
    Check("DOI-FMT-02", "auto", r"\\url\{\s*doi:\s*(10\.[^}]*)\}", r"\\doi{$1}"),
    Check("URL-AS-DOI-01", "suggest", r"\\url\{\s*https?://(?:dx\.)?doi\.org/(10\.[^}]*)\}", r"\\doi{$1}"),
    Check("DOI-FMT-01", "auto", r"\b(?:DOI|Doi|doi)\s*:\s+(10\.)", "doi:$1"),
    Check("FMT-UNIT-01", "auto", rf"([0-9]) ?({UNITS})\b", "$1~$2"),
    Check("FMT-UNIT-02", "suggest", r"([0-9][ ~]?)[mM]ev\b", "$1MeV"),
    Check("FMT-UNIT-02", "suggest", r"([0-9][ ~]?)[gG]hz\b", "$1GHz"),
    Check("CITE-BRACKET-01", "auto", r"\\cite\{([^}]*)\}\s*,?\s*\\cite\{", r"\\cite{$1,"),
    Check("CITE-SPACE-01", "auto", r"(\\cite\{[^}]*?)\s*,\s+", "$1,"),
    Check("CITE-SPACE-01", "auto", r"\\cite\{\s+", r"\\cite{"),
    Check("AUTH-02", "auto", r"\bet\.?\s+al\b\.?", "et al."),
    Check("FMT-TITLE-02", "auto", r"(\\title\{[^}]*[^}.;:,\s])[.;:,\s]+\}", "$1}"),
    Check("REF-PAGES-01", "auto", r"(pages\s*=\s*\{\s*[0-9]+)\s*(?:-|–)\s*([0-9]+\s*\})", "$1--$2"),
    Check("TXT-FIG-01", "suggest", r"([a-z,] )Figure[ ~]([0-9])", "$1Fig.~$2"),
    Check("TXT-TAB-01", "suggest", r"\bTab\.[ ~]?([0-9])", "Table~$1"),
    Check("TXT-EQ-01", "suggest", r"([a-z,] )[eE]quation[ ~]?\(([0-9]+)\)", "$1Eq.~($2)"),
    Check("TXT-CITE-01", "suggest", r"\[([0-9]+)\]\s*,?\s*\[([0-9]+)\]", "[$1, $2]"),
    Check("WORD-CAP-01", "suggest", r"(\\caption\{)Fig\.\s*([0-9]+)\.?", "$1Figure $2:"),
    Check("WORD-CAP-03", "suggest", r"(\\caption\{[^}.]*[^}.\s])\}", "$1.}"),
    Check("WORD-HEAD-01", "suggest", r"(\\section\{)[0-9.]+\s+", "$1"),
    Check("TXT-ABS-01", "report", r"(?s)\\begin\{abstract\}[^\\]*\\cite", "$0"),
    Check("FMT-AUTH-01", "report", r"\\author\{(?:[^}]*[ ,])?[A-Z][a-z]+ [A-Z]", "$0"),
    Check("JACOW-CLS-02", "report", r"\\bibliographystyle\{", "$0"),
    Check("REF-FORM-01", "report", r"(?i)\\bibitem[^\\]*\bproc\.[^\\]*\bunpublished\b", "$0"),
    Check("REF-FORM-02", "report", r"(?i)\\bibitem[^\\]*\bsubmitted to\b", "$0"),
]


def changes(c: Column, k: Check) -> Column:
    return c.rlike(k.pattern) if k.put == "$0" else F.regexp_replace(c, k.pattern, k.put) != c


def checked(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, check_id, tier) of each check that finds something in a source."""
    c, hits = X.text(F.col(text)), []
    for check_id in dict.fromkeys(k.check_id for k in CHECKS):
        own = [k for k in CHECKS if k.check_id == check_id]
        hit = changes(c, own[0])
        for k in own[1:]:
            hit = hit | changes(c, k)
        hits.append(F.when(hit, F.struct(F.lit(check_id).alias("check_id"), F.lit(own[0].tier).alias("tier"))))
    return sources.select(key, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "h.check_id", "h.tier")


def corrected(c: Column, *tiers: str) -> Column:
    """The source with the checks of these tiers applied in their order."""
    out = X.text(c)
    for k in CHECKS:
        if k.tier in tiers:
            out = F.regexp_replace(out, k.pattern, k.put)
    return out


def _names(c: Column, pattern: str) -> Column:
    groups = F.regexp_extract_all(X.text(c), F.lit(pattern), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda k: F.trim(k)), lambda k: k != "")


def citations(c: Column) -> Column:
    """Keys of all citations in order, repeated ones too."""
    return _names(c, r"\\cite[a-z]*\{([^}]*)\}")


def bibitems(c: Column) -> Column:
    """(key, body) of each entry of the list of references, in order."""
    parts = F.split(F.element_at(F.split(X.text(c), r"\\end\{thebibliography\}"), 1), r"\\bibitem")
    parts = F.slice(parts, 2, F.size(parts))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(?:\[[^\]]*\])?\{([^}]*)\}", 1).alias("key"), X.norm(F.regexp_replace(p, r"^(?:\[[^\]]*\])?\{[^}]*\}", "")).alias("body")))


def graphics(c: Column) -> Column:
    return _names(c, r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}")


def resources(c: Column) -> Column:
    """Declared .bib files."""
    return _names(c, r"\\(?:addbibresource|bibliography)\{([^}]*)\}")


def class_version(c: Column) -> Column:
    """The template's version, where the first fifteen lines name one."""
    head = F.array_join(F.slice(F.split(X.text(c), "\n"), 1, 15), "\n")
    return F.nullif(F.regexp_extract(head, r"(?i)jacow[^\n]*?v?([0-9]+\.[0-9]+)", 1), F.lit(""))


def class_options(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_extract(X.text(c), r"\\documentclass\[([^\]]*)\]", 1), ","), lambda o: F.trim(o)), lambda o: o != "")
