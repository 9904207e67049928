"""Dimensions of the review desk: zones and tags of checks, severities, priorities of edits."""

from __future__ import annotations

FRONT, REFERENCES, FLOATS, BODY, DOCUMENT = "front matter", "references", "figures and tables", "running text", "whole document"

# The zone of each check; any other check is of the running text.
ZONE_OF_CHECK = {
    FRONT: "FMT-TITLE-02 FMT-AUTH-01 TITLE-01 TXT-ABS-01 WORD-TITLE-01 WORD-TITLE-03 WORD-AUTH-02",
    REFERENCES: "FMT-REF-01 FMT-REF-02 FMT-REF-03 REF-INT-01 REF-INT-02 REF-INT-03 FMT-TITLE-03 AUTH-01 AUTH-02 REF-PAGES-01 REF-NUM-01 REF-NUM-02 REF-SEC-01 CITE-BRACKET-01 CITE-SPACE-01 CITE-ORDER-01 CITE-TEXT-02 CITE-LINK-01 DOI-FMT-01 DOI-FMT-02 DOI-FMT-03 DOI-REQ-01 DOI-MISSING-01 URL-AS-DOI-01 PROC-REQ-01 PROC-REQ-02 PROC-REQ-03 BIB-EDIT-01 BIB-MISSING-01 BIB-PARSE-01 WORD-LINK-01 WORD-LINK-02 WORD-REFSPACE-01 REF-FORM-01 REF-FORM-02 PDF-DOI-01",
    FLOATS: "FIG-MISSING-01 FIG-ARCHIVE-01 WORD-CAP-01 WORD-CAP-02 WORD-CAP-03",
    BODY: "FMT-UNIT-01 FMT-UNIT-02 WORD-HEAD-01 WORD-HEAD-02 WORD-HEAD-03 WORD-HEAD-04 WORD-HEAD-05 WORD-PARA-01 WORD-PARA-02 WORD-PARA-03 WORD-PARA-04 WORD-STYLE-01 TXT-ACR-01",
    DOCUMENT: "JACOW-CLS-01 JACOW-CLS-02 JACOW-CLS-03 BUILD-FAIL BUILD-OK BUILD-SKIP PAGE-LIMIT-01 PDF-00 PDF-SIZE-01 PDF-MARGIN-01 PDF-PAGENUM-01 PDF-FONT-01 PDF-FONT-02 PDF-LINK-01 WORD-LAYOUT-01 WORD-FONT-01 WORD-FONT-02 WORD-FONT-03 WORD-PAGENUM-01 WORD-FOOTNOTE-01 WORD-AUDIT-01",
}

# What marks the zone of a piece of source, tried in this order; text without a mark is running text.
ZONE_MARKS = [
    (DOCUMENT, r"\\(documentclass|usepackage|newcommand|input|def)\b"),
    (FRONT, r"(?i)\\(title|author|affiliation|thanks|email|orcid|maketitle|inst)\b|\\textsuperscript\{[0-9]"),
    (REFERENCES, r"(?i)\\(bibitem|cite|doi|bibliography|url)\b|\bdoi\s*:|\bin\s+Proc\.|\bpp?\.\s*[0-9]|\bvol\.|\bet\s+al\b|arXiv"),
    (FLOATS, r"(?i)\\(caption|includegraphics|begin\{(figure|table|tabular)|end\{(figure|table|tabular)|hline|toprule|midrule|multicolumn)\b|^\s*(Figure|Fig\.|Table)\s+[0-9]"),
]

# Tag codes in the order of the vocabulary.
TAG_CODES = "FC00 FC01 FC02 FC03 FC04 FC05 FC06 FC10 FP00 FP01 FP02 MP00 MP01 MP02 MP03 MP04 TC00 TC01 TC02 TC03 TC04 TC05 TC06 TC07 TC08 TC09 TC10 TC11 TC12 TC14 UT00 UT01 UT02 QA01 QA02 QA03 PRC".split()
SERVICE_TAGS = "QA01 QA02 QA03 PRC".split()

# The checks whose evidence is a tag.
CHECKS_OF_TAG = {
    "TC12": "FMT-UNIT-01 FMT-UNIT-02",
    "TC01": "FMT-TITLE-02 FMT-AUTH-01",
    "TC06": "FMT-REF-01 FMT-TITLE-03 TITLE-01 AUTH-01 AUTH-02 REF-PAGES-01 REF-NUM-01 REF-SEC-01 REF-NUM-02 CITE-BRACKET-01 CITE-SPACE-01 JACOW-CLS-03",
    "TC07": "CITE-ORDER-01 CITE-TEXT-02",
    "TC08": "CITE-LINK-01",
    "TC14": "DOI-FMT-01 DOI-FMT-02 DOI-FMT-03 DOI-REQ-01 URL-AS-DOI-01 PROC-REQ-01 PROC-REQ-02 PROC-REQ-03 JACOW-CLS-02",
    "FC03": "BIB-EDIT-01 BIB-PARSE-01",
    "FC01": "BIB-MISSING-01 FIG-MISSING-01",
    "FC04": "FIG-ARCHIVE-01",
    "FC06": "BUILD-FAIL",
    "MP03": "PAGE-LIMIT-01",
    "UT01": "JACOW-CLS-01",
}
# Tags that checks reach in part or not at all, by why.
GAPS_OF_TAG = {
    "partly covered": "TC07 TC08",
    "needs the PDF": "FC02 FC05 FC10 FP00 FP01 FP02 TC02 TC03 TC04 TC05 TC10 TC11 UT02",
    "out of scope": "MP02 TC09",
    "editor's judgement": "FC00 MP00 MP01 MP04 TC00 UT00",
}
STATUS_WEIGHT = {"buildable": 0, "partly covered": 1, "covered": 2, "needs the PDF": 3, "out of scope": 4, "editor's judgement": 5, "the editing service": 6}

SEVERITIES = ["error", "warning", "info"]

# Which edit wins an overlap; the smaller number does.
EDIT_PRIORITY = {"DOI-FMT-02": 10, "DOI-FMT-01": 20, "URL-AS-DOI-01": 30, "FMT-UNIT-01": 40, "FMT-UNIT-02": 40, "CITE-BRACKET-01": 50, "CITE-SPACE-01": 60, "AUTH-02": 70, "FMT-REF-01": 90}
OTHER_PRIORITY = 80

# File endings of sources.
KIND_OF_ENDING = {".tex": "latex", ".docx": "word", ".doc": "word", ".odt": "word", ".rtf": "word"}


def pairs(groups: dict[str, str]) -> list[tuple[str, str]]:
    """(word, group) of each word of ``groups``."""
    return [(w, g) for g, words in groups.items() for w in words.split()]


def values(rows: list[tuple]) -> str:
    """``rows`` as a SQL VALUES list."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"
