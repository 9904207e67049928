"""References: kinds by their marks, and layouts as lists of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofmill.functions import texts as X

# Postal codes of states as they occur before USA.
STATES = {"AZ": "Arizona", "CA": "California", "CO": "Colorado", "FL": "Florida", "IL": "Illinois", "MA": "Massachusetts", "MD": "Maryland", "MI": "Michigan", "NM": "New Mexico", "NY": "New York", "OR": "Oregon", "PA": "Pennsylvania", "TN": "Tennessee", "TX": "Texas", "VA": "Virginia", "WA": "Washington", "WI": "Wisconsin"}
# Cyrillic letters and the Latin ones they look like.
LOOKALIKE = ("аеорсхуАВЕНКМОРСТХУ", "aeopcxyABEHKMOPCTXY")

# Kinds by the first mark that is found.
KINDS = [
    ("private_comm", r"(?i)\bprivate communication\b"),
    ("conference_current", r"(?i)\bthis conference\b"),
    ("conference_unpublished", r"(?i)\bpresented at\b"),
    ("conference_published", r"\bProc(eedings\b|\.)"),
    ("thesis", r"(?i)\bthesis\b"),
    ("journal_accepted", r"(?i)\bto be published\b|\baccepted\b"),
    ("journal_submitted", r"(?i)\bsubmitted\b"),
    ("unpublished", r"(?i)\bunpublished\b"),
    ("report", r"\b(Rep\.|Report|Tech\.\s+Note|Preprint)"),
    ("journal", r"\bvol\.|\bPhys\.\s+Rev\b|\bNucl\.\s+Instrum\b|\bJ\.\s+[A-Z][a-z]+\.|\bJournal\b|\b[0-9]+\([0-9]+\):"),
    ("arxiv", r"\barXiv:|10\.48550/arXiv"),
    ("web", r"^[^“\"]*https?://\S+\s*$"),
]
NOT_WITH_VOLUME = ("journal_submitted", "report")


def kind(c: Column) -> Column:
    out = None
    for name, mark in KINDS:
        hit = X.text(c).rlike(mark)
        if name in NOT_WITH_VOLUME:
            hit = hit & ~X.text(c).rlike(r"\bvol\.")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


# Fields a layout needs, and its pieces in order: commas between, and what comes after the full stop (link: the DOI, else the address).
LAYOUTS = {
    "conference": ("authors title conference city country month year pages", "authors quoted in_proc place date paper_unless_doi pages", "doi"),
    "conference_unpublished": ("authors title conference city country month year", "authors quoted presented place date paper =unpublished", ""),
    "conference_current": ("authors title conference city country month year paper_id", "authors quoted presented place date paper =this_conference", ""),
    "journal": ("authors title journal volume pages year", "authors quoted journal vol no pages date", "doi"),
    "accepted": ("authors title journal", "authors quoted journal =to_be_published", ""),
    "submitted": ("authors title", "authors quoted =submitted_for_publication", ""),
    "arxiv": ("authors title month year doi", "authors quoted date", "doi"),
    "online": ("title url", "authors named url", "none"),
    "book_chapter": ("authors title book publisher city country year pages", "authors quoted in_book editors. publisher date pages", "link"),
    "book": ("authors book publisher city country year", "authors book edition editors. publisher date", "link"),
    "report": ("authors title institution city country report year", "authors quoted institution place rep date", "link"),
    "technical_report": ("title institution city country report year", "title edition editors institution place rep date", "link"),
    "thesis": ("authors title thesis institution city country year", "authors quoted thesis department institution place date", "link"),
    "handbook": ("title organization country year", "title edition organization place date pages url", "bare"),
    "manual": ("title organization city country year", "title organization place date", "link"),
    "patent": ("authors title patent year", "authors quoted patent day_or_pending", ""),
    "unpublished": ("authors title", "authors quoted =unpublished", ""),
    "private": ("authors year", "authors =private_communication date", ""),
}


def missing(category: Column, fields: Column) -> Column:
    """The needed fields of ``category`` that the map ``fields`` lacks, in the layout's order; some stand in for others."""
    needed = F.create_map(*[F.lit(x) if isinstance(x, str) else x for name, (need, _, _) in LAYOUTS.items() for x in (name, F.array(*map(F.lit, need.split())))])[category]
    has = lambda f: F.coalesce(fields[f], F.lit("")) != ""
    stands_in = lambda f: (
        ((f == "conference") & has("proceedings"))
        | ((f == "title") & (category == "online") & has("organization"))
        | ((f == "book") & (category == "book") & has("title"))
        | (f.isin("patent", "year") & (category == "patent") & (F.coalesce(fields["status"], F.lit("")) == "pending"))
    )
    return F.filter(needed, lambda f: (F.coalesce(F.element_at(fields, f), F.lit("")) == "") & ~stands_in(f))


def _piece(name: str, f: dict[str, Column]) -> Column:
    if name.startswith("="):
        return F.lit(name[1:].replace("_", " "))
    with_ = lambda head, c, tail="": F.when(c != "", F.concat(F.lit(head), c, F.lit(tail))).otherwise("")
    of = {
        "quoted": lambda: with_("“", f["title"], "”"),
        "in_proc": lambda: with_("in Proc. ", f["conference"]),
        "presented": lambda: with_("presented at ", f["conference"]),
        "in_book": lambda: with_("in ", f["book"]),
        "place": lambda: joined(f["city"], f["state"], f["country"]),
        "date": lambda: F.when(f["year"] == "", "").when(f["month"] != "", F.concat(f["month"], F.lit(" "), f["year"])).otherwise(f["year"]),
        "paper": lambda: with_("paper ", f["paper_id"]),
        "paper_unless_doi": lambda: F.when(f["doi"] == "", with_("paper ", f["paper_id"])).otherwise(""),
        "pages": lambda: F.when(f["pages"] == "", "").when(f["pages"].rlike("[-,]"), F.concat(F.lit("pp. "), f["pages"])).otherwise(F.concat(F.lit("p. "), f["pages"])),
        "editors": lambda: F.when(f["editors"] == "", "").otherwise(F.concat(f["editors"], F.when(f["editors"].contains(" and "), ", Eds.").otherwise(", Ed."))),
        "named": lambda: F.when(f["title"] != "", f["title"]).otherwise(f["organization"]),
        "day_or_pending": lambda: F.when(f["status"] == "pending", "patent pending").otherwise(F.when(f["year"] == "", "").when(f["month"] != "", F.concat(f["month"], F.lit(" "), f["year"])).otherwise(f["year"])),
        "vol": lambda: with_("vol. ", f["volume"]),
        "no": lambda: with_("no. ", f["issue"]),
        "rep": lambda: with_("Rep. ", f["report"]),
        "thesis": lambda: with_("", f["thesis"], " thesis"),
        "publisher": lambda: F.when((joined(f["city"], f["state"], f["country"]) != "") & (f["publisher"] != ""), F.concat(joined(f["city"], f["state"], f["country"]), F.lit(": "), f["publisher"])).otherwise(F.concat(f["publisher"], joined(f["city"], f["state"], f["country"]))),
    }.get(name)
    return of() if of else f[name]


def joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ", ")


FIELDS = "authors title conference city state country month year pages paper_id journal volume issue doi url book publisher institution report thesis organization patent editors edition department status".split()


def render(category: Column, fields: Column) -> Column:
    """The reference in its category's layout; pieces without a field are left out."""
    f = {name: F.coalesce(fields[name], F.lit("")) for name in FIELDS}
    link = F.when(f["doi"] != "", F.concat(F.lit(" doi:"), f["doi"])).otherwise(F.when(f["url"] != "", F.concat(F.lit(" "), f["url"])).otherwise(""))
    after = {"": F.lit("."), "none": F.lit(""), "bare": F.when(f["url"] != "", "").otherwise("."), "doi": F.concat(F.lit("."), F.when(f["doi"] != "", F.concat(F.lit(" doi:"), f["doi"])).otherwise("")), "link": F.concat(F.lit("."), link)}
    out = None
    for name, (_, pieces, end) in LAYOUTS.items():
        head, _, tail = pieces.rpartition(". ")
        body = joined(*[_piece(p, f) for p in tail.split()])
        if head:
            body = F.array_join(F.filter(F.array(joined(*[_piece(p, f) for p in head.split()]), body), lambda p: p != ""), ". ")
        text = F.regexp_replace(F.concat(body, after[end]), r"\.\.($|\s)", ".$1")
        out = F.when(category == name, text) if out is None else out.when(category == name, text)
    return out
