"""Whole references read into fields, with spans in code points.

A reference is cut into pieces once: quoted, bracketed and linked stretches and
days of months are masked, so that only commas, the stop before a publisher's
place or a link, and the colon before a publisher cut.  From there it is rows:
a piece gets a mark from an ordered table of patterns, a reference its kind from
the marks it has, and what no pattern knows is assigned by its order among such
pieces and by where the place is.  All of that runs in windows of one reference,
after one shuffle by reference.

Defined results: a null or empty text has no pieces and no rows.  References of
the same key are read as one, so keys are to be unique.  Pieces that no field
takes have the field ``rest``; a kind that can't be told is an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofmill.functions import references as R
from proofmill.operators.edits import scanned

# Countries as layouts write them.
COUNTRIES = (
    "Argentina|Armenia|Australia|Austria|Belgium|Brazil|Bulgaria|Canada|Chile|China|Croatia|Cyprus|Czech Republic|Denmark|Egypt|Estonia|Finland|France|Georgia|Germany|Greece|Hungary|Iceland|India|Indonesia|Iran|Ireland|Israel|Italy|Japan|Jordan|"
    "Korea|South Korea|Latvia|Lithuania|Malaysia|Mexico|Netherlands|The Netherlands|New Zealand|Norway|Pakistan|Poland|Portugal|Romania|Russia|Serbia|Singapore|Slovakia|Slovenia|South Africa|Spain|Sweden|Switzerland|Taiwan|Thailand|Turkey|UK|Ukraine|USA|Vietnam"
)
# Months as layouts write them.
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.?"
#: A person: initials, then a name of one or more parts.
PERSON = r"(?:\p{Lu}\.[ -]?)+ ?(?:(?:van|von|der|den|de|di|da|la|le) )*\p{L}[\p{L}’'-]*(?: \p{Lu}[\p{L}’'-]+)?"


class Mark(NamedTuple):
    name: str
    pattern: str  # group 1 is the value
    at: int  # where the value begins; -1: it ends with the piece


MARKS = [
    Mark("title", r"^[“\"](.*?)[,.]?[”\"]$", 1),
    Mark("doi", r"^doi:\s?(10\.\S+)$", -1),
    Mark("url", r"^(https?://\S+)$", 0),
    Mark("conference", r"^in Proc\. (.+)$", -1),
    Mark("presented", r"^presented at (.+)$", -1),
    Mark("status", r"^(unpublished|this conference|to be published|submitted for publication|private communication|patent pending)$", 0),
    Mark("book", r"^in (.+)$", -1),
    Mark("pages", r"^pp?\.\s?(.+)$", -1),
    Mark("volume", r"^vol\.\s?(.+)$", -1),
    Mark("issue", r"^no\.\s?(.+)$", -1),
    Mark("paper_id", r"^paper (\S+)$", -1),
    Mark("report", r"^Rep\. (.+)$", -1),
    Mark("date", rf"^(?:({MONTH}.*?) )?(?:19|20)[0-9]{{2}}$", 0),
    Mark("thesis", r"^(.+) thesis$", 0),
    Mark("patent", r"^(.*\bPatent\b.*)$", 0),
    Mark("edition", r"^([0-9]+(?:st|nd|rd|th) ed\.?)$", 0),
    Mark("edited", r"^(Eds?\.?)$", 0),
    Mark("country", rf"^({COUNTRIES})$", 0),
    Mark("state", r"^([A-Z]{2})$", 0),
    Mark("department", r"^(.*\bDept\b.*)$", 0),
    Mark("person", rf"^((?:and )?(?:{PERSON}(?:,? and {PERSON})?(?: et al\.?)?|et al\.?))$", 0),
]
#: What the pieces without a mark are, in their order, by kind.
ORDERED = {
    "journal": ("journal",), "accepted": ("journal",), "report": ("institution",), "thesis": ("institution",), "book": ("book",), "online": ("title",),
    "technical_report": ("title", "institution"), "handbook": ("title", "organization"), "manual": ("title", "organization"),
}
PENDING = "patent pending"

_CUT = re.compile(
    r"(?P<quote>“[^“”]*”|\"[^\"]*\")|(?P<mask>\([^()]*\)|\[[^\[\]]*\]|https?://\S*[^\s.,;]|\b(?i:doi)\b[:\s]*/{0,2}\s?10\.\S*[^\s.,;]|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? [0-9]{1,2}, (?=[0-9]{4}\b))"
    r"|(?P<cut>[,;]\s+|[,;]$|\.\s*$|(?<=[\w)]{2})\.\s+(?=(?:(?!\.\s)[^:“”])*:\s)|[.:]?\s+(?=(?i:doi)\b[:\s]|https?://))|(?P<colon>:\s+)"
)
_PLACE = re.compile(rf"(?:{COUNTRIES}|[A-Z]{{2}})\Z")


def _pieces_of(text: str) -> Iterator[tuple]:
    """(k, lead, gap, start, end, piece, tail): the sign before a piece, all that lies between it and the last one, and after the last of them what is left."""
    found: list[tuple[str, int, int]] = []
    lead, begin, last = "", 0, 0

    def close(end: int, sign: str, after: int) -> None:
        nonlocal lead, begin
        own = text[begin:end]
        if own.strip():
            start = begin + len(own) - len(own.lstrip())
            found.append((lead, start, start + len(own.strip())))
            lead = sign
        else:
            lead = sign or lead
        begin = after

    for m in _CUT.finditer(text):
        if m["quote"]:
            close(m.start(), "", m.start())
            close(m.end(), "", m.end())
        elif m["cut"]:
            # The stop of an edition is its own, though a sentence ends there.
            own = m["cut"][0] == "." and text.endswith(" ed", begin, m.start())
            close(m.start() + own, m["cut"].strip(" :")[:1], m.end())
        elif m["colon"] and (lead == "." or _PLACE.match(text[begin : m.start()].strip())):
            close(m.start(), ":", m.end())
    close(len(text), "", len(text))
    for k, (sign, start, end) in enumerate(found):
        yield k, sign, text[last:start], start, end, text[start:end], text[end:] if k == len(found) - 1 else None
        last = end


def pieces(refs: DataFrame, ref: str = "ref", text: str = "text") -> DataFrame:
    """(ref, k, lead, gap, start, end, piece) of every piece of every reference."""
    made = scanned(refs.select(F.col(ref).alias("file"), F.col(text).alias("text")), _pieces_of, "k int, lead string, gap string, start int, end int, piece string, tail string")
    return made.withColumnRenamed("file", "ref")


def marked(cut: DataFrame) -> DataFrame:
    """Pieces with ``mark`` (rest: none), and the value and its span that the mark gives them."""
    mark, value, at = None, None, None
    for m in MARKS:
        hit = F.col("piece").rlike(m.pattern)
        own = F.regexp_extract("piece", m.pattern, 1)
        begin = F.col("end") - F.length(own) if m.at < 0 else F.col("start") + m.at
        mark, value, at = (F.when(hit, x) if old is None else old.when(hit, x) for old, x in ((mark, F.lit(m.name)), (value, own), (at, begin)))
    cut = cut.withColumns({"mark": mark.otherwise("rest"), "value": value.otherwise(F.col("piece")), "at": at.otherwise(F.col("start"))})
    return cut.withColumn("mark", F.when(F.col("lead") == ":", "publisher").otherwise(F.col("mark"))).withColumn("value", F.when(F.col("mark") == "publisher", F.col("piece")).otherwise(F.col("value"))).withColumn("at", F.when(F.col("mark") == "publisher", F.col("start")).otherwise(F.col("at")))


def _kind(has: dict[str, Column], said: Column) -> Column:
    """The kind by the marks of a reference: what the statuses say first, then what only one layout has, then the shape."""
    status = lambda s: F.array_contains(said, s)
    book = has["publisher"]
    ladder = [
        ("private", status("private communication")), ("conference_current", status("this conference")), ("conference_unpublished", has["presented"]),
        ("patent", has["patent"] | status(PENDING)), ("thesis", has["thesis"]), ("submitted", status("submitted for publication")), ("accepted", status("to be published")),
        ("conference_unpublished", has["conference"] & status("unpublished")), ("conference", has["conference"]), ("journal", has["volume"] | has["issue"]), ("arxiv", has["preprint"]),
        ("book_chapter", has["title"] & has["book"]), ("report", has["report"] & has["title"]), ("technical_report", has["report"]), ("book", book | (has["edition"] & has["person"])),
        ("unpublished", status("unpublished")), ("online", has["url"] & ~has["date"]), ("journal", has["title"] & has["rest"]),
        ("handbook", ~has["title"] & (has["named_handbook"] | has["pages"] | has["edition"] | has["linked_by_comma"])), ("manual", ~has["title"] & has["date"] & has["rest"]),
    ]
    out = None
    for name, holds in ladder:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise("")


def parsed(refs: DataFrame, ref: str = "ref", text: str = "text") -> DataFrame:
    """(ref, category, field, value, start, end) of every field that was read, and of what was left, as ``rest``."""
    of = W.partitionBy("ref")
    in_order = of.orderBy("k")
    p = marked(pieces(refs, ref, text))
    first = lambda c: F.min(F.when(c, F.col("k"))).over(of)
    p = p.withColumns({"title_k": first(F.col("mark") == "title"), "other_k": first(F.col("mark") != "person"), "edited_k": first(F.col("mark") == "edited"), "size": F.count(F.lit(1)).over(of)})
    # Authors are all before a quoted title, else the persons that a reference begins with.
    author = F.when(F.col("title_k").isNotNull(), F.col("k") < F.col("title_k")).otherwise(F.col("k") < F.coalesce("other_k", "size"))
    p = p.withColumn("author", author).withColumn("before_editors", F.max(F.when((F.col("k") < F.col("edited_k")) & ((F.col("mark") != "person") | F.col("author")), F.col("k"))).over(of))
    editor = F.coalesce((F.col("mark") == "person") & ~F.col("author") & (F.col("k") < F.col("edited_k")) & (F.col("k") > F.coalesce("before_editors", F.lit(-1))), F.lit(False))
    # A person that is neither is something with initials; so is a mark in the authors' part.
    p = p.withColumn("mark", F.when(F.col("author"), "authors").when(editor, "editors").when(F.col("mark") == "person", "rest").otherwise(F.col("mark")))
    any_ = lambda c: F.coalesce(F.max(c).over(of), F.lit(False))
    has = {m: any_(F.col("mark") == m) for m in ("presented", "patent", "thesis", "conference", "volume", "issue", "title", "book", "publisher", "report", "edition", "url", "date", "pages", "rest")}
    has |= {"person": any_(F.col("mark") == "authors"), "preprint": any_((F.col("mark") == "doi") & F.col("value").rlike("(?i)^10\\.48550/arxiv")), "named_handbook": any_(F.col("piece").rlike("(?i)handbook")), "linked_by_comma": any_((F.col("mark") == "url") & (F.col("lead") == ","))}
    said = F.collect_set(F.when(F.col("mark") == "status", F.col("value"))).over(of)
    p = p.withColumn("category", _kind(has, said)).withColumns({"country_k": first((F.col("mark") == "country") & ~F.col("author")), "rests": F.count_if(F.col("mark") == "rest").over(of)})
    p = p.withColumn("state_k", first((F.col("mark") == "state") & (F.col("k") == F.col("country_k") - 1)))
    # The piece before the place's state or country is the city, once the fields that the kind needs have their pieces.
    needs = F.create_map(*[F.lit(x) for kind, names in ORDERED.items() for x in (kind, len(names))])
    city = (F.col("mark") == "rest") & (F.col("k") == F.coalesce("state_k", "country_k") - 1) & (F.col("rests") > F.coalesce(needs[F.col("category")], F.lit(0)))
    stray = (F.col("mark") == "state") & ~F.coalesce(F.col("k") == F.col("state_k"), F.lit(False))
    p = p.withColumn("mark", F.when(F.coalesce(city, F.lit(False)), "city").when(stray, "rest").otherwise(F.col("mark")))
    nth = F.sum((F.col("mark") == "rest").cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    names = F.create_map(*[x for kind, fields in ORDERED.items() for x in (F.lit(kind), F.array(*map(F.lit, fields)))])
    rest = F.coalesce(F.get(names[F.col("category")], nth - 1), F.lit("rest"))
    p = p.withColumn("field", F.when(F.col("mark") == "rest", rest).when(F.col("mark") == "presented", "conference").otherwise(F.col("mark")))
    # A person's or a left piece is whole, whatever pattern it met.
    whole = F.col("mark").isin("authors", "editors", "rest", "city")
    field = lambda name, value, start: F.struct(name.alias("field"), value.alias("value"), start.alias("start"))
    year = F.right("piece", F.lit(4))
    made = F.when(F.col("mark") == "date", F.array_compact(F.array(F.when(F.col("value") != "", field(F.lit("month"), F.col("value"), F.col("start"))), field(F.lit("year"), year, F.col("end") - 4))))
    made = made.when(F.col("mark") == "edited", F.array().cast("array<struct<field:string,value:string,start:int>>"))
    made = made.when(F.col("mark") == "status", F.when(F.col("value") == PENDING, F.array(field(F.lit("status"), F.lit("pending"), F.col("end") - 7))).otherwise(F.array().cast("array<struct<field:string,value:string,start:int>>")))
    made = made.otherwise(F.array(field(F.col("field"), F.when(whole, F.col("piece")).otherwise(F.col("value")), F.when(whole, F.col("start")).otherwise(F.col("at")))))
    rows = p.select("ref", "category", "gap", F.explode(made).alias("f")).select("ref", "category", "gap", "f.*")
    # Several pieces of one field, as of authors, are joined by what lies between them.
    held = rows.groupBy("ref", "category", "field").agg(F.array_sort(F.collect_list(F.struct("start", "gap", "value"))).alias("of"))
    value = F.array_join(F.transform("of", lambda x, i: F.when(i == 0, x["value"]).otherwise(F.concat(x["gap"], x["value"]))), "")
    tail = F.element_at("of", -1)
    return held.select("ref", "category", "field", value.alias("value"), F.get("of", F.lit(0))["start"].alias("start"), (tail["start"] + F.length(tail["value"])).alias("end"))


def rendered(fields: DataFrame) -> DataFrame:
    """(ref, category, text): references written anew from the fields of ``parsed``."""
    maps = fields.filter("field <> 'rest'").groupBy("ref", "category").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    return maps.filter("category <> ''").select("ref", "category", R.render(F.col("category"), F.col("fields")).alias("text"))
