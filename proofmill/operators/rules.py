"""Reference rules as issues with spans and replacements, solved to a fixed point.

A rule reads a piece of a reference loosely and writes it as the layouts do; where
the two differ, that is an issue: a code, a span in code points, what stands there
and what is to be put, or nothing where a rule only reports.  Some rules read a
piece with its neighbour, some the space between pieces, some the whole reference.

``solved`` applies issues in rounds.  Of issues that overlap or touch the rule that
comes first in the table wins; the others are found again in the next round, on
the new text.  A replacement that would lose or invent a number is refused unless
its rule declares that it may.  A round is a job over the references that the
last one changed, and its result is written to the shared folder; rounds end when
no reference changes, or after ``ROUNDS``.

Defined results: null and empty texts have no issues and stay as they are.  Keys
of references are to be unique.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofmill.functions import references as R, texts as X
from proofmill.operators import edits, parsing
from proofmill.session import stash

ROUNDS = 8
# Short forms of months, by their first letters.
MONTHS = {"jan": "Jan.", "feb": "Feb.", "mar": "Mar.", "apr": "Apr.", "may": "May", "jun": "Jun.", "jul": "Jul.", "aug": "Aug.", "sep": "Sep.", "oct": "Oct.", "nov": "Nov.", "dec": "Dec."}
# Series of conferences.
SERIES = "ATEE|BIW|COOL|CYCLOTRONS|Cyclotrons|DIPAC|ECRIS|EPAC|ERL|FEL|FLS|HB|HIAT|IBIC|ICALEPCS|ICAP|IPAC|LINAC|MEDSI|NAPAC|PAC|PCaPAC|RuPAC|SRF"
SURNAME = r"(?:(?:van|von|der|den|de|di|da|la|le) )*\p{Lu}[\p{L}’'-]+"
ISSUE = "struct<rank:int,code:string,severity:string,start:int,end:int,excerpt:string,put:string,frees:boolean>"


class Rule(NamedTuple):
    code: str
    severity: str
    where: Column
    put: Column | None  # None: a report
    start: Column | None = None  # else the piece
    end: Column | None = None
    frees: bool = False  # numbers may go or come


def _form(code: str, severity: str, pattern: str, put: str, where: Column | None = None, frees: bool = False) -> Rule:
    """A whole piece read by ``pattern`` and written as ``put``, groups as $1."""
    piece = F.col("piece")
    hit = piece.rlike(f"^(?:{pattern})$")
    return Rule(code, severity, hit if where is None else where & hit, F.regexp_replace(piece, f"^(?:{pattern})$", put), frees=frees)


def _part(code: str, severity: str, pattern: str, put: str, where: Column | None = None, frees: bool = False) -> Rule:
    """Every place of ``pattern`` in a piece."""
    piece = F.col("piece")
    hit = piece.rlike(pattern)
    return Rule(code, severity, hit if where is None else where & hit, F.regexp_replace(piece, pattern, put), frees=frees)


def rules() -> list[Rule]:
    """In order of priority.  Columns: piece, mark, author, k, lead, gap, tail, next, next_mark, next_start, next_end, prior, prior_end, and counts over the reference."""
    piece, nxt, mark, author = F.col("piece"), F.col("next"), F.col("mark"), F.col("author")
    quoted, loose = piece.rlike("^[“\"]"), ~piece.rlike("^[“\"]|^https?://")
    body = loose & ~author
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    word = F.regexp_extract(piece, r"^\(?(\p{L}+)", 1)
    short = month[F.lower(F.substring(word, 1, 3))]
    a_month = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)\.?"
    both = {"start": F.col("start"), "end": F.col("next_end")}
    one_person = rf"(?:\p{{Lu}}\.[ -]?)+ ?{SURNAME}"
    latin, cyrillic = F.length(F.regexp_replace(piece, r"[^A-Za-z]", "")), F.length(F.regexp_replace(piece, "[^Ѐ-ӿ]", ""))
    capitals, letters = F.length(F.regexp_replace(piece, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(piece, r"[^\p{L}]", ""))
    is_doi, is_link = F.coalesce(piece.rlike(r"^doi:10\."), F.lit(False)), piece.rlike(r"^(?:(?i:doi)\b|10\.[0-9]{4,9}/|https?://(?:dx\.)?doi\.org/)")
    inner = F.regexp_extract(piece, "^[“\"](.*)[”\"]$", 1)
    tail = F.when(is_doi | (mark == "url"), "").when(piece.rlike(r"[.?!]$"), "").otherwise(".")
    gap = (
        F.when(F.col("k") == 0, "").when(is_link, ". ").when(mark == "publisher", ": ").when(F.col("lead") == ".", ". ").when((mark == "url") & (F.col("lead") == "") & ~F.col("prior").rlike("^[“\"]"), ". ").otherwise(", ")
    )
    year = F.regexp_extract("piece", r"’([0-9]{2})$", 1)
    return [
        # Letters.
        Rule("REF-LOOKALIKE", "error", (cyrillic > 0) & (F.col("latin") >= 3 * F.col("cyrillic")) & (F.translate(piece, *R.LOOKALIKE) != piece), F.translate(piece, *R.LOOKALIKE)),
        _part("REF-PUNCT", "info", r"\s{2,}|[\t\n ]", " "),
        # Identifiers.
        _form("REF-DOI-FORM", "error", r"(?i:doi)[:\s]*/{0,2}\s*1[0Oo]\.([0-9]{4,9}/\S+)", "doi:10.$1", frees=True),
        _form("REF-DOI-FORM", "error", r"(10\.[0-9]{4,9}/\S+)", "doi:$1", loose),
        _form("REF-DOI-URL", "error", r"(?:(?i:doi):\s*)?https?://(?:dx\.|www\.)?doi\.org/(10\.[0-9]{4,9}/\S+)", "doi:$1"),
        _form("REF-URL-DOI", "warning", r"https?://\S*?/(?:doi|abs|full|pdf)/(10\.[0-9]{4,9}/[^\s?#]+)(?:[?#]\S*)?", "doi:$1", frees=True),
        _form("REF-ARXIV-URL", "error", r"https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:\.pdf)?", "arXiv:$1", frees=True),
        _form("REF-ARXIV-DOI", "error", r"arXiv:\s?([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?: \[[^\]]*\])?", "doi:10.48550/arXiv.$1", (F.col("volumes") == 0) & (F.col("dois") == 0) & (F.col("quotes") > 0), True),
        _form("REF-ARXIV-PREPRINT", "warning", r"(?i)(?:arxiv\s+(?:e-)?preprint|preprint)[\s,]*arXiv:\s?(\S+)", "arXiv:$1"),
        Rule("REF-DOI-TWICE", "warning", is_doi & (F.lower("prior_doi") == F.lower(piece)), F.lit(""), F.col("prior_end"), F.col("end"), True),
        Rule("REF-DOI-LAST", "error", is_doi & nxt.isNotNull() & ~F.coalesce(nxt.rlike("^doi:"), F.lit(False)), F.concat(F.when(F.col("k") > 0, F.col("next_gap")).otherwise(""), nxt, F.lit(". "), piece), F.col("prior_end"), F.col("next_end")),
        _part("REF-URL-ONLINE", "warning", r"(?i)\s*\[\s*online\s*\]\.?(?:\s*available\s*(?:at|from)?:?)?$", "", loose),
        Rule("REF-URL-DOI", "warning", (mark == "url") & (F.col("doi") != "") & F.contains(F.lower(piece), F.lower(F.substring("doi", 5, 999))), F.lit(""), F.col("prior_end"), F.col("end"), True),
        _form("REF-PAPER-ID", "warning", r"(?i:paper\s+(?:id|no\.?|number)|id|paper)[:\s]+([A-Z]{2,4})[\s-]?([0-9A-Z]{2,5})", "paper $1$2", body),
        # Authors.
        _part("REF-ETAL", "error", r"\b[Ee]t\.?\s*[Aa]l\b\.?(?!\.)", "et al.", loose & ~piece.rlike(r"(?<![\p{L}.])et al\.(?!\.)")),
        Rule("REF-ETAL-COMMA", "error", (F.col("k") == 0) & piece.rlike(f"^{one_person}$") & F.coalesce(nxt.rlike(r"^et al\.?$"), F.lit(False)), F.concat(piece, F.lit(" et al.")), **both),
        Rule("REF-AUTH-ORDER", "error", author & piece.rlike(f"^{SURNAME}$") & F.coalesce(nxt.rlike(r"^(?:\p{Lu}\.[ -]?)+$"), F.lit(False)), F.concat(nxt, F.lit(" "), piece), **both),
        _part("REF-AUTH-INITIALS", "error", r"\b(\p{Lu})\.(?=\p{Lu})", "$1. ", author & ~piece.rlike(r"^\p{Lu}+$")),
        _part("REF-AUTH-INITIAL", "error", r"(?:^|(?<=and ))(\p{Lu}) (?=(?:\p{Lu}\.? )?\p{Lu}\p{Ll})", "$1. ", author),
        _part("REF-AUTH-INITIAL", "error", r"(?:^|(?<=and ))(\p{Lu})[,;:] ?(?=\p{Lu}\p{Ll})", "$1. ", author),
        _part("REF-AUTH-GIVEN", "error", rf"(?:^|(?<=and ))(\p{{Lu}})\p{{Ll}}+ (?={SURNAME}(?: and |$| et al))", "$1. ", author & (F.col("quotes") > 0)),
        _part("REF-AUTH-AND", "error", r"\s*&\s*", " and ", author),
        _form("REF-AUTH-AND", "error", rf"({one_person}) and ({one_person}) and ({one_person})", "$1, $2, and $3", author),
        Rule("REF-AUTH-FORM", "error", author & ~piece.rlike(r"^(?:and )?(?:et al\.?|(?:\p{Lu}\.[ -]?)+ ?\p{L}.*)$") & ~F.coalesce(nxt.rlike(r"^(?:\p{Lu}\.[ -]?)+$"), F.lit(False)), None),
        # Titles.
        _form("REF-TITLE-QUOTES", "error", "\"(.*)\"|“(.*)\"|\"(.*)”", "“$1$2$3”"),
        _form("REF-TITLE-COMMA", "error", "“(.*?)\\s*[,.;:]+\\s*”", "“$1”"),
        Rule("REF-TITLE-CAPS", "error", quoted & (letters >= 12) & (capitals > 0.8 * letters), F.concat(F.substring(piece, 1, 2), F.lower(F.substring(piece, 3, 2**20)))),
        _part("REF-TITLE-HYPHEN", "warning", r"(\p{Ll})-\s+(?=\p{Ll}{3})(?!(?:and|or|und|et)\b)", "$1", quoted),
        Rule("REF-TITLE-NAMES", "error", quoted & inner.rlike(rf"^(?:{one_person}, )+(?:and )?{one_person},"), None),
        # Proceedings.
        _part("REF-PROC-FORM", "error", r"(?i)^in:?\s+(?:the\s+)?proceedings\s+of\s+(?:the\s+)?", "in Proc. ", body),
        _part("REF-PROC-FORM", "error", r"^(?:in\s+)?[Pp]roc(?:eedings)?\b\.?\s*(?:of\s+(?:the\s+)?)?(?=\p{L})", "in Proc. ", body & ~piece.rlike(r"^in Proc\. (?!of)")),
        _part("REF-PROC-LABEL", "error", rf"\b({SERIES})(?:\s*[-’'‘]\s?|\s)?(?:20|19)?([0-9]{{2}})$", "$1’$2", body, True),
        Rule("REF-PROC-YEAR", "error", (year != "") & (F.col("years") != "") & (F.right("years", F.lit(2)) != year), None),
        # Numbers.
        Rule("REF-REPEATED", "error", body & (F.length(piece) > 1) & F.coalesce((nxt == piece) | nxt.startswith(F.concat(piece, F.lit(" "))), F.lit(False)), nxt, **both, frees=True),
        Rule("REF-REPEATED", "error", body & piece.rlike(r"\b(\p{L}{2,}) \1\b"), F.regexp_replace(piece, r"\b(\p{L}{2,}) \1\b", "$1")),
        Rule("REF-MONTH", "error", body & piece.rlike(f"^{a_month}$") & F.coalesce(nxt.rlike("^(?:19|20)[0-9]{2}$"), F.lit(False)), F.concat(short, F.lit(" "), nxt), **both),
        Rule("REF-MONTH", "error", body & piece.rlike(rf"^{a_month},?\s+(?:[0-9]{{1,2}}, )?(?:19|20)[0-9]{{2}}$"), F.concat(short, F.regexp_replace(piece, r"^\p{L}+\.?,?", ""))),
        Rule("REF-PAGES", "error", body & piece.rlike(r"^pp?\.?$") & F.coalesce(nxt.rlike(r"^[0-9]\w*(?:[-–—]\w+)?$"), F.lit(False)), F.concat(F.when(nxt.rlike("[-–—]"), "pp. ").otherwise("p. "), nxt), **both),
        _form("REF-PAGES", "error", r"(?i)p{1,2}(?:ages?)?\.?\s*([0-9A-Z]*[0-9]\w*)\s*[-–—]+\s*([0-9A-Z]*[0-9]\w*)", "pp. $1-$2", body),
        _form("REF-PAGES", "error", r"(?:[Pp]{1,2}|[Pp]ages?)\.?\s*([0-9]\w*)", "p. $1", body),
        _form("REF-VOLUME", "error", r"(.+?[\p{Ll}.])\s+(?:[Vv]ol(?:ume)?\b\.?)\s*([0-9]\w*)", "$1, vol. $2", body),
        _form("REF-VOLUME", "error", r"(?:[Vv]ol(?:ume)?\b\.?)\s*([0-9]\w*)", "vol. $1", body),
        _form("REF-VOLUME", "error", r"(?:[Ii]ssue|[Ii]ss\.|[Nn]o\b\.?|[Nn]r\.|[Nn]umber|[Nn]\.)\s*([0-9]\w*)", "no. $1", body),
        _form("REF-JOURNAL", "error", r"in ((?:\p{Lu}\p{L}*\.\s?)+(?: ?\p{Lu}\b)?)", "$1", body & (F.col("volumes") > 0) & (F.col("publishers") == 0)),
        _form("REF-YEAR", "error", r"\(((?:19|20)[0-9]{2})\)", "$1", body),
        _form("REF-YEAR", "error", r"(.+?)\s*\(((?:19|20)[0-9]{2})\)", "$1, $2", body),
        Rule("REF-JOURNAL-ORDER", "error", body & piece.rlike(r"^vol\. ") & F.coalesce(F.col("prior").rlike(r"^(?:no\.|pp?\.) "), F.lit(False)), None),
        _part("REF-STATUS", "warning", r"^[Aa]ccepted(?:\s+for\s+publication)?(?:\s+in\s+[0-9]{4})?", "to be published", body, True),
        Rule("REF-PLACE", "warning", body & F.coalesce(nxt.rlike(r"^(?:USA|U\.S\.A\.|US|United States.*)$"), F.lit(False)) & F.create_map(*[F.lit(x) for code, name in R.STATES.items() for x in (name, code)])[piece].isNotNull(), F.create_map(*[F.lit(x) for code, name in R.STATES.items() for x in (name, code)])[piece]),
        _form("REF-PLACE", "warning", r"U\.S\.A\.?|US|United States(?: of America)?", "USA", body & (F.col("k") > 0)),
        Rule("REF-LATEX", "warning", piece.rlike(r"\\[A-Za-z]+|[{}]"), None),
        # Between pieces, and at the end.
        _part("REF-PUNCT", "info", r"(\p{Ll}{3})\.$", "$1", body & F.coalesce(nxt.rlike("^https?://"), F.lit(False)) & (F.col("next_lead") == ",")),
        Rule("REF-DOI-SEP", "error", is_doi & (F.col("gap") != ". "), F.lit(". "), F.col("prior_end"), F.col("start")),
        Rule("REF-PUNCT", "info", ~is_link & (F.col("gap") != gap), gap, F.col("prior_end"), F.col("start")),
        Rule("REF-DOI-END", "error", is_doi & (F.coalesce("tail", F.lit("")) != ""), F.lit(""), F.col("end"), F.col("end") + F.length("tail")),
        Rule("REF-END", "info", ~is_link & F.col("tail").isNotNull() & (F.coalesce("tail", F.lit("")) != tail), tail, F.col("end"), F.col("end") + F.length("tail")),
    ]


def read(refs: DataFrame, ref: str = "ref", text: str = "text") -> DataFrame:
    """Pieces with their mark, their neighbours, and what the reference has: what the rules read."""
    of = W.partitionBy("ref")
    order = of.orderBy("k")
    p = parsing.marked(parsing.pieces(refs, ref, text)).drop("value", "at")
    own = F.col("piece")
    count = lambda c: F.count_if(c).over(of)
    letters = lambda kept: F.sum(F.length(F.regexp_replace(own, kept, ""))).over(of)
    doi = F.when(own.rlike(r"^doi:10\."), own)
    title_k = F.min(F.when(own.rlike("^[“\"]"), F.col("k"))).over(of)
    p = p.withColumns({
        "next": F.lead("piece").over(order), "next_lead": F.lead("lead").over(order), "next_gap": F.lead("gap").over(order), "next_end": F.lead("end").over(order), "prior": F.lag("piece").over(order), "prior_end": F.coalesce(F.lag("end").over(order), F.lit(0)),
        "prior_doi": F.last(doi, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), "doi": F.coalesce(F.max(doi).over(of), F.lit("")), "dois": count(own.rlike(r"^(?i:doi)|^10\.[0-9]")), "quotes": count(own.rlike("^[“\"]")),
        "volumes": count(own.rlike(r"\b[Vv]ol(?:ume)?\b|^no\. ")), "publishers": count(F.col("mark") == "publisher"), "latin": letters("[^A-Za-z]"), "cyrillic": letters("[^Ѐ-ӿ]"),
        "years": F.coalesce(F.max(F.when((F.col("mark") == "date"), F.right("piece", F.lit(4)))).over(of), F.lit("")), "title_k": title_k,
    })
    return p.withColumn("author", F.coalesce(F.col("k") < F.col("title_k"), F.col("mark") == "person"))


def issues(refs: DataFrame, ref: str = "ref", text: str = "text") -> DataFrame:
    """(ref, rank, code, severity, start, end, excerpt, put, frees): a rank for each rule, by which it wins; ``put`` is null for reports."""
    found = []
    for rank, r in enumerate(rules()):
        start, end = F.col("start") if r.start is None else r.start, F.col("end") if r.end is None else r.end
        whole = r.start is None
        changes = F.lit(True) if r.put is None or not whole else r.put != F.col("piece")
        put = F.lit(None).cast("string") if r.put is None else r.put
        found.append(F.when(r.where & changes, F.struct(F.lit(rank).alias("rank"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), start.cast("int").alias("start"), end.cast("int").alias("end"), put.alias("put"), F.lit(r.frees).alias("frees"))))
    rows = read(refs, ref, text).select("ref", F.explode(F.array_compact(F.array(*found))).alias("i")).select("ref", "i.*")
    texts = refs.select(F.col(ref).alias("ref"), F.col(text).alias("__text"))
    out = rows.join(texts, "ref").select("ref", "rank", "code", "severity", "start", "end", F.substring(F.col("__text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("excerpt"), "put", "frees")
    return out.filter(F.col("put").isNull() | (F.col("put") != F.col("excerpt")))


def _numbers(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))


def kept_facts(found: DataFrame) -> DataFrame:
    """Issues whose replacement has the numbers of what it replaces, or may change them by its rule."""
    return found.filter(F.col("put").isNotNull() & (F.col("frees") | (_numbers(F.col("excerpt")) == _numbers(F.col("put")))))


def apart(found: DataFrame) -> DataFrame:
    """Of issues that overlap or touch in a reference, those of the rules that come first."""
    e = found.select(F.col("ref").alias("file"), F.col("start").alias("own_start"), F.col("end").alias("own_end"), (F.col("start") * 2).alias("start"), (F.col("end") * 2 + 1).alias("end"), F.lit("").alias("before"), F.col("put").alias("after"), F.col("code").alias("check_id"), F.col("rank").alias("priority"))
    return edits.resolve(e).select("file", F.col("own_start").alias("start"), F.col("own_end").alias("end"), "after")


def solved(refs: DataFrame, ref: str = "ref", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(ref, text, rounds): references with all that can be replaced replaced, and the rounds that this took."""
    own = refs.select(F.col(ref).alias("ref"), F.col(text).alias("text"), F.md5(F.col(text)).alias("file"))
    # What a text becomes depends on the text alone, so equal ones are solved once, under their digest.
    now = stash(own.filter("text IS NOT NULL").groupBy("file").agg(F.first("text").alias("text")).withColumn("rounds", F.lit(0)), "to-solve")
    done = None
    for n in range(1, rounds + 1):
        chosen = apart(kept_facts(issues(now, "file", "text")))
        made = edits.apply(chosen, now.select("file", "text")).join(now.select("file", F.col("text").alias("was"), "rounds"), "file")
        made = stash(made.select("file", "text", (F.col("n_applied") > 0).alias("changed"), F.when(F.col("n_applied") > 0, n).otherwise(F.col("rounds")).alias("rounds")), "solved")
        still = made.filter(~F.col("changed")).drop("changed")
        done = still if done is None else done.unionByName(still)
        now = made.filter("changed").drop("changed")
        if now.isEmpty():
            break
    else:
        done = done.unionByName(now)
    found = own.join(done.withColumnRenamed("text", "solved"), "file", "left")
    return found.select("ref", F.coalesce("solved", "text").alias("text"), F.coalesce("rounds", F.lit(0)).alias("rounds"))


#: Reports by the fields that a kind's layout needs and a reference lacks.
LACKS = {"title": "REF-TITLE-MISSING", "pages": "REF-PAGES-MISSING", "volume": "REF-VOLUME-MISSING", "year": "REF-YEAR-MISSING", "conference": "REF-PROC-FORM", "doi": "REF-DOI-MISSING"}


def lacking(refs: DataFrame, ref: str = "ref", text: str = "text") -> DataFrame:
    """(ref, category, field, code) of each field that a reference's layout needs and its text lacks."""
    maps = parsing.parsed(refs, ref, text).filter("category <> ''").groupBy("ref", "category").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    codes = F.create_map(*[F.lit(x) for pair in LACKS.items() for x in pair])
    lost = maps.select("ref", "category", F.explode(R.missing(F.col("category"), F.col("fields"))).alias("field"))
    return lost.select("ref", "category", "field", F.coalesce(codes[F.col("field")], F.lit("REF-MISSING")).alias("code"))


def lint(refs: DataFrame, ref: str = "ref", text: str = "text") -> DataFrame:
    """(ref, code, severity) once for each rule that a reference breaks."""
    return issues(refs.withColumn(text, X.text(F.col(text))), ref, text).select("ref", "code", "severity").distinct()
