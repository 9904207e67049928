"""References made of parts, with the usual slips: rules, kinds, layouts, and the registry of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.functions import references as R, texts as X, vocabulary as V
from proofmill.operators import rules
from proofmill.plans.registry import query
from proofmill.session import spread, table

AUTHORS = ["A. Alpha", "A. Alpha, et al", "A.B. Alpha & B. Beta", "A. Alpha and C. Gamma", "А. Beta"]
TITLES = ['"%s,"', "“%s.”", "“%s”,"]
ENDS = [
    "Phys. Rev. Lett.  Vol. 7, Issue 3, p. 12 - 19, Sept 2001. DOI: 10.1103/PhysRevLett.7",
    "in Proc. IPAC 2023, Venice, Italy, May, 2023, pp, 5-9 , https://doi.org/10.18429/JACoW-IPAC23-X.",
    "arXiv preprint arXiv:2001.01234, (2019)",
    "[Online]. Available: https://example.org/a",
    "Ph.D. thesis, Houston, Texas, USA , May, May 1996, unpublished",
    "https://arxiv.org/abs/2101.00001v2, code., https://x.org/y",
    "Nucl. Instrum. Methods, accepted for publication in 2020 \\emph",
    "Rep. 12, pp. 123456, January 3, 2020; 10.1000/abc, presented at LINAC-2018",
]


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), n.cast("int"))
    key = F.col("p_partkey")
    title = F.replace(pick(TITLES, key % len(TITLES) + 1), F.lit("%s"), F.col("p_name"))
    return spread(table(spark, sf_dir, "part")).select(key.alias("ref"), F.concat_ws(" ", F.concat(pick(AUTHORS, F.col("p_size") % len(AUTHORS) + 1), F.lit(",")), title, pick(ENDS, key % len(ENDS) + 1)).alias("text"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


REFS = f"refs AS (SELECT p_partkey AS ref, {_list(AUTHORS)}[p_size % {len(AUTHORS)} + 1] || ', ' || replace({_list(TITLES)}[p_partkey % {len(TITLES)} + 1], '%s', p_name) || ' ' || {_list(ENDS)}[p_partkey % {len(ENDS)} + 1] AS text FROM part)"


# What each part of a made reference is to become, and what is wrong with it, written down and not derived from the rules.
FIXED_AUTHORS = ["A. Alpha", "A. Alpha et al.", "A. B. Alpha and B. Beta", "A. Alpha and C. Gamma", "A. Beta"]
FIXED_ENDS = [
    "Phys. Rev. Lett., vol. 7, no. 3, pp. 12-19, Sep. 2001. doi:10.1103/PhysRevLett.7",
    "in Proc. IPAC’23, Venice, Italy, May 2023, pp. 5-9. doi:10.18429/JACoW-IPAC23-X",
    "2019. doi:10.48550/arXiv.2001.01234",
    "https://example.org/a",
    "Ph.D. thesis, Houston, TX, USA, May 1996, unpublished.",
    "code, https://x.org/y. doi:10.48550/arXiv.2101.00001",
    "Nucl. Instrum. Methods, to be published \\emph.",
    "Rep. 12, p. 123456, Jan. 3, 2020, presented at LINAC’18. doi:10.1000/abc",
]
AUTHOR_ISSUES = [(1, "REF-ETAL-COMMA", "A. Alpha, et al", "A. Alpha et al."), (1, "REF-ETAL", "et al", "et al."), (2, "REF-AUTH-INITIALS", "A.B. Alpha & B. Beta", "A. B. Alpha & B. Beta"), (2, "REF-AUTH-AND", "A.B. Alpha & B. Beta", "A.B. Alpha and B. Beta"), (4, "REF-LOOKALIKE", "А. Beta", "A. Beta")]
TITLE_ISSUES = [(0, "REF-TITLE-QUOTES", '"%s,"', "“%s,”"), (0, "REF-PUNCT", " ", ", "), (1, "REF-TITLE-COMMA", "“%s.”", "“%s”"), (1, "REF-PUNCT", " ", ", ")]
END_ISSUES = [
    (0, "REF-PUNCT", "Phys. Rev. Lett.  Vol. 7", "Phys. Rev. Lett. Vol. 7"), (0, "REF-VOLUME", "Phys. Rev. Lett.  Vol. 7", "Phys. Rev. Lett., vol. 7"), (0, "REF-VOLUME", "Issue 3", "no. 3"), (0, "REF-PAGES", "p. 12 - 19", "pp. 12-19"), (0, "REF-MONTH", "Sept 2001", "Sep. 2001"), (0, "REF-DOI-FORM", "DOI: 10.1103/PhysRevLett.7", "doi:10.1103/PhysRevLett.7"),
    (1, "REF-PROC-LABEL", "in Proc. IPAC 2023", "in Proc. IPAC’23"), (1, "REF-MONTH", "May, 2023", "May 2023"), (1, "REF-PAGES", "pp, 5-9", "pp. 5-9"), (1, "REF-DOI-URL", "https://doi.org/10.18429/JACoW-IPAC23-X", "doi:10.18429/JACoW-IPAC23-X"),
    (2, "REF-ARXIV-PREPRINT", "arXiv preprint arXiv:2001.01234", "arXiv:2001.01234"), (2, "REF-YEAR", "(2019)", "2019"), (2, "REF-END", "", "."),
    (3, "REF-URL-ONLINE", "[Online]. Available", ""), (3, "REF-PUNCT", ": ", ". "),
    (4, "REF-PLACE", "Texas", "TX"), (4, "REF-PUNCT", " , ", ", "), (4, "REF-REPEATED", "May, May 1996", "May 1996"), (4, "REF-END", "", "."),
    (5, "REF-ARXIV-URL", "https://arxiv.org/abs/2101.00001v2", "arXiv:2101.00001"), (5, "REF-PUNCT", "code.", "code"),
    (6, "REF-STATUS", "accepted for publication in 2020 \\emph", "to be published \\emph"), (6, "REF-LATEX", "accepted for publication in 2020 \\emph", None), (6, "REF-END", "", "."),
    (7, "REF-PAGES", "pp. 123456", "p. 123456"), (7, "REF-MONTH", "January 3, 2020", "Jan. 3, 2020"), (7, "REF-DOI-FORM", "10.1000/abc", "doi:10.1000/abc"), (7, "REF-PROC-LABEL", "presented at LINAC-2018", "presented at LINAC’18"), (7, "REF-END", "", "."),
]
SEVERITY = {"REF-PUNCT": "info", "REF-END": "info", "REF-LATEX": "warning", "REF-ARXIV-PREPRINT": "warning", "REF-URL-ONLINE": "warning", "REF-STATUS": "warning", "REF-PLACE": "warning"}


def _rows(rows: list[tuple]) -> str:
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ") AS v(i, code, excerpt, put)"


ISSUES = " UNION ALL ".join(
    f"SELECT p_partkey AS ref, code, replace(excerpt, '%s', p_name) AS excerpt, replace(put, '%s', p_name) AS put FROM part JOIN {_rows(rows)} ON {n} % {of} = i"
    for rows, n, of in ((AUTHOR_ISSUES, "p_size", len(AUTHORS)), (TITLE_ISSUES, "p_partkey", len(TITLES)), (END_ISSUES, "p_partkey", len(ENDS)))
)


@query(f"SELECT *, true AS held FROM ({ISSUES})")
def reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules find in each reference, by span, and what they would put there."""
    refs = _references(spark, sf_dir)
    both = rules.issues(refs).join(refs, "ref")
    return both.select("ref", "code", "excerpt", "put", (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("excerpt")).alias("held"))


@query(f"SELECT DISTINCT ref, code, CASE code {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {chr(39)}{s}{chr(39)}' for c, s in SEVERITY.items())} ELSE 'error' END AS severity FROM ({ISSUES})")
def reference_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of what the rules find in each reference."""
    return rules.lint(_references(spark, sf_dir))


@query(f"SELECT p_partkey AS ref, {_list(FIXED_AUTHORS)}[p_size % {len(AUTHORS)} + 1] || ', “' || p_name || '”, ' || {_list(FIXED_ENDS)}[p_partkey % {len(ENDS)} + 1] AS text FROM part")
def reference_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References after all rounds of fixing."""
    return rules.solved(_references(spark, sf_dir)).select("ref", "text")


KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{mark}')" + (r" AND NOT regexp_matches(text, '\bvol\.')" if name in R.NOT_WITH_VOLUME else "") + f" THEN '{name}'" for name, mark in R.KINDS) + " ELSE '' END"


@query(f"WITH {REFS} SELECT ref, {KIND_SQL} AS kind FROM refs")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).select("ref", R.kind(F.col("text")).alias("kind"))


NAMES = list(R.LAYOUTS)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of references: each part has those that its number picks, in a category that its size picks."""
    key, size = F.col("p_partkey"), F.col("p_size")
    made = [F.when((key * (i + 3)) % 7 > 1, F.concat(F.lit(name), F.lit("-"), (key % 5).cast("string"))).otherwise("") for i, name in enumerate(R.FIELDS) if name != "status"]
    entries = [x for name, c in zip([n for n in R.FIELDS if n != "status"], made, strict=True) for x in (F.lit(name), c)]
    status = F.when(key % 4 == 0, "pending").otherwise("")
    return table(spark, sf_dir, "part").select(key.alias("ref"), F.element_at(F.array(*map(F.lit, NAMES)), (size % len(NAMES) + 1).cast("int")).alias("category"), F.create_map(*entries, F.lit("status"), status, F.lit("proceedings"), F.when(key % 3 == 0, "p").otherwise("")).alias("fields"))


FIELD_SQL = "f AS (SELECT p_partkey AS ref, " + _list(NAMES) + f"[p_size % {len(NAMES)} + 1] AS category, " + ", ".join(f"CASE WHEN (p_partkey * {i + 3}) % 7 > 1 THEN '{name}-' || (p_partkey % 5) ELSE '' END AS \"{name}\"" for i, name in enumerate(R.FIELDS) if name != "status") + ", CASE WHEN p_partkey % 4 = 0 THEN 'pending' ELSE '' END AS status, CASE WHEN p_partkey % 3 = 0 THEN 'p' ELSE '' END AS proceedings FROM part)"


def _missing_sql() -> str:
    standing = {("conference", None): "proceedings <> ''", ("title", "online"): "organization <> ''", ("book", "book"): "title <> ''", ("patent", "patent"): "status = 'pending'", ("year", "patent"): "status = 'pending'"}
    cases = []
    for name, (need, _, _) in R.LAYOUTS.items():
        items = []
        for f in need.split():
            but = standing.get((f, None)) or standing.get((f, name))
            items.append(f"CASE WHEN \"{f}\" = ''" + (f" AND NOT ({but})" if but else "") + f" THEN '{f}' END")
        cases.append(f"WHEN category = '{name}' THEN concat_ws(' ', {', '.join(items)})")
    return "CASE " + " ".join(cases) + " END"


@query(f"WITH {FIELD_SQL} SELECT ref, category, {_missing_sql()} AS missing FROM f")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that each reference's layout needs and lacks."""
    return _fields(spark, sf_dir).select("ref", "category", F.array_join(R.missing(F.col("category"), F.col("fields")), " ").alias("missing"))


def _render_sql() -> str:
    w = lambda head, c, tail="": f"CASE WHEN {c} <> '' THEN '{head}' || {c} || '{tail}' END"
    place = "concat_ws(', ', nullif(city, ''), nullif(state, ''), nullif(country, ''))"
    own = {
        "quoted": w("“", "title", "”"), "in_proc": w("in Proc. ", "conference"), "presented": w("presented at ", "conference"), "in_book": w("in ", "book"), "place": f"nullif({place}, '')",
        "date": "CASE WHEN year = '' THEN NULL WHEN month <> '' THEN month || ' ' || year ELSE year END", "paper": w("paper ", "paper_id"), "paper_unless_doi": "CASE WHEN doi = '' AND paper_id <> '' THEN 'paper ' || paper_id END",
        "pages": "CASE WHEN pages = '' THEN NULL WHEN regexp_matches(pages, '[-,]') THEN 'pp. ' || pages ELSE 'p. ' || pages END", "vol": w("vol. ", "volume"), "editors": "CASE WHEN editors <> '' THEN editors || CASE WHEN contains(editors, ' and ') THEN ', Eds.' ELSE ', Ed.' END END", "named": "coalesce(nullif(title, ''), nullif(organization, ''))", "day_or_pending": "CASE WHEN status = 'pending' THEN 'patent pending' WHEN year = '' THEN NULL WHEN month <> '' THEN month || ' ' || year ELSE year END", "no": w("no. ", "issue"), "rep": w("Rep. ", "report"), "thesis": w("", "thesis", " thesis"),
        "publisher": f"nullif(concat_ws(': ', nullif({place}, ''), nullif(publisher, '')), '')",
    }
    piece = lambda p: "'" + p[1:].replace("_", " ") + "'" if p[0] == "=" else own.get(p, f"nullif(\"{p}\", '')")
    cases = []
    for name, (_, pieces, end) in R.LAYOUTS.items():
        head, _, tail = pieces.rpartition(". ")
        body = f"concat_ws(', ', {', '.join(map(piece, tail.split()))})"
        if head:
            body = f"concat_ws('. ', nullif(concat_ws(', ', {', '.join(map(piece, head.split()))}), ''), nullif({body}, ''))"
        after = {"": "'.'", "none": "''", "bare": "CASE WHEN url <> '' THEN '' ELSE '.' END", "doi": "'.' || CASE WHEN doi <> '' THEN ' doi:' || doi ELSE '' END", "link": "'.' || CASE WHEN doi <> '' THEN ' doi:' || doi WHEN url <> '' THEN ' ' || url ELSE '' END"}[end]
        cases.append(f"WHEN category = '{name}' THEN regexp_replace({body} || {after}, '\\.\\.($|\\s)', '.\\1', 'g')")
    return "CASE " + " ".join(cases) + " END"


@query(f"WITH {FIELD_SQL} SELECT ref, category, {_render_sql()} AS text FROM f")
def rendered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("ref", "category", R.render(F.col("category"), F.col("fields")).alias("text"))


@query(f"""SELECT coalesce(z.check_id, t.check_id) AS check_id, coalesce(zone, '{V.BODY}') AS zone, code AS tag FROM {V.values(V.pairs(V.ZONE_OF_CHECK))} z(check_id, zone) FULL JOIN {V.values(V.pairs(V.CHECKS_OF_TAG))} t(check_id, code) ON z.check_id = t.check_id""")
def check_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone and tag of every check."""
    known = sorted({c for c, _ in V.pairs(V.ZONE_OF_CHECK)} | {c for c, _ in V.pairs(V.CHECKS_OF_TAG)})
    return spark.createDataFrame([(c,) for c in known], "check_id string").select("check_id", X.zone_of_check(F.col("check_id")).alias("zone"), X.lookup(F.col("check_id"), V.pairs(V.CHECKS_OF_TAG)).alias("tag"))
