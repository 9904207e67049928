"""References of all kinds, made from fields of parts and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofmill.functions import references as R
from proofmill.operators import parsing
from proofmill.plans.references import _list, _render_sql
from proofmill.plans.registry import query
from proofmill.session import table

NAMES = list(R.LAYOUTS)
PLACES = [("Venice", "", "Italy"), ("Chicago", "IL", "USA"), ("Cape Town", "", "South Africa"), ("Menlo Park", "CA", "USA"), ("Karlsruhe", "", "Germany")]
#: Values of fields, picked by a part's key.
VALUES = {
    "authors": ["A. Alpha", "A. Alpha and B. T. Beta", "J.-P. Gamma, C. Delta, and E. van der Zeta", "B. Beta et al.", "R. O’Neil"],
    "conference": ["IPAC’23", "LINAC’24", "FLS’18"],
    "month": ["May", "Jan.", "Aug.-Sep.", "Oct."],
    "year": ["1986", "2014", "2023"],
    "pages": ["57-59", "050511", "1-7"],
    "paper_id": ["MOP057", "TUPA12"],
    "journal": ["Phys. Rev. Lett.", "Nucl. Instrum. Methods Phys. Res. A", "Nature"],
    "volume": ["114", "7A"],
    "issue": ["5", "12"],
    "doi": ["10.1103/PhysRevLett.114.050511", "10.18429/JACoW-IPAC2023-X.1"],
    "url": ["https://www.example.org/a_b", "https://docs.example.org/x:1/"],
    "publisher": ["Wiley", "MIT Press"],
    "institution": ["CERN", "Paul Scherrer Institute", "Institut für Technologie"],
    "report": ["CERN-2012-333", "17-03"],
    "thesis": ["Ph.D.", "M.Sc."],
    "organization": ["Motor Products Inc.", "IEEE Periodicals"],
    "patent": ["U.S. Patent 9 123 456", "EP Patent 77"],
    "editors": ["R. Mars", "A. Streun and B. Venus"],
    "edition": ["2nd ed.", "3rd ed."],
    "department": ["Phys. Dept.", "Dept. of Physics"],
}
STEPS = {name: i + 2 for i, name in enumerate(VALUES)}
PLACED = "conference conference_unpublished conference_current book_chapter book report technical_report thesis handbook manual".split()
#: What a kind has always, and what it has for some parts.
GIVEN = {
    "conference": ("authors title conference year pages", "month doi"), "conference_unpublished": ("authors title conference month year", "paper_id"), "conference_current": ("authors title conference month year paper_id", ""),
    "journal": ("authors title journal volume pages year", "issue month doi"), "accepted": ("authors title journal", ""), "submitted": ("authors title", ""), "arxiv": ("authors title month year doi", ""), "online": ("title url", ""),
    "book_chapter": ("authors title book publisher year", "pages editors"), "book": ("authors book publisher year", "edition doi"), "report": ("authors title institution report year", "month url"), "technical_report": ("title institution report year", "edition editors month url"),
    "thesis": ("authors title thesis institution year", "department"), "handbook": ("title organization year pages", "edition month url"), "manual": ("title organization year", "month url"), "patent": ("authors title patent", "year"), "unpublished": ("authors title", ""), "private": ("authors year", "month"),
}
#: Kinds with their title in quotation marks, which may hold anything.
QUOTED = "conference conference_unpublished conference_current journal accepted submitted arxiv book_chapter report thesis patent unpublished".split()
TITLE_TAIL = ", in Proc. form: vol. 3 (draft), 1999"
MADE = [n for n in R.FIELDS if n != "status"]


def _has(name: str) -> tuple[list[str], list[str]]:
    return [k for k, g in GIVEN.items() if name in g[0].split()], [k for k, g in GIVEN.items() if name in g[1].split()]


def made_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, category, fields): a kind by size, values by key, and every other optional field."""
    key = F.col("p_partkey")
    category = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_size") % len(NAMES) + 1).cast("int"))
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))

    def value(name: str) -> Column:
        always, some = _has(name)
        if name in ("city", "state", "country"):
            return F.when(F.col("category").isin(*PLACED), pick([p[("city", "state", "country").index(name)] for p in PLACES], key)).otherwise("")
        if name == "title":
            own = F.when(F.col("category").isin(*QUOTED), F.concat("p_name", F.lit(TITLE_TAIL))).when(F.col("category") == "handbook", F.concat("p_name", F.lit(" Handbook"))).otherwise(F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 999), F.lit(" Report")))
        elif name == "book":
            own = F.concat(F.lit("The Book of "), "p_name")
        else:
            own = pick(VALUES[name], F.floor(key / STEPS[name]))
        if name == "doi":
            own = F.when(F.col("category") == "arxiv", F.concat(F.lit("10.48550/arXiv."), (key % 9000 + 1000).cast("string"), F.lit(".01234"))).otherwise(own)
        return F.when(F.col("category").isin(*always), own).when(F.col("category").isin(*some) & (F.floor(key / (STEPS.get(name, 1) + 1)) % 2 == 0), own).otherwise("")

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", category.alias("category"))
    parts = parts.select("p_partkey", "category", *[value(n).alias(n) for n in MADE])
    pending = F.when((F.col("category") == "patent") & (F.col("year") == ""), "pending").otherwise("")
    return parts.select(key.alias("ref"), "category", F.create_map(*[x for n in MADE for x in (F.lit(n), F.col(n))], F.lit("status"), pending).alias("fields"))


def _value_sql(name: str) -> str:
    q = lambda kinds: "category IN (" + ", ".join(f"'{k}'" for k in kinds) + ")" if kinds else "false"
    if name in ("city", "state", "country"):
        i = ("city", "state", "country").index(name)
        return f"CASE WHEN {q(PLACED)} THEN {_list([p[i] for p in PLACES])}[p_partkey % {len(PLACES)} + 1] ELSE '' END"
    if name == "title":
        own = f"CASE WHEN {q(QUOTED)} THEN p_name || '{TITLE_TAIL}' WHEN category = 'handbook' THEN p_name || ' Handbook' ELSE upper(left(p_name, 1)) || substr(p_name, 2) || ' Report' END"
    elif name == "book":
        own = "'The Book of ' || p_name"
    else:
        own = f"{_list(VALUES[name])}[(p_partkey // {STEPS[name]}) % {len(VALUES[name])} + 1]"
    if name == "doi":
        own = f"CASE WHEN category = 'arxiv' THEN '10.48550/arXiv.' || (p_partkey % 9000 + 1000) || '.01234' ELSE {own} END"
    always, some = _has(name)
    return f"CASE WHEN {q(always)} OR ({q(some)} AND (p_partkey // {STEPS.get(name, 1) + 1}) % 2 = 0) THEN {own} ELSE '' END"


FIELD_SQL = f"""k AS (SELECT *, {_list(NAMES)}[p_size % {len(NAMES)} + 1] AS category FROM part),
f0 AS (SELECT p_partkey AS ref, category, {', '.join(f'{_value_sql(n)} AS "{n}"' for n in MADE)} FROM k),
f AS (SELECT *, CASE WHEN category = 'patent' AND year = '' THEN 'pending' ELSE '' END AS status FROM f0)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_fields(spark, sf_dir).select("ref", R.render(F.col("category"), F.col("fields")).alias("text"))


@query(f"""WITH {FIELD_SQL}, u AS (UNPIVOT (SELECT ref, category, {', '.join(f'"{n}"' for n in R.FIELDS)} FROM f) ON {', '.join(f'"{n}"' for n in R.FIELDS)} INTO NAME field VALUE value)
SELECT ref, category, field, value, true AS held FROM u WHERE value <> ''""")
def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that references were made of, read from their texts alone; each must stand at its span."""
    refs = texts(spark, sf_dir)
    both = parsing.parsed(refs).join(refs, "ref")
    return both.select("ref", "category", "field", "value", (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value")).alias("held"))


@query(f"WITH {FIELD_SQL} SELECT ref, category, {_render_sql()} AS text FROM f")
def reparsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References read and written anew: the same texts."""
    return parsing.rendered(parsing.parsed(texts(spark, sf_dir)))
