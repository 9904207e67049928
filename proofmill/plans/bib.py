"""Parts as .bib files with two entries each: nested braces, quotes, concatenations, comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import bib
from proofmill.plans.registry import query
from proofmill.session import table

PIECES = [
    "% kept as it is: {NAME\n@string{pr = {Phys. Rev.}}\n@Article{a-KEY,\n  Title  = {{On} NAME, “{\\'E}tude”},\n  journal = pr # \" A\" , pages = \"KEY - 9KEY\",\n  year = 19",
    ",\n}\nbetween } @comment{not @article{this, a = {b}}}\n@book(b-KEY, author = {A and {B and {C}}}, url = {https://doi.org/10.1/KEY},\n doi = \"https://doi.org/10.1000/x.KEY\", note = {})\n@misc{c-KEY, title = {open, year = 2001\n",
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    filled = [F.replace(F.replace(F.lit(p), F.lit("KEY"), key), F.lit("NAME"), name) for p in PIECES]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.concat(filled[0], F.lpad((F.col("p_size") + 10).cast("string"), 2, "0"), filled[1]).alias("text"))


def _sql(text: str) -> str:
    return "replace(replace('" + text.replace("'", "''") + "', 'KEY', p_partkey::VARCHAR), 'NAME', p_name)"


TEXT = f"{_sql(PIECES[0])} || lpad((p_size + 10)::VARCHAR, 2, '0') || {_sql(PIECES[1])}"
#: (entry, kind, key, field, value, what is before the value), as they are to be read.
FIELDS = [
    (0, "string", "", "pr", "Phys. Rev.", "@string{pr = {"), (1, "article", "a-KEY", "title", "{On} NAME, “{\\'E}tude”", "Title  = {"), (1, "article", "a-KEY", "journal", 'pr # " A"', "journal = "), (1, "article", "a-KEY", "pages", "KEY - 9KEY", 'pages = "'),
    (2, "book", "b-KEY", "author", "A and {B and {C}}", "author = {"), (2, "book", "b-KEY", "url", "https://doi.org/10.1/KEY", "url = {"), (2, "book", "b-KEY", "doi", "https://doi.org/10.1000/x.KEY", 'doi = "'), (2, "book", "b-KEY", "note", "", "note = {"),
]


def _rows() -> str:
    out = [f"SELECT file, {e} AS entry, '{kind}' AS kind, {_sql(key)} AS key, NULL AS fault, '{field}' AS field, {_sql(value)} AS value, strpos(text, {_sql(lead)})::INT + length({_sql(lead)})::INT - 1 AS start FROM f" for e, kind, key, field, value, lead in FIELDS]
    out.append(f"SELECT file, 1, 'article', {_sql('a-KEY')}, NULL, 'year', '19' || lpad((p_size + 10)::VARCHAR, 2, '0'), strpos(text, 'year = 19')::INT + 6 FROM f")
    out.append("SELECT file, 3, 'misc', '', 'unclosed', NULL, NULL, NULL FROM f")
    return " UNION ALL ".join(out)


@query(f"WITH f AS (SELECT p_partkey AS file, p_partkey, p_name, p_size, {TEXT} AS text FROM part) {_rows()}")
def bib_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.fields(files(spark, sf_dir)).select("file", "entry", "kind", "key", "fault", "field", "value", "start")


@query(f"""WITH f AS (SELECT p_partkey AS file, {TEXT} AS text, p_partkey::VARCHAR AS k FROM part)
SELECT file, replace(replace(text, '"https://doi.org/10.1000/x.' || k || '"', '"10.1000/x.' || k || '"'), '"' || k || ' - 9' || k || '"', '"' || k || '--9' || k || '"') AS text, 2 AS n_applied FROM f""")
def bib_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their DOIs and pages in the house's form, and every other byte as it was."""
    return bib.rewritten(files(spark, sf_dir))
