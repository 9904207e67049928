"""Orders as references to conferences, nations as series with their editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import conferences as C
from proofmill.plans.registry import query
from proofmill.session import table

WAYS = ["Proc. 3rd International NAME Accelerator Conference (CODE’YY), May YEAR.", "in CODE YEAR, held in May, 1998.", "International NAME Accelerator Conf., doi:10.18429/JACoW-CODEYEAR-AB1", "see code-YY"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    year = 1990 + key % 20
    text = F.get(F.array(*(F.lit(w) for w in WAYS)), ((key / 20).cast("bigint") % 4).cast("int"))
    code = F.concat(F.char(65 + F.col("o_custkey") % 25), F.lit("AC"))
    for mark, value in (("CODE", code), ("code", F.lower(code)), ("YEAR", year.cast("string")), ("YY", F.lpad((year % 100).cast("string"), 2, "0")), ("NAME", F.concat(F.lit("Nation "), (F.col("o_custkey") % 25).cast("string")))):
        text = F.replace(text, F.lit(mark), value)
    return table(spark, sf_dir, "orders").select(key.alias("file"), F.to_date("o_orderdate").alias("date"), text.alias("text"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.concat(F.lit("International "), F.initcap(F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))), F.lit(" Accelerator Conf"))
    return table(spark, sf_dir, "nation").select(F.concat(F.char(65 + F.col("n_nationkey")), F.lit("AC")).alias("series"), long.alias("long"))


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(1990), F.lit(2009))).alias("year")).filter((F.col("k") + F.col("year")) % 3 > 0)
    return each.select(F.concat(F.char(65 + F.col("k")), F.lit("AC")).alias("series"), "year", F.make_date("year", F.lit(5), 1 + F.col("k")).alias("began"), F.concat(F.lit("City "), F.col("k").cast("string")).alias("place"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.found(texts(spark, sf_dir), series(spark, sf_dir))


SRC = """o AS (SELECT o_orderkey AS file, o_orderdate::DATE AS date, (1990 + o_orderkey % 20)::INT AS y, o_orderkey // 20 % 4 AS way, chr((65 + o_custkey % 25)::INT) || 'AC' AS series, 'Nation ' || o_custkey % 25 AS name FROM orders),
t AS (SELECT *, lpad((y % 100)::VARCHAR, 2, '0') AS yy, 'International ' || name || ' Accelerator Conference' AS long FROM o),
w AS (SELECT file, date, series, way, y AS year, 'label' AS kind, CASE way WHEN 0 THEN 'Proc. 3rd ' || long || ' (' WHEN 1 THEN 'in ' ELSE 'see ' END AS front, CASE way WHEN 0 THEN series || '’' || yy WHEN 1 THEN series || ' ' || y ELSE lower(series) || '-' || yy END AS written, CASE way WHEN 0 THEN y WHEN 1 THEN 1998 END AS stated FROM t WHERE way <> 2
 UNION ALL SELECT file, date, series, way, NULL, 'name', CASE way WHEN 0 THEN 'Proc. 3rd ' ELSE '' END, CASE way WHEN 0 THEN long ELSE left(long, -6) END, NULL FROM t WHERE way IN (0, 2)
 UNION ALL SELECT file, date, series, way, y, 'doi', left(long, -6) || '., doi:', '10.18429/JACoW-' || series || y, NULL FROM t WHERE way = 2),
f AS (SELECT *, length(front)::INT AS start, (length(front) + length(written))::INT AS "end" FROM w)"""


@query(f'WITH {SRC} SELECT file, start, "end", kind, series, year, stated, written FROM f')
def conferences_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


@query(f"""WITH {SRC} SELECT file, start, "end", written AS before, series || '’' || lpad((year % 100)::VARCHAR, 2, '0') AS after FROM f WHERE kind = 'label' AND way <> 0""")
def conference_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_issues(found(spark, sf_dir))


@query(f"WITH {SRC} SELECT file, start, \"end\", series, year, stated FROM f WHERE kind = 'label' AND year <> stated")
def conference_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.year_issues(found(spark, sf_dir))


@query(f"""WITH {SRC} SELECT file, series, max(year) AS year, series || '’' || lpad((max(year) % 100)::VARCHAR, 2, '0') AS label, max(CASE WHEN kind = 'name' THEN "end" END) AS at FROM f WHERE way = 2 GROUP BY 1, 2""")
def conference_long_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose DOI names a conference that their text doesn't, and where its label goes."""
    return C.unnamed(found(spark, sf_dir))


@query(f"""WITH {SRC}, e AS (SELECT chr(65 + n_nationkey) || 'AC' AS series, y::INT AS year, make_date(y, 5, 1 + n_nationkey) AS began, 'City ' || n_nationkey AS place FROM nation, range(1990, 2010) r(y) WHERE (n_nationkey + y) % 3 > 0)
SELECT file, start, "end", kind, f.series, coalesce(f.year, e.year) AS year, began, place FROM (SELECT * FROM f WHERE kind = 'label') f LEFT JOIN e ON e.series = f.series AND e.year = f.year
UNION ALL SELECT file, start, "end", kind, f.series, e.year, began, place FROM (SELECT * FROM f WHERE kind = 'name') f ASOF LEFT JOIN e ON e.series = f.series AND e.began <= f.date""")
def conference_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label with the edition of its year, each name with the last edition before the order's date."""
    return C.editions_meant(found(spark, sf_dir), texts(spark, sf_dir), editions(spark, sf_dir))
