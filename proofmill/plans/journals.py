"""Names of parts and types as a list of journals, and names written in six ways looked up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import journals as J, parsing
from proofmill.plans.registry import query
from proofmill.session import spread, table


def _capital(c):
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c))))


def _cut(c):
    return F.when(F.length(c) > 5, F.concat(F.left(c, F.lit(4)), F.lit("."))).otherwise(c)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the words of their journal's name; the last word keeps the names apart."""
    first, second = (_capital(F.get(F.split("p_name", " "), F.lit(i))) for i in (0, 1))
    word = F.left(F.translate(F.md5(F.concat("p_name", "p_type")), "0123456789", "ghijklmnop"), F.lit(16))
    parts = spread(table(spark, sf_dir, "part")).select("p_partkey", first.alias("a"), second.alias("b"), _capital(F.col("p_type")).alias("c"), _capital(word).alias("d"))
    full = F.concat_ws(" ", F.lit("Journal of"), "a", "b", "c", "d")
    return parts.withColumn("full", full).withColumn("short", F.concat_ws(" ", F.lit("J."), *(_cut(F.col(x)) for x in "abcd")))


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("full", "short").distinct()


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with its journal's name: in capitals, short without stops, with a section, with a slip, in other short forms, or one that isn't listed."""
    two = lambda c: F.concat(F.left(c, F.lit(2)), F.lit("."))
    other = F.concat_ws(" ", F.lit("J."), two("a"), two("b"), two("c"), F.concat(F.left("d", F.lit(8)), F.lit(".")))
    ways = [F.upper("full"), F.replace(F.col("short"), F.lit("."), F.lit("")), F.concat("full", F.lit(": Letters and Reviews")), F.replace(F.col("full"), F.lit("Journal"), F.lit("Jounral")), other, F.concat(F.lit("Research in "), "a", F.lit(" "), "b", F.lit("s "), "c")]
    return rows(spark, sf_dir).withColumn("name", F.get(F.array(*ways), (F.col("p_partkey") % 6).cast("int")))


_CAP = "upper(left({0}, 1)) || lower(substr({0}, 2))"
_SHORT = "CASE WHEN length({0}) > 5 THEN left({0}, 4) || '.' ELSE {0} END"
LIST = f"""p AS (SELECT p_partkey, {_CAP.format("split_part(p_name, ' ', 1)")} AS a, {_CAP.format("split_part(p_name, ' ', 2)")} AS b, {_CAP.format("p_type")} AS c,
  {_CAP.format("left(translate(md5(p_name || p_type), '0123456789', 'ghijklmnop'), 16)")} AS d FROM part),
j AS (SELECT *, 'Journal of ' || a || ' ' || b || ' ' || c || ' ' || d AS "full", 'J. ' || {" || ' ' || ".join(_SHORT.format(x) for x in "abcd")} AS short FROM p)"""


NAMED = f"""{LIST}, n AS (SELECT p_partkey, short, p_partkey % 6 AS k, CASE p_partkey % 6 WHEN 0 THEN upper("full") WHEN 1 THEN replace(short, '.', '') WHEN 2 THEN "full" || ': Letters and Reviews' WHEN 3 THEN replace("full", 'Journal', 'Jounral')
  WHEN 4 THEN 'J. ' || left(a, 2) || '. ' || left(b, 2) || '. ' || left(c, 2) || '. ' || left(d, 8) || '.' ELSE 'Research in ' || a || ' ' || b || 's ' || c END AS name,
  'Research ' || a || ' ' || CASE b WHEN 'Widget' THEN 'Widg.' ELSE b || 's' END || ' ' || {_SHORT.format("c")} AS made FROM j)"""


@query(f"""WITH {NAMED}, s AS (SELECT DISTINCT name, CASE k WHEN 5 THEN made ELSE short END AS short, CASE k WHEN 0 THEN 'listed' WHEN 1 THEN 'listed' WHEN 2 THEN 'head' WHEN 3 THEN 'typo' WHEN 4 THEN 'words' ELSE 'made' END AS how FROM n)
SELECT name, short, how, [short] AS choices FROM s""")
def journal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.resolved(named(spark, sf_dir), journals(spark, sf_dir))


@query(f"""WITH {LIST}, w AS (SELECT DISTINCT a AS w FROM j UNION SELECT b FROM j UNION SELECT c FROM j UNION SELECT d FROM j UNION SELECT 'Journal')
SELECT lower(w) AS word, CASE WHEN w = 'Journal' THEN 'J.' ELSE {_SHORT.format("w")} END AS form, CASE WHEN w <> 'Journal' AND length(w) > 5 THEN lower(left(w, 4)) END AS stem FROM w""")
def journal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.dictionary(journals(spark, sf_dir))


FRONT, BEHIND = "A. Alpha, “Title of it”, ", ", vol. 114, p. 5, May 2015."


@query(f"""WITH {NAMED}, m AS (SELECT * FROM n)
SELECT p_partkey AS ref, length('{FRONT}')::INT AS start, (length('{FRONT}') + length(name))::INT AS "end", name AS before, CASE k WHEN 5 THEN made ELSE short END AS put,
  CASE k WHEN 0 THEN 'listed' WHEN 1 THEN 'listed' WHEN 2 THEN 'head' WHEN 3 THEN 'typo' WHEN 4 THEN 'words' ELSE 'made' END AS how FROM m WHERE name <> CASE k WHEN 5 THEN made ELSE short END""")
def journal_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References read into fields, and their journals as edits to the form that the list has."""
    refs = named(spark, sf_dir).select(F.col("p_partkey").alias("ref"), F.concat(F.lit(FRONT), "name", F.lit(BEHIND)).alias("text"))
    return J.issues(parsing.parsed(refs), journals(spark, sf_dir))
