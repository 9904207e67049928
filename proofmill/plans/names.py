"""Names of authors, made from the words of parts' names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.functions import names
from proofmill.operators import authors
from proofmill.plans.registry import query
from proofmill.session import table


@query("""WITH w AS (SELECT p_partkey AS id, p_size % 5 AS n, upper(split_part(p_name, ' ', 1)[1]) || substr(split_part(p_name, ' ', 1), 2) AS a, upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS b FROM part)
SELECT id, CASE n WHEN 0 THEN a WHEN 1 THEN a || ' X.' WHEN 2 THEN a[1] || '.-K.' WHEN 3 THEN a ELSE '' END AS given, CASE n WHEN 3 THEN 'van der ' || b ELSE b END AS family, CASE n WHEN 1 THEN a[1] || 'X' WHEN 2 THEN a[1] || 'K' WHEN 4 THEN '' ELSE a[1] END AS initials FROM w""")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given and family names and initials of five ways to write a name."""
    a, b = (F.initcap(F.element_at(F.split("p_name", " "), i)) for i in (1, 2))
    n = F.col("p_size") % 5
    name = F.when(n == 0, F.concat(a, F.lit("  "), b)).when(n == 1, F.concat(b, F.lit(", "), a, F.lit(" X."))).when(n == 2, F.concat(F.substring(a, 1, 1), F.lit(".-K. "), b)).when(n == 3, F.concat(a, F.lit(" van der "), b)).otherwise(b)
    p = names.split_name(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), p["given"].alias("given"), p["family"].alias("family"), names.initials(p["given"]).alias("initials"))


@query("""SELECT l_orderkey AS paper, CASE WHEN n = 1 THEN l[1] WHEN n = 2 THEN l[1] || ' and ' || l[2] WHEN n > 6 THEN l[1] || ' et al.' ELSE array_to_string(l[: n - 1], ', ') || ', and ' || l[n] END AS authors
FROM (SELECT *, len(l) AS n FROM (SELECT l_orderkey, list(DISTINCT 'A. N' || l_suppkey ORDER BY 'A. N' || l_suppkey) AS l FROM lineitem GROUP BY 1))""")
def author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("A. N"), F.col("l_suppkey").cast("string"))
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_sort(F.collect_set(name)).alias("l"))
    return lists.select("paper", names.listed(F.col("l")).alias("authors"))


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS k FROM lineitem WHERE l_returnflag <> 'A'), t AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS k FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT paper, k, o.k IS NOT NULL AS here, t.k IS NOT NULL AS there FROM o FULL JOIN t USING (paper, k))
SELECT paper, CASE WHEN here THEN 'Anna Näme' || k END AS ours, CASE WHEN there THEN CASE k % 4 WHEN 0 THEN 'Name' || k || ', A. B.' WHEN 1 THEN 'A. Name' || k || ' Jr.' WHEN 2 THEN 'Anna NAME' || k ELSE 'Name' || k || ' Anna' END END AS theirs,
  CASE WHEN here AND there THEN CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 1 END ELSE 0 END AS grade FROM b""")
def matched_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of authors against each other, in four spellings, with what either lacks."""
    people = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("pos"), "l_returnflag")
    k, n = F.col("pos").cast("string"), F.col("pos") % 4
    ours = people.filter("l_returnflag <> 'A'").select("paper", "pos", F.concat(F.lit("Anna Näme"), k).alias("name")).distinct()
    name = F.when(n == 0, F.concat(F.lit("Name"), k, F.lit(", A. B."))).when(n == 1, F.concat(F.lit("A. Name"), k, F.lit(" Jr."))).when(n == 2, F.concat(F.lit("Anna NAME"), k)).otherwise(F.concat(F.lit("Name"), k, F.lit(" Anna")))
    theirs = people.filter("l_returnflag <> 'R'").select("paper", "pos", name.alias("name")).distinct()
    return authors.match(ours, theirs)
