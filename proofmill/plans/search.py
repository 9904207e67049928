"""References and records of all parts, searched by spelling and by title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import search
from proofmill.plans.registry import query
from proofmill.plans.registry_records import PAIRS, refs, works
from proofmill.session import table


@query("""WITH l AS (SELECT p_partkey AS ref, '10.1103/PR' || (p_partkey * 7) AS doi FROM part), r AS (SELECT DISTINCT '10.1103/PR' || (p_partkey * 11) AS found FROM part)
SELECT ref, doi, found FROM l JOIN r ON abs(length(doi) - length(found)) <= 1 AND damerau_levenshtein(doi, found) = 1 WHERE doi NOT IN (SELECT found FROM r)""")
def near_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose DOI is one slip from one that no record has."""
    doi = lambda m: F.concat(F.lit("10.1103/PR"), (F.col("p_partkey") * m).cast("string")).alias("doi")
    parts = table(spark, sf_dir, "part")
    return search.near_records(parts.select(F.col("p_partkey").alias("ref"), doi(7)), parts.select(doi(11)))


ALIKE = f"""{PAIRS.split("j AS (SELECT")[0].rstrip().rstrip(",")},
fw AS (SELECT ref, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS a FROM f), ww AS (SELECT doi, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS b FROM w),
c AS (SELECT ref, doi, count(*) AS n FROM (SELECT ref, unnest(a) AS t FROM fw) JOIN (SELECT doi, unnest(b) AS t FROM ww) USING (t) GROUP BY 1, 2),
alike AS (SELECT ref, doi, n / (len(a) + len(b) - n) AS likeness FROM c JOIN fw USING (ref) JOIN ww USING (doi) WHERE n * 1000 >= 800 * (len(a) + len(b) - n))"""


@query(f"WITH {ALIKE} SELECT DISTINCT f.title AS \"left\", w.title AS \"right\", likeness FROM alike JOIN f USING (ref) JOIN w USING (doi)")
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of references and of records that share four fifths of their words."""
    return search.similar_titles(refs(spark, sf_dir), works(spark, sf_dir), 0.8)


@query(f"""WITH {ALIKE}, l AS (SELECT ref, CASE WHEN ref % 3 > 0 THEN 'IPAC' || ref % 4 ELSE '' END AS label, CASE WHEN ref % 10 = 0 THEN '10.1/' || ref END AS doi FROM f), o AS (SELECT doi, CASE WHEN length(doi) % 2 = 0 THEN 'IPAC' || right(doi, 1)::INT % 4 ELSE '' END AS own FROM w),
fits AS (SELECT ref, a.doi, likeness FROM alike a JOIN l USING (ref) JOIN o ON o.doi = a.doi WHERE l.doi IS NULL AND NOT (label <> '' AND own <> '' AND label <> own) AND likeness >= CASE WHEN label <> '' AND label = own THEN 0.85 ELSE 0.93 END)
SELECT ref, doi, 1.0::DOUBLE AS likeness FROM l WHERE doi IS NOT NULL UNION ALL SELECT ref, arg_min(doi, (-likeness, doi)), max(likeness) FROM fits GROUP BY ref""")
def papers_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference's record by DOI or by title, with conferences that may not contradict one another."""
    ref = F.col("ref")
    label = F.when(ref % 3 > 0, F.concat(F.lit("IPAC"), (ref % 4).cast("string"))).otherwise("")
    asked = refs(spark, sf_dir).select("ref", "title", label.alias("label"), F.when(ref % 10 == 0, F.concat(F.lit("10.1/"), ref.cast("string"))).alias("doi"))
    own = F.when(F.length("doi") % 2 == 0, F.concat(F.lit("IPAC"), (F.right("doi", F.lit(1)).cast("int") % 4).cast("string"))).otherwise("")
    return search.papers_by_title(asked, works(spark, sf_dir).select("doi", "title", own.alias("label")))
