"""Parts as references, and as a registry's records with other spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import registry as R
from proofmill.plans.registry import query
from proofmill.session import spread, table


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    title = F.when(key % 9 == 0, "").otherwise(F.concat_ws(" ", "p_name", "p_type", F.lit("of the beam line")))
    return spread(table(spark, sf_dir, "part")).select(
        key.alias("ref"), title.alias("title"), F.when(key % 7 == 0, "").otherwise(F.col("p_brand")).alias("surname"), F.when(key % 5 > 0, 1990 + F.col("p_size") % 9).alias("year"), F.when(key % 3 > 0, (F.col("p_size") % 4).cast("string")).alias("volume"), F.when(key % 4 > 0, (key % 6).cast("string")).alias("page"),
        F.when(key % 8 == 0, "Proc. X").when(key % 11 == 0, "").otherwise("Phys. Rev.").alias("container"), F.when(key % 8 == 0, "conference").otherwise("journal").alias("kind"), "p_brand", "p_name",
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    title = F.when(key % 10 == 3, F.concat_ws(" ", "p_name", F.lit("something else"))).otherwise(F.concat_ws(" ", "p_name", "p_type", F.lit("of the beam line")))
    return spread(table(spark, sf_dir, "part")).select(
        F.concat(F.lit("10.1/"), key.cast("string")).alias("doi"), title.alias("title"), "p_brand", "p_name", F.col("p_brand").alias("surname"), (1990 + F.col("p_size") % 9 + F.when(key % 6 == 5, 2).otherwise(0)).alias("year"), F.concat(F.lit("v"), (F.col("p_size") % 4).cast("string")).alias("volume"), F.concat((key % 6).cast("string"), F.lit("-99")).alias("page"),
        F.when(key % 13 == 0, "proceedings-article").otherwise("journal-article").alias("type"),
    )


KEYS = ["p_brand", "p_name"]


def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compared_classes(refs(spark, sf_dir), works(spark, sf_dir), KEYS)


PAIRS = """f AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name || ' ' || p_type || ' of the beam line' END AS title, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS surname, CASE WHEN p_partkey % 5 > 0 THEN 1990 + p_size % 9 END AS year, CASE WHEN p_partkey % 3 > 0 THEN (p_size % 4)::VARCHAR END AS volume, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 6)::VARCHAR END AS page, CASE WHEN p_partkey % 8 = 0 THEN 'Proc. X' WHEN p_partkey % 11 = 0 THEN '' ELSE 'Phys. Rev.' END AS container, CASE WHEN p_partkey % 8 = 0 THEN 'conference' ELSE 'journal' END AS kind, p_brand, p_name FROM part),
w AS (SELECT '10.1/' || p_partkey AS doi, p_name || CASE WHEN p_partkey % 10 = 3 THEN ' something else' ELSE ' ' || p_type || ' of the beam line' END AS title, p_brand AS surname, 1990 + p_size % 9 + CASE WHEN p_partkey % 6 = 5 THEN 2 ELSE 0 END AS year, (p_size % 4)::VARCHAR AS volume, (p_partkey % 6)::VARCHAR AS page, CASE WHEN p_partkey % 13 = 0 THEN 'proceedings-article' ELSE 'journal-article' END AS type, p_brand, p_name FROM part),
j AS (SELECT f.*, w.doi, w.title AS wt, w.surname AS ws, w.year AS wy, w.volume AS wv, w.page AS wp, w.type, list_distinct(regexp_extract_all(lower(f.title), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(w.title), '[a-z0-9]+')) AS b FROM f JOIN w USING (p_brand, p_name)),
s AS (SELECT *, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS likeness, len(regexp_extract_all(lower(title), '[a-z0-9]+')) < 4 AS short FROM j),
pairs AS (SELECT ref, doi, likeness,
  CASE WHEN year IS NULL AND container = '' AND volume IS NULL THEN 'too little to check' WHEN title <> '' AND likeness < CASE WHEN short THEN 0.95 ELSE 0.85 END THEN 'title' WHEN title = '' AND NOT (volume IS NOT NULL AND page IS NOT NULL AND surname <> '' AND year IS NOT NULL) THEN 'too little to be sure'
    WHEN surname <> '' AND lower(surname) <> lower(ws) THEN 'author' WHEN abs(year - wy) > 1 THEN 'year' WHEN volume <> wv THEN 'volume' WHEN page <> wp THEN 'page' WHEN container = 'Proc. X' AND type = 'journal-article' THEN 'kind' WHEN kind = 'journal' AND type = 'proceedings-article' THEN 'kind' ELSE '' END AS reason,
  CASE WHEN title <> '' AND likeness < 0.5 THEN 'title' WHEN title = '' AND surname <> '' AND lower(surname) <> lower(ws) THEN 'author' WHEN abs(year - wy) > 1 THEN 'year' WHEN volume <> wv THEN 'volume' WHEN page <> wp THEN 'page' ELSE '' END AS doubt,
  2 * (likeness >= 0.85)::INT + (surname <> '' AND lower(surname) = lower(ws))::INT + coalesce(year = wy, false)::INT + coalesce(volume = wv, false)::INT + coalesce(page = wp, false)::INT AS points FROM s),
found AS (SELECT ref, doi FROM (SELECT *, row_number() OVER o AS n, lead(likeness) OVER o AS next FROM pairs WHERE reason = '' WINDOW o AS (PARTITION BY ref ORDER BY likeness DESC, doi)) WHERE n = 1 AND (next IS NULL OR likeness - next > 0.1))"""


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def record_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compared(refs(spark, sf_dir), works(spark, sf_dir), KEYS)


@query(f"WITH {PAIRS} SELECT * FROM found")
def records_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.found_in_classes(class_pairs(spark, sf_dir))


@query(f"""WITH {PAIRS} SELECT ref, place::INT AS place, doi, points FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY points DESC, likeness DESC, doi) AS place FROM pairs WHERE likeness >= 0.75 AND points >= 3 AND ref NOT IN (SELECT ref FROM found)) WHERE place <= 3""")
def possible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = class_pairs(spark, sf_dir)
    return R.possible_in_classes(p, R.found_in_classes(p))


@query(f"""WITH {PAIRS}, given AS (SELECT ref, '10.1/' || CASE ref % 4 WHEN 0 THEN ref + 1 WHEN 1 THEN ref * 100000 ELSE ref END AS doi FROM f)
SELECT g.ref, g.doi, CASE WHEN g.ref % 6 = 0 AND NOT starts_with(g.doi, '10.1/9') AND g.doi IN (SELECT doi FROM w) THEN 'not checked' WHEN g.doi NOT IN (SELECT doi FROM w) THEN 'unresolved' WHEN p.doubt IS NULL THEN 'wrong' WHEN p.doubt = '' THEN 'right' ELSE 'wrong' END AS status FROM given g LEFT JOIN pairs p ON p.ref = g.ref AND p.doi = g.doi""".replace("g.ref % 6 = 0 AND NOT starts_with(g.doi, '10.1/9') AND g.doi IN (SELECT doi FROM w)", "g.doi IN (SELECT doi FROM w) AND substr(g.doi, 6)::BIGINT % 6 = 0"))
def doi_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the DOIs that references give; every sixth record couldn't be asked about."""
    ref = F.col("ref")
    given = refs(spark, sf_dir).select("ref", F.concat(F.lit("10.1/"), F.when(ref % 4 == 0, ref + 1).when(ref % 4 == 1, ref * 100000).otherwise(ref).cast("string")).alias("doi"))
    records = works(spark, sf_dir)
    known = records.select("doi", (F.regexp_extract("doi", "/([0-9]+)$", 1).cast("long") % 6 != 0).alias("reachable"))
    return R.verdicts(given, records, R.compared_given(given, refs(spark, sf_dir), records, KEYS), known)


@query()
def title_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best similarity of each reference's title among the records of its kind."""
    return R.best_similarity(refs(spark, sf_dir), works(spark, sf_dir), KEYS)
