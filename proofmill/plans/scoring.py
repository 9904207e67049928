"""Scores of proposals against editors' corrections.

The corpus is made of ``lineitem`` whole: parts are papers, lines with a return
flag N are the editors' hunks and all others proposals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofmill.functions import vocabulary as V
from proofmill.operators import scoring
from proofmill.plans.registry import query
from proofmill.session import stash, table

CHECKS = ["FMT-UNIT-01", "CITE-SPACE-01", "FMT-TITLE-02", "FIG-MISSING-01", "NEW-01", "DOI-FMT-01", "PAGE-LIMIT-01"]
CONTEXTS = ["\\title{A beam}", "see \\cite{x}", "Fig. 3", "in the text", "\\usepackage{a}", "plain", "et al"]


def _of(n: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), n)


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Proposals and hunks."""
    items = table(spark, sf_dir, "lineitem")
    n, kind = F.col("l_linenumber").cast("string"), F.round(F.col("l_tax") * 100).cast("int") % 5
    form = F.round(F.col("l_discount") * 100).cast("int") % 4
    tall = F.concat(n, F.lit(" MeV"))
    pid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    proposals = items.filter("l_returnflag <> 'N'").select(
        F.col("l_partkey").alias("paper"), pid.alias("pid"), _of(F.col("l_linenumber"), CHECKS).alias("check_id"), F.when(F.col("l_linestatus") == "O", "auto").otherwise("suggest").alias("tier"),
        F.when(form == 3, F.concat(F.lit("of "), tall)).otherwise(tall).alias("before"),
        F.when(form == 0, F.concat(n, F.lit("~MeV"))).when(form == 1, F.concat(n, F.lit("\\,MeV"))).when(form == 2, F.lit("?")).otherwise(F.concat(F.lit("of "), n, F.lit("~MeV"))).alias("after"),
    )
    hunks = items.filter("l_returnflag = 'N'").select(
        F.col("l_partkey").alias("paper"), pid.alias("idx"), _of(F.col("l_linenumber"), CONTEXTS).alias("context"),
        F.when(kind == 1, F.concat(F.lit("at  "), tall, F.lit(" in"))).when(kind == 2, n).when(kind == 4, F.concat(tall, F.repeat(F.lit(" and so on"), 9))).otherwise(tall).alias("before"),
        F.when(kind == 1, F.concat(F.lit("at "), n, F.lit("~MeV in"))).when(kind == 2, F.concat(n, F.lit("~"))).when(kind == 3, F.concat(n, F.lit(" GeV"))).otherwise(F.concat(n, F.lit("~MeV"))).alias("after"),
    )
    return proposals, hunks


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "][l_linenumber]"


FIXTURE = rf"""
items AS (SELECT *, CAST(l_linenumber AS VARCHAR) AS n, CAST(round(l_tax * 100) AS INT) % 5 AS kind, CAST(round(l_discount * 100) AS INT) % 4 AS form,
  l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_extendedprice AS id FROM lineitem),
proposals AS (SELECT l_partkey AS paper, id AS pid, {_words(CHECKS)} AS check_id, CASE l_linestatus WHEN 'O' THEN 'auto' ELSE 'suggest' END AS tier,
  CASE form WHEN 3 THEN 'of ' || n || ' MeV' ELSE n || ' MeV' END AS before,
  CASE form WHEN 0 THEN n || '~MeV' WHEN 1 THEN n || '\,MeV' WHEN 2 THEN '?' ELSE 'of ' || n || '~MeV' END AS after FROM items WHERE l_returnflag <> 'N'),
hunks AS (SELECT l_partkey AS paper, id AS idx, {_words(CONTEXTS)} AS context,
  CASE kind WHEN 1 THEN 'at  ' || n || ' MeV in' WHEN 2 THEN n WHEN 4 THEN n || ' MeV' || repeat(' and so on', 9) ELSE n || ' MeV' END AS before,
  CASE kind WHEN 1 THEN 'at ' || n || '~MeV in' WHEN 2 THEN n || '~' WHEN 3 THEN n || ' GeV' ELSE n || '~MeV' END AS after FROM items WHERE l_returnflag = 'N')"""

JUDGED = FIXTURE + r""",
p AS (SELECT *, trim(regexp_replace(before, '\s+', ' ', 'g')) AS b1, trim(regexp_replace(after, '\s+', ' ', 'g')) AS a1 FROM proposals),
p2 AS (SELECT *, trim(regexp_replace(replace(replace(replace(b1, '~', ' '), '\,', ' '), '\ ', ' '), '\s+', ' ', 'g')) AS b2, trim(regexp_replace(replace(replace(replace(a1, '~', ' '), '\,', ' '), '\ ', ' '), '\s+', ' ', 'g')) AS a2 FROM p),
h AS (SELECT *, trim(regexp_replace(before, '\s+', ' ', 'g')) AS hb1, trim(regexp_replace(after, '\s+', ' ', 'g')) AS ha1 FROM hunks),
h2 AS (SELECT *, greatest(len(list_filter(string_split(hb1, ' '), lambda w: w <> '')), len(list_filter(string_split(ha1, ' '), lambda w: w <> ''))) > 25 AS large,
  trim(regexp_replace(replace(replace(replace(hb1, '~', ' '), '\,', ' '), '\ ', ' '), '\s+', ' ', 'g')) AS hb2, trim(regexp_replace(replace(replace(replace(ha1, '~', ' '), '\,', ' '), '\ ', ' '), '\s+', ' ', 'g')) AS ha2 FROM h),
met AS (SELECT p2.paper, pid, idx, ha1, CASE WHEN b1 = hb1 AND a1 = ha1 THEN '0exact'
  WHEN b1 <> '' AND a1 <> '' AND contains(hb1, b1) AND contains(ha1, a1) THEN '1inside-hunk' WHEN hb1 <> '' AND ha1 <> '' AND contains(b1, hb1) AND contains(a1, ha1) THEN '1covers-hunk'
  WHEN b2 = hb2 AND a2 = ha2 THEN '2near exact'
  WHEN b2 <> '' AND a2 <> '' AND contains(hb2, b2) AND contains(ha2, a2) THEN '3near inside-hunk' WHEN hb2 <> '' AND ha2 <> '' AND contains(b2, hb2) AND contains(a2, ha2) THEN '3near covers-hunk'
  WHEN NOT large AND hb1 <> '' AND (hb1 = b1 OR (contains(hb1, b1) AND length(hb1) <= 2 * length(b1) + 8)) THEN '4contradicted' END AS how
  FROM p2 JOIN h2 ON p2.paper = h2.paper WHERE length(b1) >= 2 OR length(a1) >= 2),
won AS (SELECT paper, pid, idx, substr(how, 2) AS how, ha1 FROM met WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper, pid ORDER BY substr(how, 1, 1), idx) = 1),
judged AS (SELECT q.*, coalesce(won.how, '') AS how, won.idx AS hunk, CASE WHEN won.how = 'contradicted' THEN substr(ha1, 1, 120) ELSE '' END AS editors_did FROM proposals q LEFT JOIN won USING (paper, pid))"""

HUNKS = JUDGED + """,
seen AS (SELECT h2.*, EXISTS (SELECT 1 FROM judged j WHERE j.paper = h2.paper AND j.hunk = h2.idx) AS explained FROM h2)"""

ZONE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(blob, '{mark}') THEN '{zone}'" for zone, mark in V.ZONE_MARKS) + f" ELSE '{V.BODY}' END"
CHECK_ZONES = f"checks AS (SELECT * FROM {V.values(V.pairs(V.ZONE_OF_CHECK))} t(check_id, zone))"


@query(f"WITH {JUDGED} SELECT paper, pid, check_id, how, hunk, editors_did FROM judged")
def match_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.judge(*parts(spark, sf_dir)).select("paper", "pid", "check_id", "how", "hunk", "editors_did")


BY_CHECK = f"""{JUDGED}, {CHECK_ZONES},
c AS (SELECT check_id, coalesce(any_value(zone), '{V.BODY}') AS zone, count(*) AS proposals, count(*) FILTER (how NOT IN ('', 'contradicted')) AS confirmed, count(*) FILTER (how = 'contradicted') AS contradicted, count(DISTINCT paper) AS papers
  FROM judged LEFT JOIN checks USING (check_id) GROUP BY check_id)"""
READING = f"CASE WHEN proposals < 5 THEN 'too few to say' WHEN zone IN ('{V.BODY}', '{V.FLOATS}') THEN 'editors vary here' WHEN rate >= 0.9 THEN 'strong' WHEN rate >= 0.5 THEN 'mixed' ELSE 'low in a strict zone' END"


@query(f"""WITH {BY_CHECK}, r AS (SELECT *, confirmed / proposals AS rate FROM c)
SELECT *, CASE WHEN contradicted > 0 THEN contradicted || ' contradicted' ELSE {READING} END AS verdict FROM r""")
def score_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_check(scoring.judge(*parts(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    proposals, hunks = parts(spark, sf_dir)
    judged = scoring.judge(proposals, hunks)
    return judged, scoring.explained(judged, hunks)


def judged_once(proposals: DataFrame, hunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scored`` for results that read both of its tables: what was judged is written, else each of them judges all pairs."""
    judged = stash(scoring.judge(proposals, hunks).select("paper", "check_id", "how", "hunk"), "judged")
    return judged, scoring.explained(judged, hunks)


BY_ZONE = f"""{HUNKS}, {CHECK_ZONES},
ours AS (SELECT coalesce(zone, '{V.BODY}') AS zone, count(*) AS proposals, count(*) FILTER (how NOT IN ('', 'contradicted')) AS confirmed, count(*) FILTER (how = 'contradicted') AS contradicted FROM judged LEFT JOIN checks USING (check_id) GROUP BY 1),
theirs AS (SELECT {ZONE_SQL} AS zone, count(*) AS corrections, count(*) FILTER (explained) AS explained FROM (SELECT *, context || ' ' || before || ' ' || after AS blob FROM seen) WHERE NOT large GROUP BY 1),
zones AS (SELECT zone, coalesce(proposals, 0) AS proposals, coalesce(confirmed, 0) AS confirmed, coalesce(contradicted, 0) AS contradicted, coalesce(corrections, 0) AS corrections, coalesce(explained, 0) AS explained FROM ours FULL JOIN theirs USING (zone)),
rated AS (SELECT *, CASE WHEN proposals > 0 THEN confirmed / proposals ELSE 0.0 END AS rate, CASE WHEN corrections > 0 THEN explained / corrections ELSE 0.0 END AS recall FROM zones)"""


@query(f"WITH {BY_ZONE} SELECT * FROM rated")
def score_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_zone(*judged_once(*parts(spark, sf_dir)))


@query(f"""WITH {HUNKS} SELECT (SELECT count(*) FROM judged) AS proposals, (SELECT count(*) FROM judged WHERE how NOT IN ('', 'contradicted')) AS confirmed, (SELECT count(*) FROM judged WHERE how = 'contradicted') AS contradicted,
(SELECT count(*) FROM judged WHERE how = '') AS unconfirmed, (SELECT count(*) FROM seen WHERE NOT large) AS corrections, (SELECT count(*) FROM seen WHERE NOT large AND explained) AS explained""")
def score_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.totals(*judged_once(*parts(spark, sf_dir)))


@query(rf"""WITH {HUNKS} SELECT left(regexp_replace(regexp_replace(trim(before), '[0-9]+', '#', 'g'), '\s+', ' ', 'g'), 60) || ' -> ' || left(regexp_replace(regexp_replace(trim(after), '[0-9]+', '#', 'g'), '\s+', ' ', 'g'), 60) AS signature, count(*) AS n
FROM seen WHERE NOT large AND NOT explained GROUP BY 1 ORDER BY n DESC, signature LIMIT 30""")
def missed_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.missed(scored(spark, sf_dir)[1])


@query(f"""WITH {HUNKS}, named AS (SELECT p_partkey AS paper, nullif(p_brand, 'Brand#1') AS editor FROM part),
e AS (SELECT coalesce(editor, '(unassigned)') AS editor, paper FROM named),
z AS (SELECT editor, {ZONE_SQL} AS zone, count(*) AS n FROM (SELECT *, context || ' ' || before || ' ' || after AS blob FROM seen JOIN e USING (paper)) WHERE NOT large GROUP BY 1, 2),
t AS (SELECT editor, count(*) AS papers, coalesce((SELECT sum(n) FROM z WHERE z.editor = e.editor), 0)::BIGINT AS corrections FROM e GROUP BY editor)
SELECT t.editor, papers, corrections, zone, coalesce(n, 0) AS n, corrections / papers AS per_paper, CASE WHEN corrections > 0 THEN coalesce(n, 0) / corrections ELSE 0.0 END AS share FROM t LEFT JOIN z USING (editor)""")
def score_by_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by editor and zone; brands of parts are the editors, one of them unknown."""
    papers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper"), F.nullif("p_brand", F.lit("Brand#1")).alias("editor"))
    return scoring.by_editor(scored(spark, sf_dir)[1], papers)


@query(f"""WITH {BY_CHECK}, r AS (SELECT check_id, c.zone, tier, count(*) AS proposals, count(*) FILTER (how NOT IN ('', 'contradicted')) / count(*) AS rate, count(*) FILTER (how = 'contradicted') AS contradicted FROM judged JOIN c USING (check_id) GROUP BY 1, 2, 3)
SELECT a.check_id, a.proposals, a.rate, a.contradicted, b.rate AS was_rate, b.contradicted AS was_contradicted, a.proposals >= 30 AND (a.rate < b.rate - 0.03 OR a.contradicted > b.contradicted) AS failed
FROM r a JOIN r b USING (check_id) WHERE a.tier = 'auto' AND b.tier = 'suggest'""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automatic tier's checks against the suggested tier's as a baseline."""
    judged = scoring.judge(*parts(spark, sf_dir))
    now, was = (scoring.by_check(judged.filter(F.col("tier") == t)).select("check_id", "proposals", "rate", "contradicted") for t in ("auto", "suggest"))
    return scoring.gate(now, was, "check_id")


@query(f"""WITH {HUNKS}, n AS (SELECT paper, count(*) FILTER (NOT large) AS n, count(*) FILTER (large) AS large FROM h2 GROUP BY 1)
SELECT count(*) AS papers, CAST(sum(n) AS BIGINT) AS corrections, CAST(sum(large) AS BIGINT) AS large, list_sort(list(n))[CAST(count(*) // 2 AS INT) + 1] AS upper_median FROM n""")
def diff_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers, corrections, rewrites left out, and the upper median of corrections a paper."""
    _, hunks = parts(spark, sf_dir)
    large = scoring.X.is_large(F.col("before"), F.col("after"))
    n = hunks.groupBy("paper").agg(F.count_if(~large).alias("n"), F.count_if(large).alias("large"))
    # The rank of the upper median is found among counts of equal papers, not in a list of all papers.
    counts = n.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(scoring_window().orderBy("n"))
    total = F.sum("m").over(scoring_window())
    median = counts.select("n", (upto > F.floor(total / 2)).alias("reached")).filter("reached").agg(F.min("n").alias("upper_median"))
    return n.agg(F.count(F.lit(1)).alias("papers"), F.sum("n").alias("corrections"), F.sum("large").alias("large")).join(median)


def scoring_window():
    """All rows: used over distinct counts alone, which are few."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


@query(f"WITH {HUNKS} SELECT paper, idx, large, greatest(len(list_filter(string_split(hb1, ' '), lambda w: w <> '')), len(list_filter(string_split(ha1, ' '), lambda w: w <> ''))) AS words, explained AS explained FROM seen")
def hunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks = scored(spark, sf_dir)[1]
    return hunks.select("paper", "idx", "large", scoring.X.hunk_words(F.col("before"), F.col("after")).cast("long").alias("words"), "explained")
