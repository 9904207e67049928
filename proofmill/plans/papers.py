"""The corpus index: orders are papers, their lines the files of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.functions import vocabulary as V
from proofmill.operators import papers
from proofmill.plans.registry import query
from proofmill.session import table

ENDINGS = [".tex", ".docx", ".pdf", ".tex", ".bib", ".tex", ".png"]
TAGS = ["TC12", "TC06", "FC02", "QA01", "ZZ99", "TC08", "MP02"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("paper"), F.when(F.col("l_linestatus") == "O", "original").otherwise("current").alias("role"), F.col("l_linenumber").alias("name"),
        F.element_at(F.array(*map(F.lit, ENDINGS)), F.col("l_linenumber")).alias("ext"), F.ceil(F.col("l_quantity") / 20).alias("size"), F.col("l_returnflag").alias("sha"),
    )


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"))


FILES = f"""files AS (SELECT l_orderkey AS paper, CASE l_linestatus WHEN 'O' THEN 'original' ELSE 'current' END AS role, l_linenumber AS name, {ENDINGS}[l_linenumber] AS ext, CAST(ceil(l_quantity / 20) AS BIGINT) AS size, l_returnflag AS sha FROM lineitem)"""
JUDGED = f"""{FILES}, kinds AS (SELECT * FROM {V.values(list(V.KIND_OF_ENDING.items()))} t(ext, kind)),
main AS (SELECT paper, role, size, sha, kind FROM files JOIN kinds USING (ext) QUALIFY row_number() OVER (PARTITION BY paper, role ORDER BY size DESC, name, sha DESC, kind DESC) = 1),
o AS (SELECT * FROM main WHERE role = 'original'), c AS (SELECT * FROM main WHERE role = 'current'),
n AS (SELECT o_orderkey AS paper, (SELECT count(*) FROM files f WHERE f.paper = o_orderkey AND role = 'original') AS no, (SELECT count(*) FROM files f WHERE f.paper = o_orderkey AND role = 'current') AS nc FROM orders),
judged AS (SELECT n.paper, coalesce(o.kind, c.kind, CASE WHEN no + nc > 0 THEN 'no-source' ELSE 'missing' END) AS kind, no > 0 AND nc > 0 AS paired,
  CASE WHEN no > 0 AND nc > 0 THEN o.size <> c.size OR o.sha <> c.sha END AS changed,
  CASE WHEN no = 0 THEN 'nothing submitted' WHEN nc = 0 THEN 'only one revision' WHEN o.kind IS NULL OR c.kind IS NULL THEN 'no source file' WHEN o.kind <> c.kind THEN 'format changed: ' || o.kind || ' to ' || c.kind WHEN o.size = c.size AND o.sha = c.sha THEN 'unchanged' ELSE '' END AS reason
  FROM n LEFT JOIN o USING (paper) LEFT JOIN c USING (paper))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.usability(_papers(spark, sf_dir), _files(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT *, reason = '' AS usable FROM judged")
def usable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


@query(f"WITH {JUDGED} SELECT kind, count(*) AS n FROM judged WHERE reason = '' GROUP BY 1")
def corpus_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("usable").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JUDGED} SELECT reason, count(*) AS n FROM judged WHERE reason <> '' GROUP BY 1")
def unusable_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("not usable").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {JUDGED}, u AS (SELECT * FROM judged WHERE reason = '')
SELECT 'all pairs' AS family, count(*) AS pairs FROM u UNION ALL SELECT 'LaTeX source checks', count(*) FILTER (kind = 'latex') FROM u UNION ALL SELECT 'Word checks', count(*) FILTER (kind = 'word') FROM u UNION ALL SELECT 'reference and DOI checks', count(*) FROM u""")
def measurable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.sample(_judged(spark, sf_dir))


@query(f"""WITH {JUDGED} SELECT count(*) FILTER (reason = '') || ' usable of ' || count(*) || ': ' || count(*) FILTER (reason = '' AND kind = 'latex') || ' LaTeX, ' || count(*) FILTER (reason = '' AND kind = 'word') || ' Word' AS line FROM judged""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.summary(_judged(spark, sf_dir))


TAGGED = f"tagged AS (SELECT DISTINCT l_orderkey AS paper, {TAGS}[l_linenumber] AS code FROM lineitem)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, TAGS)), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.collect_set(code).alias("codes"))


@query(f"WITH {JUDGED}, {TAGGED} SELECT code, count(*) AS papers FROM tagged JOIN judged USING (paper) WHERE reason = '' GROUP BY 1")
def usable_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _tagged(spark, sf_dir).select("paper", F.explode("codes").alias("code"))
    return tagged.join(_judged(spark, sf_dir).filter("usable"), "paper", "left_semi").groupBy("code").agg(F.count(F.lit(1)).alias("papers"))


@query(f"""WITH {TAGGED}, checks AS (SELECT code, list_sort(list(check_id)) AS checks FROM {V.values(V.pairs(V.CHECKS_OF_TAG))} t(check_id, code) GROUP BY 1), gaps AS (SELECT * FROM {V.values(V.pairs(V.GAPS_OF_TAG))} t(code, gap)),
weights AS (SELECT * FROM {V.values(list(V.STATUS_WEIGHT.items()))} t(status, weight)),
r AS (SELECT code, count(*) AS papers, any_value(checks) AS checks, CASE WHEN code IN {tuple(V.SERVICE_TAGS)} THEN 'the editing service' WHEN any_value(checks) IS NOT NULL AND any_value(gap) IS NULL THEN 'covered' ELSE coalesce(any_value(gap), 'editor''s judgement') END AS status
  FROM tagged LEFT JOIN checks USING (code) LEFT JOIN gaps USING (code) GROUP BY code)
SELECT code, papers, status, CASE WHEN status IN ('covered', 'partly covered') THEN array_to_string(checks[:4], ', ') ELSE '' END AS checks, weight * 10000 - papers AS priority FROM r JOIN weights USING (status)""")
def tag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.tag_report(_tagged(spark, sf_dir))


@query(f"WITH {TAGGED} SELECT paper, t.code, max(n_nationkey) AS tag_id FROM tagged t LEFT JOIN (SELECT n_nationkey, {TAGS}[n_regionkey + 1] AS code FROM nation) live USING (code) WHERE t.code NOT IN {tuple(V.SERVICE_TAGS)} GROUP BY 1, 2")
def tag_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes resolved against an event's own tags; nations stand for these."""
    live = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tag_id"), F.element_at(F.array(*map(F.lit, TAGS)), F.col("n_regionkey") + 1).alias("code"))
    return papers.tag_ids(_tagged(spark, sf_dir).select("paper", F.explode("codes").alias("code")), live)


CHECK_IDS = ["FMT-UNIT-01", "DOI-FMT-01", "NEW-01", "CITE-LINK-01", "FMT-UNIT-02", "BUILD-FAIL", "AUTH-01"]


@query(f"""WITH f AS (SELECT l_orderkey AS paper, {CHECK_IDS}[l_linenumber] AS check_id FROM lineitem), m AS (SELECT * FROM {V.values(V.pairs(V.CHECKS_OF_TAG))} t(check_id, code)), v AS (SELECT * FROM {V.values([(c, i) for i, c in enumerate(V.TAG_CODES)])} t(code, place)),
d AS (SELECT DISTINCT paper, code, place FROM f JOIN m USING (check_id) JOIN v USING (code))
SELECT paper, array_to_string(list(code ORDER BY place), ' ') AS codes FROM d GROUP BY 1""")
def proposed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.element_at(F.array(*map(F.lit, CHECK_IDS)), F.col("l_linenumber")).alias("check_id"))
    return papers.proposed_tags(found).select("paper", F.array_join("codes", " ").alias("codes"))


REVISIONS = "revisions AS (SELECT l_orderkey AS paper, l_partkey AS rev, l_shipdate AS created, CAST(l_quantity AS BIGINT) % 3 AS n_files FROM lineitem)"


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("rev"), F.col("l_shipdate").alias("created"), (F.col("l_quantity").cast("long") % 3).alias("n_files"))


def _plan_sql(role: str) -> str:
    return f"""WITH {REVISIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY created, rev, n_files) AS up, count(*) OVER (PARTITION BY paper) AS n FROM revisions WHERE n_files > 0)
SELECT paper, rev, created, role FROM (SELECT *, {role} AS role FROM r) WHERE role IS NOT NULL"""


@query(_plan_sql("CASE WHEN up = 1 THEN 'original' WHEN up = n THEN 'current' END"))
def pull_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.plan(_revisions(spark, sf_dir)).select("paper", "rev", "created", "role")


@query(_plan_sql("CASE WHEN up = n THEN 'current' END"))
def pull_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.plan(_revisions(spark, sf_dir), "latest").select("paper", "rev", "created", "role")


@query(_plan_sql("'revision-' || up"))
def pull_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.plan(_revisions(spark, sf_dir), "all").select("paper", "rev", "created", "role")


PRESENT = f"{FILES}, planned AS (SELECT DISTINCT paper, name, size FROM files), present AS (SELECT DISTINCT paper, name, CASE sha WHEN 'R' THEN size - 1 ELSE size END AS size FROM files WHERE ext <> '.png')"


def _present(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, sf_dir)
    return files.select("paper", "name", "size").distinct(), files.filter("ext <> '.png'").select("paper", "name", F.when(F.col("sha") == "R", F.col("size") - 1).otherwise(F.col("size")).alias("size"))


@query(f"WITH {PRESENT} SELECT * FROM planned EXCEPT SELECT * FROM present")
def files_to_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.to_pull(*_present(spark, sf_dir))


@query(f"WITH {PRESENT} SELECT p.paper, bool_and(q.paper IS NOT NULL) AS complete FROM planned p LEFT JOIN present q USING (paper, name, size) GROUP BY 1")
def complete_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("paper", "name", "size")
    return papers.complete(files, _present(spark, sf_dir)[1])


@query(f"""WITH {FILES} SELECT paper, CASE WHEN bool_or(ext = '.tex') THEN 'latex' WHEN bool_or(ext IN ('.docx', '.doc', '.odt', '.rtf')) THEN 'word' ELSE 'unknown' END AS format FROM files GROUP BY 1""")
def source_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = papers.kind_of(F.col("ext"))
    return _files(spark, sf_dir).groupBy("paper").agg(F.when(F.bool_or(F.coalesce(kind == "latex", F.lit(False))), "latex").when(F.bool_or(F.coalesce(kind == "word", F.lit(False))), "word").otherwise("unknown").alias("format"))
