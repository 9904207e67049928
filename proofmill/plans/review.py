"""Queries of the review desk and the scorer, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import ordered, texts
from proofmill.plans.registry import query
from proofmill.session import table


@query("""
WITH f AS (SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2)
SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS place FROM f
""")
def first_appearance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.appearance(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("""
SELECT user_id, event_id, ts, CAST(age_rank AS INT) AS age_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age_rank FROM events) WHERE age_rank <= 5
""")
def retain_last_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", 5, "ts", "event_id")


@query("""
WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2
""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "30 MINUTES")


@query("""
WITH e AS (SELECT user_id, ts AS start_ts, ts + INTERVAL 2 HOUR AS end_ts FROM events),
m AS (SELECT *, CASE WHEN start_ts <= max(end_ts) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM e),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS span FROM m)
SELECT user_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n FROM s GROUP BY user_id, span
""")
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_ts"))
    return ordered.merged_spans(spans, "user_id", "start_ts", "end_ts")


@query("""
SELECT doc_id, first_id, sha256 FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256) AS first_id, sha256 FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents)) WHERE doc_id = first_id
""")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; partial minima are taken before the shuffle, so that copies weigh nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("first_id")).select(F.col("first_id").alias("doc_id"), "first_id", "sha256")


@query("""
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS tag, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1
""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("tag"))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("""
SELECT user_id, event_id AS claim, ts FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def first_claim_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest claim of each key; a partial minimum, no window."""
    claims = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return claims.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("c")).select("user_id", F.col("c.event_id").alias("claim"), F.col("c.ts").alias("ts"))


@query("""
WITH f AS (SELECT user_id, k, min((ts, event_id)) AS first FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY 1, 2)
SELECT user_id, k, highest FROM (SELECT *, max(k) OVER (PARTITION BY user_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM f) WHERE k < highest
""")
def citations_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers first cited after a higher one."""
    cited = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return ordered.out_of_order(cited, "user_id", "k", "ts", "event_id")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice)::INT AS expected FROM lineitem)
SELECT * FROM r WHERE l_linenumber <> expected QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY expected) <= 5
""")
def misnumbered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose number isn't their place in the list, five of each list."""
    return ordered.misnumbered(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""
SELECT o_custkey, CASE WHEN count(o_orderstatus) >= 3 AND min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS answer, count(o_orderstatus) AS votes FROM orders GROUP BY 1
""")
def unanimous_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.unanimous(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("""
WITH listed AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), cited AS (SELECT l_orderkey, l_partkey, min(l_shipdate) AS rank FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank NULLS LAST, pos, l_partkey)::INT AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, l_partkey)::INT AS now FROM (SELECT l_orderkey, l_partkey, pos * 100000 + l_partkey AS pos, rank FROM listed LEFT JOIN cited USING (l_orderkey, l_partkey)))
SELECT l_orderkey, l_partkey, pos, place, place <> now AS moved FROM p
""")
def reorder_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each listed part belongs: in the order in which the returned ones were shipped, then as listed."""
    items = table(spark, sf_dir, "lineitem")
    listed = items.groupBy("l_orderkey", "l_partkey").agg((F.min("l_linenumber") * 100_000 + F.col("l_partkey")).alias("pos"))
    cited = items.filter("l_returnflag <> 'N'").groupBy("l_orderkey", "l_partkey").agg(F.min("l_shipdate").alias("rank"))
    return ordered.reordered(listed, cited, "l_orderkey", "l_partkey")


@query("""
SELECT l_orderkey, 'N' || lpad((coalesce(max(l_partkey) FILTER (l_returnflag = 'N'), 0) + 1)::VARCHAR, greatest(3, length((coalesce(max(l_partkey) FILTER (l_returnflag = 'N'), 0) + 1)::VARCHAR))::INT, '0') AS next_id FROM lineitem GROUP BY 1
""")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").withColumn("name", F.concat("l_returnflag", F.col("l_partkey").cast("string")))
    return ordered.next_id(named, "l_orderkey", "name", "N")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS cited, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey + 1 AND o_orderstatus = 'F')) AS unresolved FROM lineitem l GROUP BY 1, 2
""")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations without an entry: lines whose next order isn't finished."""
    entries = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") - 1).alias("l_orderkey"), F.lit(True).alias("there"))
    both = table(spark, sf_dir, "lineitem").join(entries, "l_orderkey", "left")
    return both.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("there").isNull()).alias("unresolved"))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS uri FROM pages), u AS (SELECT DISTINCT page_id, trim(uri) AS uri FROM l WHERE regexp_matches(trim(uri), '^(?i)https?://') AND NOT regexp_matches(trim(uri), '^(?i)https?://(dx\.)?doi\.org/') UNION SELECT page_id, url FROM pages)
SELECT regexp_replace(uri, '[?#].*$', '') AS uri, list_sort(list(DISTINCT page_id))[1] AS first_page, count(DISTINCT page_id) AS n_pages FROM u GROUP BY 1
""")
def link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that aren't DOIs, with their pages; a page's own address counts as one."""
    pages = table(spark, sf_dir, "pages")
    uri = F.trim("uri")
    links = pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("uri"))
    links = links.filter(uri.rlike("^(?i)https?://") & ~uri.rlike(r"^(?i)https?://(dx\.)?doi\.org/")).select("page_id", uri.alias("uri")).unionByName(pages.select("page_id", F.col("url").alias("uri")))
    bare = links.select("page_id", F.regexp_replace("uri", "[?#].*$", "").alias("uri")).distinct()
    return bare.groupBy("uri").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n_pages"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([a-z])\.', '\1', 'g'), ' ') AS ws FROM documents)),
a AS (SELECT doc_id, i, upper(ws[i]) AS acronym, i % 9 = 0 AS expanded FROM w WHERE regexp_matches(ws[i], '^[A-Z][a-z]$'))
SELECT doc_id, acronym, min(i)::INT AS first, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) >= 2 AND NOT arg_min(expanded, i) AND acronym NOT IN ('IT', 'OF', 'UN')
""")
def acronym_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms used twice or more that aren't expanded where they come first, but for well-known ones.

    These texts have no acronyms: capitalised words of two letters play them, and a place divisible by nine an expansion.
    """
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([a-z])\.", "$1"), " ")
    used = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("i", "w")).filter("w rlike '^[A-Z][a-z]$'")
    used = used.select("doc_id", F.upper("w").alias("acronym"), (F.col("i") + 1).alias("pos"), ((F.col("i") + 1) % 9 == 0).alias("expanded"))
    return texts.acronyms(used, ["IT", "OF", "UN"])
