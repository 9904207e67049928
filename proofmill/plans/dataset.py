"""Corrections between revisions of documents, and training pairs from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.functions import texts as X
from proofmill.operators import dataset, hunks, scoring
from proofmill.plans.registry import query
from proofmill.plans.scoring import judged_once
from proofmill.session import spread, stash, table


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions of each document: lines are paragraphs, and the second has ties, a changed word, and a paragraph less."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    before = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    after = F.regexp_replace(F.regexp_replace(before, r" of ", " of~"), r"\bthe ", "The ")
    after = F.regexp_replace(after, r"\n\n[^\n]{1,30}\n\n", "\n\n")
    return docs.select(F.col("doc_id").alias("paper"), before.alias("before"), after.alias("after"))


@query()
def paragraph_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunks.hunks(revisions(spark, sf_dir))


@query()
def hunk_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each small correction recurs."""
    found = hunks.hunks(revisions(spark, sf_dir))
    small = found.filter(~X.is_large(F.col("before"), F.col("after")))
    return small.groupBy(X.signature(F.col("before"), F.col("after")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query()
def scored_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties proposed after of, scored by zone against the hunks of real alignments."""
    pairs = revisions(spark, sf_dir)
    found = stash(hunks.hunks(pairs), "hunks")
    words = pairs.select("paper", F.posexplode(F.regexp_extract_all("before", F.lit(r"of [a-z]+"), F.lit(0))).alias("pid", "before"))
    proposals = words.select("paper", "pid", F.lit("FMT-UNIT-01").alias("check_id"), F.lit("auto").alias("tier"), "before", F.replace("before", F.lit(" "), F.lit("~")).alias("after"))
    return scoring.by_zone(*judged_once(proposals, found))


@query(r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS unit, p AS paragraph FROM (
SELECT doc_id, i, trim(regexp_replace(ps[i], '\s+', ' ', 'g')) AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '\.\n', '. ' || chr(10) || '  ' || chr(10), 'g'), '\n[ \t]*\n+') AS ps FROM documents))) WHERE p <> ''""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks between blank lines, on one line each; a line that ends in a full stop is given a blank one after it."""
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), r"\.\n", ". \n  \n")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.paragraphs_of(spaced)).alias("unit", "paragraph")).withColumn("unit", F.col("unit") + 1)


SHA_PLACE = "CAST(('0x' || substr(h, 1, 8))::BIGINT % 1000 AS BIGINT)"
for _i in range(1, 8):
    SHA_PLACE = f"(({SHA_PLACE}) * 296 + ('0x' || substr(h, {8 * _i + 1}, 8))::BIGINT) % 1000"


@query(f"""SELECT source, CASE WHEN source = 'src3' THEN 'test' WHEN {SHA_PLACE} < 100 THEN 'eval' ELSE 'train' END AS split, count(*) AS n FROM (SELECT doc_id, source, sha256(doc_id::VARCHAR) AS h FROM documents) GROUP BY 1, 2""")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source by split; one source is the test set."""
    split = dataset.split_of(F.col("doc_id"), 0.10, F.col("source") == "src3")
    return table(spark, sf_dir, "documents").groupBy("source", split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as references of two revisions, renumbered in the second."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("label")).agg(F.min(F.struct("l_partkey", "l_returnflag", "l_linestatus")).alias("r"))
    name = F.when(F.col("r.l_returnflag") == "A", "A. Alpha").when(F.col("r.l_returnflag") == "R", "B. T. Beta").otherwise("untitled")
    words = F.concat_ws(" ", name, F.lit("part"), F.concat(F.lit("no"), (F.col("r.l_partkey") % 5).cast("string")), F.concat(F.lit("book"), (F.col("r.l_partkey") % 3).cast("string")), F.lit("vol"))
    old = items.select("paper", "label", words.alias("text"))
    new = items.select("paper", F.when(F.col("r.l_linestatus") == "F", F.col("label")).otherwise(8 - F.col("label")).alias("label"), F.concat(words, F.when(F.col("label") > 3, " edited now").otherwise("")).alias("text"))
    return old, new.groupBy("paper", "label").agg(F.min("text").alias("text"))


@query()
def paired_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.pair(*_references(spark, sf_dir))


REFS = """r AS (SELECT l_orderkey AS paper, l_linenumber AS label, min({'a': l_partkey, 'b': l_returnflag, 'c': l_linestatus}) AS r FROM lineitem GROUP BY 1, 2),
o AS (SELECT paper, label, r, CASE r.b WHEN 'A' THEN 'A. Alpha' WHEN 'R' THEN 'B. T. Beta' ELSE 'untitled' END || ' part no' || (r.a % 5) || ' book' || (r.a % 3) || ' vol' AS text FROM r),
n AS (SELECT paper, label, min(text) AS text FROM (SELECT paper, CASE r.c WHEN 'F' THEN label ELSE 8 - label END AS label, text || CASE WHEN label > 3 THEN ' edited now' ELSE '' END AS text FROM o) GROUP BY 1, 2)"""


@query(f"""WITH {REFS}, w AS (SELECT o.paper, o.label, lower(regexp_extract(o.text, '^\\s*(?:(?:[A-Z][a-z]?\\.\\s?-?)+\\s?)?([A-Z][a-z]+)', 1)) AS os, lower(regexp_extract(n.text, '^\\s*(?:(?:[A-Z][a-z]?\\.\\s?-?)+\\s?)?([A-Z][a-z]+)', 1)) AS ns,
  list_distinct(regexp_extract_all(lower(o.text), '[a-z0-9]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(n.text), '[a-z0-9]{{3,}}')) AS b FROM o JOIN n USING (paper, label)),
s AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM w)
SELECT paper, label, os AS old_surname, ns AS new_surname, similarity, NOT (os <> '' AND ns <> '' AND os <> ns) AND similarity >= CASE WHEN os <> '' AND ns <> '' THEN 0.25 ELSE 0.45 END AS same FROM s""")
def reference_sameness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what stands under one label is one reference."""
    old, new = _references(spark, sf_dir)
    both = old.join(new.withColumnRenamed("text", "new"), ["paper", "label"]).select("paper", "label", dataset.surname(F.col("text")).alias("old_surname"), dataset.surname(F.col("new")).alias("new_surname"), dataset.similarity(dataset.word_set(F.col("text")), dataset.word_set(F.col("new"))).alias("similarity"))
    known = (F.col("old_surname") != "") & (F.col("new_surname") != "")
    return both.withColumn("same", ~(known & (F.col("old_surname") != F.col("new_surname"))) & (F.col("similarity") >= F.when(known, dataset.SAME_LABEL).otherwise(dataset.OTHER_LABEL)))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    whole = F.coalesce("text", F.lit(""))
    return docs.select("source", "doc_id", whole.alias("raw"), F.when(F.length("text") % 3 == 0, whole).otherwise(F.concat(whole, F.lit("!"))).alias("final"))


ROWS = r"""rows_ AS (SELECT source, doc_id, coalesce(text, '') AS raw, CASE WHEN length(text) % 3 = 0 THEN coalesce(text, '') ELSE coalesce(text, '') || '!' END AS final FROM documents),
forms AS (SELECT *, sha256(lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) || chr(0) || lower(trim(regexp_replace(final, '\s+', ' ', 'g')))) AS fingerprint FROM rows_),
once AS (SELECT * FROM forms QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY source, doc_id) = 1)"""


@query(f"WITH {ROWS} SELECT * FROM once")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal pairs; whole documents play references, and two of three get a mark in the second revision."""
    return dataset.dedupe(_rows(spark, sf_dir), ["source", "doc_id"])


@query(f"""WITH {ROWS}, c AS (SELECT CAST(floor(count(*) * 0.15 / 0.85) AS BIGINT) AS n FROM once WHERE raw <> final)
SELECT source, doc_id, raw FROM (SELECT *, row_number() OVER (ORDER BY md5('7-' || doc_id), doc_id) AS i FROM once WHERE raw = final) WHERE i <= (SELECT n FROM c)""")
def unchanged_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = dataset.dedupe(_rows(spark, sf_dir), ["source", "doc_id"])
    return dataset.capped(once.filter("raw = final"), once.filter("raw <> final"), "doc_id", 0.15, 7).select("source", "doc_id", "raw")


@query(f"""WITH {ROWS}, c AS (SELECT source, count(*) AS pairs FROM rows_ GROUP BY 1), d AS (SELECT source, count(*) AS kept, count(*) FILTER (raw = final) AS unchanged FROM once GROUP BY 1)
SELECT source, pairs, coalesce(kept, 0) AS kept, pairs - coalesce(kept, 0) AS duplicates, coalesce(unchanged, 0) AS unchanged FROM c LEFT JOIN d USING (source)""")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    once = dataset.dedupe(rows, ["source", "doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("raw") == F.col("final")).alias("unchanged"))
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("pairs")).join(once, "source", "left").fillna(0, ["kept", "unchanged"])
    return out.withColumn("duplicates", F.col("pairs") - F.col("kept"))


@query("""SELECT o_orderkey, 'Style.' AS system, 'Reference:' || chr(10) || o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN '' ELSE chr(10) || chr(10) || 'Record:' || chr(10) || '{"doi":"10.1/' || o_custkey || '","status":"' || o_orderstatus || '"}' END AS "user", upper(o_orderpriority) AS assistant FROM orders""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a training row; the record's keys are in order, and empty and private ones are left out."""
    filled = F.when(F.col("o_orderstatus") != "P", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("_cache"), F.lit("x"), F.lit("empty"), F.lit(""), F.lit("doi"), F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", dataset.messages("Style.", F.col("o_orderpriority"), F.upper("o_orderpriority"), filled).alias("m"))
    return made.select("o_orderkey", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"), F.col("m")[2]["content"].alias("assistant"))


@query(r"""WITH a AS (SELECT p_brand, p_name AS gold, p_type AS raw, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.' WHEN 2 THEN p_type ELSE ' ' || replace(p_name, ' ', '   ') END AS answer, p_size % 3 > 0 AS safe FROM part),
s AS (SELECT *, trim(regexp_replace(answer, '\s+', ' ', 'g')) AS said FROM a)
SELECT p_brand, count(*) AS examples, round(avg((said = gold)::INT), 3) AS exact, round(avg((rtrim(said, '.') = rtrim(gold, '.'))::INT), 3) AS loose, round(avg(safe::INT), 3) AS safe, round(avg((safe AND said <> raw)::INT), 3) AS offered FROM s GROUP BY 1""")
def answer_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 4
    answer = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat("p_name", F.lit("."))).when(n == 2, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("   "))))
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("gold"), F.col("p_type").alias("raw"), answer.alias("answer"), (F.col("p_size") % 3 > 0).alias("safe"))
    return dataset.answers(rows, "p_brand")
