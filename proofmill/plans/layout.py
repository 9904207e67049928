"""Pages of rendered papers, from lines of orders: an order is a paper, its line numbers are pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofmill.operators import layout
from proofmill.plans.registry import query
from proofmill.session import table

PAGES = "CASE WHEN count(DISTINCT {p}) = 1 THEN 'page ' ELSE 'pages ' END || array_to_string(list_sort(list(DISTINCT {p}))[:8], ', ') || CASE WHEN count(DISTINCT {p}) > 8 THEN ' …' ELSE '' END"


def _items(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("page"), *more)


@query(f"""WITH b AS (SELECT l_orderkey AS paper, l_linenumber AS page, CASE l_returnflag WHEN 'N' THEN 595.0 WHEN 'A' THEN 612.0 ELSE 597.9 END AS width, CASE WHEN l_quantity < 25 THEN 792.0 ELSE 841.9 END AS height FROM lineitem)
SELECT paper, width::DOUBLE AS width, height::DOUBLE AS height, {PAGES.format(p='page')} AS pages FROM b WHERE abs(width - 595) > 3 OR abs(height - 792) > 3 GROUP BY 1, 2, 3""")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    w = F.when(flag == "N", 595.0).when(flag == "A", 612.0).otherwise(597.9)
    return layout.sizes(_items(spark, sf_dir, w.alias("width"), F.when(F.col("l_quantity") < 25, 792.0).otherwise(841.9).alias("height")))


@query(f"""WITH b AS (SELECT l_orderkey AS paper, l_linenumber AS page, CASE WHEN l_quantity > 45 THEN 'left' WHEN l_quantity > 40 THEN 'right' WHEN l_quantity > 30 THEN 'top' WHEN l_quantity > 15 THEN 'bottom' END AS side, CASE WHEN l_returnflag = 'A' THEN 'word' ELSE '- 7' END AS text FROM lineitem),
o AS (SELECT * FROM b WHERE side IS NOT NULL), p AS (SELECT paper, page, bool_and(side IN ('top', 'bottom') AND text <> 'word') AS bare FROM o GROUP BY 1, 2),
f AS (SELECT DISTINCT paper, page, CASE WHEN bare THEN 'PDF-PAGENUM-01' ELSE 'PDF-MARGIN-01' END AS finding, CASE WHEN bare THEN '' ELSE side END AS side FROM o JOIN p USING (paper, page))
SELECT paper, finding, side, {PAGES.format(p='page')} AS pages FROM f GROUP BY 1, 2, 3""")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    box = lambda name, bad, good, hit: F.when(hit, bad).otherwise(good).alias(name)
    left, right, top, bottom = q > 45, (q > 40) & (q <= 45), (q > 30) & (q <= 40), (q > 15) & (q <= 30)
    return layout.outside(_items(spark, sf_dir, box("x0", 20.0, 60.0, left), box("x1", 590.0, 500.0, right), box("top", 20.0, 100.0, top), box("bottom", 780.0, 700.0, bottom), F.when(F.col("l_returnflag") == "A", "word").otherwise("- 7").alias("text")))


@query(f"""WITH b AS (SELECT l_orderkey AS paper, l_linenumber AS page, 'Font' || (l_partkey % 4) AS font, CASE WHEN l_returnflag = 'A' THEN 'Type3' ELSE 'Type1' END AS subtype, l_linestatus = 'O' AS embedded, l_quantity > 10 AS in_use FROM lineitem),
f AS (SELECT *, CASE WHEN subtype = 'Type3' THEN 'PDF-FONT-02' WHEN NOT embedded AND in_use THEN 'PDF-FONT-01' END AS finding FROM b)
SELECT paper, font, finding, {PAGES.format(p='page')} AS pages FROM f WHERE finding IS NOT NULL GROUP BY 1, 2, 3""")
def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "ABCDEF+").otherwise(""), F.lit("Font"), (F.col("l_partkey") % 4).cast("string"))
    return layout.fonts(_items(spark, sf_dir, name.alias("font"), F.when(F.col("l_returnflag") == "A", "Type3").otherwise("Type1").alias("subtype"), (F.col("l_linestatus") == "O").alias("embedded"), (F.col("l_quantity") > 10).alias("in_use")))


@query(f"""WITH b AS (SELECT l_orderkey AS paper, l_linenumber AS page, '10.1/x' || (l_partkey % 3) AS doi, CAST(round_even(l_quantity / 20, 0) AS INT) AS top, l_partkey % 5 AS k FROM lineitem),
two AS (SELECT paper, doi, page FROM b GROUP BY 1, 2, 3 HAVING min(top) <> max(top)),
cut AS (SELECT paper, CASE k WHEN 0 THEN 'doi:' WHEN 1 THEN '10.1/' ELSE '10.1/ab-' END AS doi, page FROM b WHERE k < 3), f AS (SELECT * FROM two UNION SELECT * FROM cut)
SELECT paper, doi, {PAGES.format(p='page')} AS pages FROM f GROUP BY 1, 2""")
def split_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    links = _items(spark, sf_dir, F.concat(F.lit("https://doi.org/10.1/x"), (F.col("l_partkey") % 3).cast("string")).alias("uri"), (F.col("l_quantity") / 20).alias("top"))
    lines = _items(spark, sf_dir, F.when(k == 0, "see doi: ").when(k == 1, "x doi:10.1/").when(k == 2, "DOI: 10.1/ab-").otherwise("doi:10.1/whole").alias("line"))
    return layout.split_dois(links, lines)


@query("""WITH n AS (SELECT l_orderkey AS paper, max(l_linenumber) AS n_pages, min(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS refs_at, max(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS heading_at FROM lineitem GROUP BY 1)
SELECT paper, n_pages, coalesce(refs_at, n_pages) AS body_pages, CASE WHEN n_pages <= 4 THEN '' WHEN n_pages > 5 THEN 'too long' WHEN refs_at IS NULL AND coalesce(heading_at, 0) < 5 OR refs_at < 5 THEN 'references only' ELSE 'too long' END AS over FROM n""")
def page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.over_limit(_items(spark, sf_dir, (F.col("l_returnflag") == "A").alias("has_references"), (F.col("l_linestatus") == "F").alias("has_heading")), 4)


@query("""WITH f AS (SELECT l_orderkey AS paper, l_quantity::INT || 'MeV' AS original FROM lineitem)
SELECT paper, count(*) AS n, array_to_string(list_sort(list(DISTINCT original))[:5], '; ') AS examples FROM f GROUP BY 1""")
def unit_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units without a space: how many, and five examples."""
    return layout.rolled_up(_items(spark, sf_dir, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("MeV")).alias("original")))
