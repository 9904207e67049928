"""Pages of rendered papers: sizes, margins, page numbers, fonts, split links and limits, grouped by what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WIDTH, HEIGHT, TOLERANCE = 595.0, 792.0, 3.0
MM = 72 / 25.4
SIDE, TOP = 20 * MM, 19 * MM


def page_list(pages: Column) -> Column:
    """The first eight distinct pages in order, and a mark if there are more."""
    p = F.array_sort(pages)
    return F.concat(F.when(F.size(p) == 1, "page ").otherwise("pages "), F.array_join(F.slice(p, 1, 8).cast("array<string>"), ", "), F.when(F.size(p) > 8, " …").otherwise(""))


def sizes(pages: DataFrame) -> DataFrame:
    """(paper, width, height, pages) of pages that aren't of the template's size."""
    w, h = F.bround("width", 1), F.bround("height", 1)
    wrong = (F.abs(w - WIDTH) > TOLERANCE) | (F.abs(h - HEIGHT) > TOLERANCE)
    return pages.filter(wrong).groupBy("paper", w.alias("width"), h.alias("height")).agg(page_list(F.collect_set("page")).alias("pages"))


def outside(boxes: DataFrame, slack: float = 3.0) -> DataFrame:
    """(paper, finding, side, pages): text beyond the margins by side, or page numbers, where a page has nothing else there.

    ``boxes``: paper, page, x0, x1, top, bottom, text.
    """
    side = F.when(F.col("x0") < SIDE - slack, "left").when(F.col("x1") > WIDTH - SIDE + slack, "right").when(F.col("top") < TOP - slack, "top").when(F.col("bottom") > HEIGHT - TOP + slack, "bottom")
    out = boxes.withColumn("side", side).filter("side is not null")
    number = F.col("side").isin("top", "bottom") & F.col("text").rlike(r"^[-–]?\s*[0-9]{1,4}\s*[-–]?$")
    numbers = out.groupBy("paper", "page").agg(F.bool_and(number).alias("only"), F.collect_set("side").alias("sides"))
    found = F.when(F.col("only"), F.array(F.struct(F.lit("PDF-PAGENUM-01").alias("finding"), F.lit("").alias("side")))).otherwise(F.transform("sides", lambda s: F.struct(F.lit("PDF-MARGIN-01").alias("finding"), s.alias("side"))))
    return numbers.select("paper", "page", F.explode(found).alias("f")).groupBy("paper", "f.finding", "f.side").agg(page_list(F.collect_set("page")).alias("pages"))


def fonts(used: DataFrame) -> DataFrame:
    """(paper, font, finding, pages): fonts of type 3, and fonts in use that aren't embedded; a subset's tag isn't part of the name."""
    name = F.regexp_replace("font", r"^[A-Z]{6}\+", "")
    finding = F.when(F.col("subtype") == "Type3", "PDF-FONT-02").when(~F.col("embedded") & F.col("in_use"), "PDF-FONT-01")
    return used.select("paper", name.alias("font"), finding.alias("finding"), "page").filter("finding is not null").groupBy("paper", "font", "finding").agg(page_list(F.collect_set("page")).alias("pages"))


def split_dois(links: DataFrame, lines: DataFrame) -> DataFrame:
    """(paper, doi, pages): DOIs whose link stands on two lines of a page, or whose line ends before they do."""
    doi = F.regexp_extract("uri", r"(?i)^\s*https?://(?:dx\.)?doi\.org/(\S+)", 1)
    tops = links.withColumn("doi", doi).filter("doi <> ''").groupBy("paper", "page", "doi").agg(F.min(F.bround("top")).alias("low"), F.max(F.bround("top")).alias("high"))
    two = tops.filter("low <> high").select("paper", "doi", "page")
    end = F.regexp_extract(F.rtrim("line"), r"(?i)doi:\s*(10\.\S*)?$", 1)
    cut = (end == "") | ~end.contains("/") | end.rlike(r"[-./_]$")
    broken = lines.filter(F.rtrim("line").rlike(r"(?i)doi:\s*(10\.\S*)?$")).withColumn("doi", end).filter(cut).select("paper", F.when(F.col("doi") == "", "doi:").otherwise(F.col("doi")).alias("doi"), "page")
    return two.unionByName(broken).groupBy("paper", "doi").agg(page_list(F.collect_set("page")).alias("pages"))


def over_limit(pages: DataFrame, limit: int) -> DataFrame:
    """(paper, n_pages, body_pages, over): one page beyond the limit is allowed, for references that begin within it.

    Where no list of references is found, a heading on that page speaks for text.
    ``pages``: paper, page, has_references, has_heading.
    """
    n = pages.groupBy("paper").agg(F.max("page").alias("n_pages"), F.min(F.when(F.col("has_references"), F.col("page"))).alias("refs_at"), F.max(F.when(F.col("has_heading"), F.col("page"))).alias("heading_at"))
    body = F.coalesce("refs_at", "n_pages")
    return n.select("paper", "n_pages", body.alias("body_pages"), F.when(F.col("n_pages") <= limit, "").when(F.col("n_pages") > limit + 1, "too long").when(F.col("refs_at") <= limit, "references only").when(F.col("refs_at").isNotNull() | F.coalesce(F.col("heading_at") > limit, F.lit(False)), "too long").otherwise("references only").alias("over"))


def rolled_up(found: DataFrame, most: int = 5) -> DataFrame:
    """(paper, n, examples): how often, and the first distinct examples in order of text; ``found``: paper, original."""
    per = found.groupBy("paper", "original").agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy("paper").agg(F.sum("m").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("original")), 1, most), "; ").alias("examples"))
