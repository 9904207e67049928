"""Sources of papers: each part is a paper whose source has the usual slips, picked by its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from proofmill.functions import latex as L, texts as X
from proofmill.operators import links
from proofmill.plans.registry import query
from proofmill.session import spread, table

PIECES = [
    ["\\documentclass[a4paper, keeplastbox]{jacow} % jacow v2.7\n", "\\documentclass[letterpaper]{jacow}\n", "\\documentclass{article}\n% JACoW 3.1\n"],
    ["\\title{ON %s.}\n", "\\title{On %s}\n", "\\title{%s:;}\n"],
    ["\\author{A. Alpha, CERN}\n", "\\author{Anna Alpha, CERN}\n"],
    ["\\begin{abstract}We cite \\cite{a}.\\end{abstract}\n", "\\begin{abstract}Short.\\end{abstract}\n"],
    ["\\section{1. Beam}\n", "\\section{Beam}\n"],
    ["At 5 MeV and 3GHz, see \\cite{a} \\cite{b} and [1], [2].\n", "At 7~MeV or 8 mev, as Figure 3 and Tab. 2 show \\cite{ c, a}.\n", "In 2 ghz, from equation (4), Smith et al have \\cite{d}, \\cite{a,b}.\n"],
    ["\\includegraphics[width=1]{fig/%k.png}\\caption{Fig. 1. A beam}\n", "\\includegraphics{two}\\caption{Figure 1: A beam.}\n", ""],
    ["\\begin{thebibliography}{9}\n\\bibitem{a} A. Alpha, \\url{doi:10.1/%k}\n\\bibitem[x]{b} B. Beta, in Proc. X, unpublished\n\\end{thebibliography}\n", "\\begin{thebibliography}{9}\n\\bibitem{b} \\url{https://doi.org/10.1/%k}\n\\bibitem{a} DOI: 10.1/%k, submitted to X\n\\end{thebibliography}\n", "\\bibliographystyle{plain}\\bibliography{refs, more}\n"],
]


def _sql_pick(words: list[str], n: int) -> str:
    made = "CASE p_partkey * " + f"{n + 3} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"
    return f"replace(replace({made}, '%s', p_name), '%k', p_partkey::VARCHAR)"


SOURCES = "src AS (SELECT p_partkey AS paper, " + " || ".join(_sql_pick(words, n) for n, words in enumerate(PIECES)) + " AS text FROM part)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (key * (n + 3) % len(words) + 1).cast("int"))
    made = F.concat(*[F.replace(F.replace(pick(words, n), F.lit("%s"), F.col("p_name")), F.lit("%k"), key.cast("string")) for n, words in enumerate(PIECES)])
    return spread(table(spark, sf_dir, "part")).select(key.alias("paper"), made.alias("text"))


def _sub(c: str, k: L.Check) -> str:
    put = k.put.replace("\\\\", "\\\\").replace("$", "\\")
    return f"regexp_replace({c}, '{k.pattern}', '{put}', 'g')"


def _hits() -> str:
    out = []
    for check_id in dict.fromkeys(k.check_id for k in L.CHECKS):
        own = [k for k in L.CHECKS if k.check_id == check_id]
        hit = " OR ".join(f"regexp_matches(text, '{k.pattern}')" if k.put == "$0" else f"{_sub('text', k)} <> text" for k in own)
        out.append(f"SELECT paper, '{check_id}' AS check_id, '{own[0].tier}' AS tier FROM src WHERE {hit}")
    return " UNION ALL ".join(out)


@query(f"WITH {SOURCES} {_hits()}")
def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.checked(sources(spark, sf_dir), "paper", "text")


def _steps(*tiers: str) -> str:
    own = [k for k in L.CHECKS if k.tier in tiers]
    steps = ", ".join(f"s{i + 1} AS (SELECT paper, {_sub('text', k)} AS text FROM s{i})" for i, k in enumerate(own))
    return f"WITH {SOURCES}, s0 AS (SELECT * FROM src), {steps} SELECT paper, text FROM s{len(own)}"


@query(_steps("auto"))
def auto_corrected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("paper", L.corrected(F.col("text"), "auto").alias("text"))


@query(_steps("auto", "suggest"))
def corrected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("paper", L.corrected(F.col("text"), "auto", "suggest").alias("text"))


CITED = SOURCES + r""", c AS (SELECT paper, list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '\\cite[a-z]*\{([^}]*)\}', 1), lambda g: string_split(g, ','))), lambda k: trim(k)), lambda k: k <> ''), lambda k: k) AS ks FROM src),
cited AS (SELECT paper, i - 1 AS place_at, ks[i] AS key FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM c)),
b AS (SELECT paper, string_split_regex(string_split(text, '\end{thebibliography}')[1], '\\bibitem')[2:] AS ps FROM src),
listed AS (SELECT paper, i::INT AS pos, regexp_extract(ps[i], '^(?:\[[^\]]*\])?\{([^}]*)\}', 1) AS key, trim(regexp_replace(regexp_replace(ps[i], '^(?:\[[^\]]*\])?\{[^}]*\}', ''), '\s+', ' ', 'g')) AS body FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM b))"""


def _cited(src: DataFrame) -> DataFrame:
    return src.select("paper", F.posexplode(L.citations(F.col("text"))).alias("at", "key"))


def _listed(src: DataFrame) -> DataFrame:
    return src.select("paper", F.posexplode(L.bibitems(F.col("text"))).alias("i", "b")).select("paper", (F.col("i") + 1).alias("pos"), "b.key", "b.body")


@query(f"WITH {CITED} SELECT * FROM listed")
def bibitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(sources(spark, sf_dir))


@query(f"WITH {CITED} SELECT paper, key, row_number() OVER (PARTITION BY paper ORDER BY min(place_at))::INT AS place, count(*) AS uses FROM cited GROUP BY paper, key")
def citation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited keys by their first use."""
    of = _cited(sources(spark, sf_dir)).groupBy("paper", "key").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("uses"))
    return of.select("paper", "key", F.row_number().over(Window.partitionBy("paper").orderBy("at")).alias("place"), "uses")


@query(f"""WITH {CITED}, broken AS (SELECT paper FROM src WHERE contains(text, 'bibliography{{refs')), u AS (SELECT DISTINCT paper, key FROM cited c WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.paper = c.paper AND l.key = c.key)),
m AS (SELECT paper, key, count(*) OVER (PARTITION BY paper) AS m FROM u) SELECT paper, CASE WHEN m > 2 AND paper IN (SELECT paper FROM broken) THEN NULL ELSE key END AS key, count(*) AS n FROM m GROUP BY 1, 2""")
def unresolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sources(spark, sf_dir)
    broken = src.filter(F.size(L.resources(F.col("text"))) > 0)
    return links.unresolved(_cited(src), _listed(src), broken)


@query(f"""WITH {CITED}, f AS (SELECT paper, key, min(place_at) AS first_at FROM cited GROUP BY 1, 2), j AS (SELECT paper, key, row_number() OVER (PARTITION BY paper ORDER BY pos)::INT AS place, row_number() OVER (PARTITION BY paper ORDER BY first_at)::INT AS rank FROM listed JOIN f USING (paper, key)) SELECT * FROM j WHERE place <> rank""")
def misplaced_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sources(spark, sf_dir)
    return links.positions(_listed(src).select("paper", "key", "pos"), _cited(src))


@query(f"""WITH {SOURCES}, n AS (SELECT paper, unnest(regexp_extract_all(text, '\\\\includegraphics(?:\\[[^\\]]*\\])?\\{{([^}}]*)\\}}', 1)) AS name FROM src)
SELECT paper, name, CASE WHEN name = 'two' THEN CASE WHEN paper % 3 = 0 THEN 'present' WHEN paper % 4 = 0 THEN 'archived' ELSE 'missing' END WHEN paper % 2 = 0 THEN 'present' ELSE 'missing' END AS state FROM n""")
def figure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named figures that are there, in an archive, or missing."""
    src = sources(spark, sf_dir)
    named = src.select("paper", F.explode(L.graphics(F.col("text"))).alias("name"))
    files = src.filter("paper % 2 = 0").select("paper", F.concat(F.lit("a/"), F.col("paper").cast("string"), F.lit(".PDF")).alias("name")).unionByName(src.filter("paper % 3 = 0").select("paper", F.lit("TWO.eps").alias("name")))
    return links.figures(named, files, src.filter("paper % 4 = 0").select("paper", F.lit("two.png").alias("name")))


@query(f"""WITH {SOURCES} SELECT paper, CASE WHEN contains(text, 'v2.7') THEN '2.7' WHEN contains(text, 'JACoW 3.1') THEN '3.1' END AS version, CASE WHEN contains(text, '[a4paper') THEN 'a4paper keeplastbox' WHEN contains(text, '[letterpaper') THEN 'letterpaper' ELSE '' END AS options,
CASE WHEN contains(text, 'bibliography{{refs') THEN 'refs more' ELSE '' END AS resources, contains(text, 'thebibliography') AS has_list FROM src""")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's version and options, and where the references are."""
    c = F.col("text")
    return sources(spark, sf_dir).select("paper", L.class_version(c).alias("version"), F.array_join(L.class_options(c), " ").alias("options"), F.array_join(L.resources(c), " ").alias("resources"), (F.size(L.bibitems(c)) > 0).alias("has_list"))


# Marks of the types of entries.
TYPES = [("proceedings_unpublished", "presented at|this conference|unpublished"), ("proceedings", r"in proc\.|proc\.\s+\w"), ("journal", r"phys\. rev|j\. phys|nucl\. instrum|ieee trans"), ("thesis", r"ph\.?d\.?\s+thesis|master.s?\s+thesis"), ("report", r"rep\.|technical report"), ("online", r"\\url\{http|https?://"), ("arxiv", "arxiv")]


def entry_type(c: Column) -> Column:
    out = None
    for name, mark in TYPES:
        hit = F.lower(X.text(c)).rlike(mark)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


@query(f"WITH {CITED} SELECT paper, pos, CASE " + " ".join(f"WHEN regexp_matches(lower(body), '{mark}') THEN '{name}'" for name, mark in TYPES) + " ELSE 'unknown' END AS type FROM listed")
def entry_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(sources(spark, sf_dir)).select("paper", "pos", entry_type(F.col("body")).alias("type"))
