"""Sources made of parts, with measurements in and out of protected text; brands play conferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import edits as E, protected
from proofmill.plans.registry import query
from proofmill.session import spread, table

# Pieces of a source, each with its edit in the form of a tie and of a macro, or without one.
PIECES = [
    ("HEAD\nA beam of ", None, None), ("K MeV", "K~MeV", "FMT-UNIT-01"), (" on NAME at ", None, None), ("K mev", "K~mev", "FMT-UNIT-01"), (", \\% gone % not K kV here\n$K mm$ and ", None, None),
    ("K\\,mhz", "K\\,MHz", "FMT-UNIT-02"), (", K~GHz, Fig.~K A, \\begin{equation}K nm\\end{equation}\\cite{K m} \\verb|K cm| ", None, None), ("K \\%", "K~\\%", "FMT-UNIT-01"),
    (" of MACRO, K xyz and ", None, None), ("K  mhz", "K~MHz", "FMT-UNIT-02"), ("\n\\begin{thebibliography}{9}\\bibitem{a}K pC\\end{thebibliography}", None, None),
]
SPANS = [("% not K kV here", "comment"), ("$K mm$", "inline"), ("\\begin{equation}K nm\\end{equation}", "environment"), ("\\cite{K m}", "argument"), ("\\verb|K cm|", "verbatim"), ("\\begin{thebibliography}{9}\\bibitem{a}K pC\\end{thebibliography}", "references")]
HEAD, MACRO, TIES = "\\usepackage{siunitx}", "\\qty{1}{m}, \\qty{2}{m}, \\SI{3}{m}", "1~m"


def _duck(t: str) -> str:
    made = "'" + t.replace("'", "''") + "'"
    for mark, value in (("HEAD", f"CASE WHEN p_partkey % 2 = 0 THEN '{HEAD}' ELSE '' END"), ("MACRO", f"CASE WHEN p_partkey % 2 = 0 THEN '{MACRO}' ELSE '{TIES}' END"), ("NAME", "p_name"), ("K", "CAST(p_size AS VARCHAR)")):
        if mark in t:
            made = f"replace({made}, '{mark}', {value})"
    return made


TEXT = "".join(p[0] for p in PIECES)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.replace(F.lit(TEXT), F.lit("HEAD"), F.when(key % 2 == 0, HEAD).otherwise(""))
    text = F.replace(text, F.lit("MACRO"), F.when(key % 2 == 0, MACRO).otherwise(TIES))
    text = F.replace(F.replace(text, F.lit("NAME"), F.col("p_name")), F.lit("K"), F.col("p_size").cast("string"))
    return spread(table(spark, sf_dir, "part")).select(key.alias("file"), F.col("p_brand").alias("conference"), text.alias("text"))


SRC = f"src AS (SELECT p_partkey, p_brand, p_name, p_size, {_duck(TEXT)} AS text FROM part)"


@query(f"WITH {SRC} " + " UNION ALL ".join(f"SELECT p_partkey AS file, strpos(text, {_duck(t)})::INT - 1 AS start, (strpos(text, {_duck(t)}) - 1 + length({_duck(t)}))::INT AS \"end\", '{kind}' AS kind FROM src" for t, kind in SPANS) + f" UNION ALL SELECT p_partkey, 0, {len(HEAD)}, 'argument' FROM src WHERE p_partkey % 2 = 0")
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protected.protected_spans(sources(spark, sf_dir))


# A brand's sources with macros have three in macros and one tie (K~GHz); the others two ties.
STYLES = "styles AS (SELECT p_brand, CASE WHEN sum(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END) > sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END) THEN 'macro' WHEN sum(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END) < sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END) THEN 'tie' ELSE 'auto' END AS style FROM src GROUP BY 1)"


@query(f"WITH {SRC}, {STYLES} SELECT p_brand AS conference, style FROM styles")
def house_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protected.house_styles(sources(spark, sf_dir), "conference")


def _edits(styled: bool) -> str:
    out, head = [], ""
    for text, after, check_id in PIECES:
        if after:
            unit = after.split("~")[-1].split(",")[-1]
            tie = _duck(after)
            macro = tie if unit == "\\%" else f"'\\qty{{' || p_size || '}}{{{unit}}}'"
            use = "p_partkey % 2 = 0" + (" AND style <> 'tie'" if styled else "")
            out.append(f"SELECT p_partkey AS file, length({_duck(head)})::INT AS start, length({_duck(head + text)})::INT AS \"end\", {_duck(text)} AS before, CASE WHEN {use} THEN {macro} ELSE {tie} END AS after, '{check_id}' AS check_id, 60 AS priority, '{'auto' if check_id.endswith('1') else 'suggest'}' AS tier FROM src{' JOIN styles USING (p_brand)' if styled else ''}")
        head += text
    return " UNION ALL ".join(out)


@query(f"WITH {SRC} {_edits(False)}")
def unit_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protected.unit_edits(sources(spark, sf_dir).drop("conference"))


@query(f"WITH {SRC}, {STYLES} {_edits(True)}")
def house_unit_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's edits in the style that most sources of its conference have; the styles, a row for each conference, go to the sources."""
    docs = sources(spark, sf_dir)
    return protected.unit_edits(docs.join(F.broadcast(protected.house_styles(docs, "conference")), "conference").select("file", "text", "style"))


@query(f"WITH {SRC}, w AS (SELECT p_partkey, text, strpos(text, p_name) - 1 AS i, length(p_name) AS n FROM src) SELECT p_partkey AS file, i::INT AS start, (i + n)::INT AS \"end\" FROM w")
def edits_outside_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a word-like match may be edited: of each source's names and numbered units, those that no protected text holds."""
    docs = sources(spark, sf_dir)
    made = E.pattern_edits(docs, r"(?<= on )[a-z]+ [a-z]+(?= at )|(?<=\{)[0-9]+ [a-z]+(?=\})|(?<=\$)[0-9]+ mm", "x", "ANY-01", 1)
    return protected.outside(made, protected.protected_spans(docs)).select("file", "start", "end")
