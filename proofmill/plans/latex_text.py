"""LaTeX sources made of parts as plain text, and names found in the text traced to the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import latex_text
from proofmill.plans.registry import query
from proofmill.session import dealt, spread, table

SOURCE = "% NAME is not printed\n\\section{On \\emph{NAME}}\\label{x}G\\\"ottingen, \\v{C}ern\\'y, \\AA{}ngstr\\\"{o}m and \\o{}re---``NAME''~5\\,\\% \\href{http://a.b/NAME}{NAME}\\cite[p.~1]{NAME} $E=mc^2$"
TEXT = "On NAMEGöttingen, Černý, Ångström and øre—“NAME” 5 % NAME E=mc^2"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("file"), F.replace(F.lit(SOURCE), F.lit("NAME"), F.col("p_name")).alias("text"))


def _sql(text: str) -> str:
    return "replace('" + text.replace("'", "''") + "', 'NAME', p_name)"


@query(f"SELECT p_partkey AS file, {_sql(TEXT)} AS text FROM part")
def latex_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex_text.texts(sources(spark, sf_dir)).select("file", "text")


@query(f"SELECT p_partkey AS file, 3 AS start, 3 + length(p_name)::INT AS end, p_name AS found FROM part UNION ALL SELECT p_partkey, 3 + length(p_name)::INT, 12 + length(p_name)::INT, 'G\\\"ottingen' FROM part")
def latex_sources_of_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first printed name and the word with an accent after it, as they stand in the source."""
    docs = sources(spark, sf_dir)
    n = F.length(F.col("p_name"))
    cut = F.array(F.struct(F.lit(3).alias("start"), (n + 3).alias("end")), F.struct((n + 3).alias("start"), (n + 12).alias("end")))
    spans = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("file"), F.explode(cut).alias("s")).select("file", "s.*")
    found = dealt(latex_text.in_source(spans, docs), "file").join(dealt(docs, "file"), "file")
    return found.select("file", "start", "end", F.substring(F.col("text"), F.col("from") + 1, F.col("to") - F.col("from")).alias("found"))
