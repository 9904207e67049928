"""Files of the desk: the corpus index, edit sets, decisions, review states, rule packs and pasted lists.

Every reader has a declared schema and takes a corrupt file as one without values,
beside its text in ``corrupt``; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

INDEX = "event_id long, papers array<struct<code: string, contribution_id: long, friendly_id: long, title: string, state: string, editor: string, tags: array<struct<code: string>>>>"
EDIT = "struct<id: string, check_id: string, tier: string, confidence: string, file: string, start: int, end: int, before: string, after: string, message: string, line: int, context_before: string, context_after: string>"
EDIT_SET = f"file string, source_sha256 string, edits array<{EDIT}>"
STATE = "schema_version int, paper_id string, status string, editor string, decisions map<string, string>, edited_by array<struct<id: long, name: string>>, qa struct<status: string, by: string, at: string, note: string>, hold struct<since: string, until: string, reason: string>"
PACK = "pack string, version string, rules array<struct<id: string, category: string, applies_to: array<string>, title: string, text: string>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fields = f"{schema}, corrupt string"
    return spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def corpus_index(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, code, title, state, editor, tags): one row a paper; a paper without a code goes by its number."""
    rows = _json(spark, path, INDEX).select("event_id", F.explode("papers").alias("p"))
    code = F.coalesce(F.nullif("p.code", F.lit("")), F.concat(F.lit("c"), F.col("p.friendly_id").cast("string")))
    return rows.select("event_id", code.alias("code"), "p.contribution_id", "p.title", "p.state", F.nullif("p.editor", F.lit("")).alias("editor"), F.transform("p.tags", lambda t: t["code"]).alias("tags"))


def side_files(spark: SparkSession, root: str) -> DataFrame:
    """(paper, role, name, ext, size, sha) of the files below ``root``/paper/role/Source_Files; contents are digested where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = lambda i: F.regexp_extract("path", r"/([^/]+)/(original|current)/Source_Files/([^/]+)$", i)
    found = files.select(at(1).alias("paper"), at(2).alias("role"), at(3).alias("name"), F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))
    return found.filter("paper <> ''")


def edit_sets(spark: SparkSession, path: str) -> DataFrame:
    """One row an edit, with its file's digest."""
    return _json(spark, path, EDIT_SET).select(F.col("source_sha256"), F.explode("edits").alias("e")).select("source_sha256", "e.*")


def decisions(raw: Column) -> Column:
    """The map of decisions in a JSON text, whether wrapped or bare."""
    wrapped = F.from_json(raw, "decisions map<string, string>")["decisions"]
    return F.coalesce(wrapped, F.from_json(raw, "map<string, string>"))


def review_states(spark: SparkSession, path: str) -> DataFrame:
    """States of papers; what a broken file lacks is new and empty."""
    rows = _json(spark, path, STATE)
    return rows.withColumns({"status": F.coalesce("status", F.lit("new")), "decisions": F.coalesce("decisions", F.create_map().cast("map<string,string>")), "broken": F.col("corrupt").isNotNull()})


def latest_pack(spark: SparkSession, path: str) -> DataFrame:
    """Rules of each pack's last version, one row a rule."""
    packs = _json(spark, path, PACK)
    last = packs.groupBy("pack").agg(F.max("version").alias("version"))
    return packs.join(last, ["pack", "version"]).select("pack", "version", F.explode("rules").alias("r")).select("pack", "version", "r.*")


def search(rules: DataFrame, words: str, category: str | None = None, applies_to: str | None = None) -> DataFrame:
    """Rules of a category, for a kind of paper, that hold every word somewhere."""
    blob = F.lower(F.to_json(F.struct(*rules.columns)))
    found = rules.filter(F.forall(F.array(*[F.lit(w) for w in words.lower().split()]).cast("array<string>"), lambda w: F.contains(blob, w)))
    if category:
        found = found.filter(F.col("category") == category)
    return found.filter(F.array_contains("applies_to", applies_to)) if applies_to else found


def pasted(lists: DataFrame, key: str, text: str, most: int = 200) -> DataFrame:
    """(key, pos, reference, truncated): entries of pasted lists between blank lines or before numbers, the first ``most``."""
    entries = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n|\n(?=\s*\[[0-9]+\])"), lambda e: F.trim(F.regexp_replace(e, r"\s+", " "))), lambda e: e != "")
    return lists.select(key, (F.size(entries) > most).alias("truncated"), F.posexplode(F.slice(entries, 1, most)).alias("pos", "reference"))


def write_splits(rows: DataFrame, path: str, by: str = "split") -> None:
    """Rows as JSON lines, a folder for each split."""
    rows.write.mode("overwrite").partitionBy(by).json(path)
