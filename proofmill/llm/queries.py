"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from proofmill.llm import ann, bpe, chat, conversation_repair, decontamination, divergence, mixing, nbsvm, near_duplicates, pii, quality_rules, sharding, toxicity
from proofmill.session import stash, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op1_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stash(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    m = mixing.mix(sized, "size").select("doc_id", f"{mixing.STRUCT}.*")
    ordered = m.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op6_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op10_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_survivor_coalescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows)


def op13_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES |= {f.__name__: f for f in (op1_naive_bayes_svm, op2_bounded_ring_shards, op3_curriculum_mix, op4_levenshtein_toxicity, op5_perspective_rotation, op6_grouped_prefix_join, op7_host_quality_rules, op8_weak_supervision_pii, op9_adaptive_dimension_scan, op10_forced_boundary_bpe, op11_source_divergence, op12_survivor_coalescence, op13_benchmark_automaton)}
SQL |= {"op3_curriculum_mix": mixing.SQL, "op5_perspective_rotation": chat.SQL, "op7_host_quality_rules": quality_rules.SQL, "op11_source_divergence": divergence.SQL, "op13_benchmark_automaton": decontamination.SQL}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
