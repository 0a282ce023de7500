"""The queries of this subpackage: thin, each over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlens.llm import bpe_chunks, exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, near_dedup, periodic_runs, quality, sharding, substring_dedup, token_lengths, toxicity
from loomlens.llm.common import table


def op1_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.length_histogram(token_lengths.with_token_counts(table(spark, sf_dir, "documents")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeated_passages(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("_text")


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_documents(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapsed_runs(table(spark, sf_dir, "documents"), alter=periodic_runs.with_period)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined_components(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.whole_numbers(hard_negatives.relabelled(table(spark, sf_dir, "embeddings"))))


_ALL = (
    op1_token_lengths,
    op2_mix_sources,
    op3_jump_shards,
    op4_block_anchors,
    op5_exact_dedup,
    op6_robust_quality,
    op7_line_dedup,
    op8_recurrent_toxicity,
    op9_chosen_path,
    op10_bpe_chunks,
    op11_periodic_runs,
    op12_jaccard_join,
    op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_jump_shards": sharding.ORACLE,
    "op4_block_anchors": substring_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_chosen_path": near_dedup.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE,
    "op12_jaccard_join": jaccard_join.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
