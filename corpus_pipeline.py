"""From raw documents to encoded training documents, as stages that each read the last one's table.

Whole rows are kept, with their other columns whatever their names; all but the last stage return the columns they got.
- Null, empty and blank texts have no words: the quality rules drop them, so later stages get none from run(). By
  themselves: exact dedup keeps one of them all; near-dedup keeps each once per doc_id and text; the mix takes none; the
  last stage gives no ids and the digests of empty strings.
- Null languages and sources are groups like any other, the null source with its own weight, last in order.
- Null doc_ids come after all others; rows that have none, or share one, have only that in common and are told apart by their texts.
- Repeated rows pass or fail the quality rules together, and one stays of them at each dedup. The mix counts each row.
- Ties: of equal texts the longest original stays, then the smallest doc_id, then the least text hash; of near copies the
  smallest doc_id, then the least text hash; blocks go to the first source or shard in order.
- Very long texts are read whole by every stage. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlens.llm import bpe_chunks, exact_dedup, mixing, near_dedup, quality
from loomlens.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and aren't robust outliers of their language and source."""
    return quality.good_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingle sets."""
    return near_dedup.near_deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them: left out, once or twice."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document in the mix: number and digest of its ids, digest of what they decode to."""
    return bpe_chunks.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", encoded),
]

#: Robust estimates and the tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
