"""Token counts as an exact histogram of encoded lengths.

Texts are encoded in Arrow batches only to be counted; the counts are aggregated to one row per
length, which is all that totals, quantiles and truncated totals for any context limit need. Suffix
sums run in two levels, inside blocks of lengths and over the blocks, so no task sorts all lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlens.llm.common import written


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> tuple[str, str]:
    """(file of ranks, split pattern) of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def with_token_counts(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of docs, `n_tokens`: the length of the whole encoded text; null counts as empty.

    Repeated rows count each; an empty table gives no rows; only the column text is read. A very long text
    is encoded in one call, alone: a task holds one Arrow batch of texts and the ids of one of them.
    The vocabulary's path must be readable on every executor.
    """
    path, pattern = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            lengths = [len(encode(text.as_py())) if text.is_valid else 0 for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(counts: DataFrame, block: int = 1024) -> DataFrame:
    """From rows with n_tokens: one row per length, n_tokens, with

    n_docs, n_longer_docs (longer than the length), total_tokens (of all rows), tokens_from (in rows
    of at least the length), docs_up_to and share_up_to (rows of at most the length, for quantiles),
    truncated_total (tokens when each row is cut to the length) and lost_tokens (what that cuts).
    Rows with null n_tokens are left out; an empty table gives no rows; other columns don't matter.
    """
    sums = counts.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / block))
    sums = written(sums)  # a row per length, used twice; the texts are encoded once
    blocks = sums.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens"))
    above, every = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_docs", "_tokens")], F.sum("_docs").over(every).alias("_all_docs"), F.sum("_tokens").over(every).alias("total_tokens"))
    onward = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    suffix = sums.join(blocks, "_block").select(
        "n_tokens", "n_docs", "total_tokens", "_all_docs",
        (F.sum("n_docs").over(onward) + F.col("_docs_above")).alias("_docs_from"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(onward) + F.col("_tokens_above")).alias("tokens_from"),
    )
    longer = F.col("_docs_from") - F.col("n_docs")
    up_to = F.col("_all_docs") - longer
    truncated = F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("_docs_from")
    return suffix.select("n_tokens", "n_docs", longer.alias("n_longer_docs"), "total_tokens", "tokens_from", up_to.alias("docs_up_to"), (up_to / F.col("_all_docs")).alias("share_up_to"), truncated.alias("truncated_total"), (F.col("total_tokens") - truncated).alias("lost_tokens"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: rows that are longer, tokens kept when rows are cut, tokens lost."""
    asked = histogram.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    cut = F.greatest(F.lit(0), F.col("n_tokens") - F.col("context_limit"))
    return asked.groupBy("context_limit").agg(
        F.sum(F.when(cut > 0, F.col("n_docs")).otherwise(0)).alias("n_longer_docs"), F.sum((F.col("n_tokens") - cut) * F.col("n_docs")).alias("truncated_total"), F.sum(cut * F.col("n_docs")).alias("lost_tokens")
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that at least that share of the rows don't exceed."""
    return histogram.groupBy().agg(*[F.min(F.when(F.col("share_up_to") >= F.lit(float(s)), F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("x")
    ).select("x.*")
