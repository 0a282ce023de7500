"""Exact dedup with a heavy-hitter split.

Each task keeps Misra-Gries counters of its digests; the merged candidates are a bounded set, which
an exact count then verifies. The verified groups' winners are broadcast (their number is bounded by
`counters`), so a group of any size is settled map-side; all other digests, none of which holds more
than a 2 / counters share of the rows, are shuffled to their groups in the ordinary way: counted with
map-side combining and joined back, so that no task has to hold a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlens.llm.common import SPACES, null_safe, written


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def misra_gries(values, counters: int, found: Counter | None = None) -> Counter:
    """Add values to a summary of at most `counters` counters. Each value's counter falls short of
    its count by total / (counters + 1) at most, so whatever is more frequent than that is kept."""
    found = Counter() if found is None else found
    found.update(Counter(values))
    if len(found) > counters:
        cut = sorted(found.values(), reverse=True)[counters]
        found = Counter({k: v - cut for k, v in found.items() if v > cut})
    return found


def frequent_candidates(df: DataFrame, column: str, counters: int) -> DataFrame:
    """At most `counters` values, among them each that more than a 2 / counters share of df's rows hold.

    Task summaries are merged by sum. A value's sum falls short of its count by rows / (counters + 1)
    at most, so such a value's is above rows / counters, and fewer than `counters` sums can be."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            found = misra_gries(batch.column(0).to_pylist(), counters, found)
        yield pa.RecordBatch.from_pydict({"value": list(found), "n": list(found.values())}, pa.schema([("value", pa.string()), ("n", pa.int64())]))

    tasks = df.where(F.col(column).isNotNull()).select(column).mapInArrow(summary, "value string, n long")
    return tasks.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(counters).select("value")


def _digests(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        F.col("doc_id"), *more, F.xxhash64("text").alias("_text"),
        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
        F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("_length"),
    )


def _best() -> Column:
    """Of equal texts, the longest original stays, then the smallest doc_id (null last), then a text by its hash."""
    return F.min(F.struct((-F.col("_length")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_text").alias("text")))


def _heavy(slim: DataFrame, counters: int) -> DataFrame:
    """(text_sha256, _best, group_size) of the verified frequent digests: `counters` rows at most."""
    candidates = frequent_candidates(slim, "text_sha256", counters).withColumnRenamed("value", "text_sha256")
    counted = slim.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("_best"))
    return written(counted.where("group_size > 1"))


def _rest(slim: DataFrame, heavy: DataFrame) -> DataFrame:
    """The same of all other digests."""
    left = slim.join(F.broadcast(heavy), "text_sha256", "left_anti")
    return left.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("_best"))


def exact_groups(docs: DataFrame, *, counters: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty and all empty texts
    are one group. Of a group the row with the most code points in the original text stays, then
    the smallest doc_id; a null doc_id comes last and, if it wins, keep_id is null. Repeated rows
    count in group_size; as they are the same document, all copies of the winning row say kept.
    An empty table gives no rows; other columns of docs don't matter. A very long text is normalised and
    hashed whole, by one expression; only digests are shuffled.
    """
    slim = written(_digests(docs))
    heavy = _heavy(slim, counters)
    rest = slim.join(F.broadcast(heavy), "text_sha256", "left_anti").join(_rest(slim, heavy), "text_sha256")
    settled = slim.join(F.broadcast(heavy), "text_sha256").unionByName(rest)
    return settled.select(
        "doc_id",
        F.col("_best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("_best.id")) & (F.col("_length") == -F.col("_best.l"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, *, counters: int = 1024) -> DataFrame:
    """The rows of docs that stay, with docs' columns; of fully equal winners one stays.

    The texts are hashed once; which rows stay comes back to them by id and a hash of the text.
    """
    slim = written(_digests(docs))
    heavy = _heavy(slim, counters)
    best = heavy.select("_best").union(_rest(slim, heavy).select("_best")).select(null_safe("_best.id").alias("_id"), F.col("_best.text").alias("_text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), null_safe("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    return rows.join(best, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n
"""
