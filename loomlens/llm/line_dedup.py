"""Line dedup: long lines found in many documents stay only in the document with the largest id.

Line hashes are range-partitioned and sorted within their partition by document (largest first) and
position; streaming over them, the first document of each hash keeps its lines. What goes back is
a bitmap of dropped lines per document, not text. Hashes with more than `heavy_rows` occurrences, or a
1 / `heavy_share` part of all, are counted first by map-side aggregation; their occurrences are settled by a join,
in which Spark splits a large hash, and never stand in one partition.

Only DataFrame functions. Shuffled: 40 bytes for each long line, and each text once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.llm.common import SPACES, null_safe, written


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z (and nothing else) in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns(
        {"_id": null_safe("doc_id"), "_text": F.xxhash64("text"), "_lines": F.split("text", "\n")}
    )


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, _id, _text, at, a, b): each long line's document, position and 128 bits of hash."""
    long_lines = F.posexplode(F.transform(F.col("_lines"), lambda x: F.when(F.char_length(x) >= min_chars, x)))
    keyed = _lines(docs).select("doc_id", "_id", "_text", long_lines.alias("at", "line")).where(F.col("line").isNotNull()).withColumn("key", line_key(F.col("line")))
    return keyed.where(F.char_length("key") >= min_chars).select("doc_id", "_id", "_text", "at", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("b"), "key").alias("b"))


def dropped_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, heavy_share: int = 1024, heavy_rows: int = 100_000) -> DataFrame:
    """(_id, _text, dropped): per document a bitmap of its dropped lines, 63 lines to a long."""
    seen = written(line_occurrences(docs, min_chars))
    most = min(heavy_rows, seen.count() // heavy_share)
    frequent = written(seen.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("a", "b"))
    heavy_docs = seen.join(frequent, ["a", "b"], "left_semi").groupBy("a", "b", "_id", "_text").agg(F.max("doc_id").alias("doc_id"))
    heavy = written(heavy_docs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")))
    settled = seen.join(heavy, ["a", "b"])
    ranged = seen.join(heavy, ["a", "b"], "left_anti").repartitionByRange("a", "b")
    same_key = Window.partitionBy("a", "b")
    streamed = (
        ranged.withColumn("_no", F.dense_rank().over(same_key.orderBy(F.col("doc_id").desc_nulls_last(), "_text")))
        .withColumns({"docs": F.max("_no").over(same_key), "last": F.max("doc_id").over(same_key)})
        .drop("_no")
    )
    drop = settled.unionByName(streamed).where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("last")))
    words = drop.groupBy("_id", "_text", (F.col("at") / 63).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 63)).alias("bits"))
    maps = words.groupBy("_id", "_text").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("top"))
    return maps.select("_id", "_text", F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("dropped"))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with three columns more: _kept_text, the text without its dropped lines, _n_lines and _n_dropped.

    A document is a distinct pair of doc_id and text: repeated rows count once and are treated
    alike; two texts under the largest doc_id both keep the line. A null or empty text is one empty
    line and comes back as an empty text. A null doc_id is smaller than any other. An empty table
    gives no rows. A very long text is split whole, and its bitmap has a bit a line. docs must not have
    columns of these three names: they would come twice.
    """
    maps = dropped_lines(docs, **options)
    keep = lambda _, i: F.coalesce(F.call_function("shiftrightunsigned", F.get("dropped", (i / 63).cast("int")), i % 63).bitwiseAND(F.lit(1).cast("long")), F.lit(0)) == 0
    lines = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = lines.withColumns({"_id": null_safe("doc_id"), "_text": F.xxhash64("text")}).drop("text", "doc_id")
    joined = lines.join(maps, ["_id", "_text"], "left").withColumn("_lines", F.split(F.coalesce(F.col("_row.text"), F.lit("")), "\n"))
    kept = joined.withColumn("_kept", F.when(F.col("dropped").isNull(), F.col("_lines")).otherwise(F.filter("_lines", keep)))
    return kept.select("_row.*", F.size("_lines").cast("long").alias("_n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("_n_dropped"), F.array_join("_kept", "\n").alias("_kept_text"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 for each row of docs; see without_repeated_lines."""
    kept = without_repeated_lines(docs.select("doc_id", "text"), **options)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
