"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and appending a
shard moves only the rows that go into it.

Only DataFrame functions. The shard is a projection; gapless slots need one shuffle of slim rows by
(shard, bucket) and a small table of bucket counts, so no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: its linear congruential multiplier and 2^31.
MULTIPLIER = 2862933555777941757
JUMP = float(1 << 31)

_M32, _M16 = 0xFFFFFFFF, 0xFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 on 32-bit halves: long products that never overflow."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & _M32
    part = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(F.lit(mask).cast("long"))
    upper, lower = part(low, 16, _M16) * ml, part(low, 0, _M16) * ml
    total = lower + F.shiftleft(part(upper, 0, _M16), 16) + 1
    cross = part(low * mh, 0, _M32) + part(part(high, 0, _M16) * ml, 0, _M32) + F.shiftleft(part(part(high, 16, _M16) * (ml & _M16), 0, _M16), 16)
    return part(F.shiftright(total, 32) + F.shiftright(upper, 16) + cross, 0, _M32), part(total, 0, _M32)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key."""

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        # Each jump goes up by one at least; the shard is the last landing below the count.
        jumped = F.floor((state["at"] + 1).cast("double") * (F.lit(JUMP) / (F.shiftright(high, 1) + 1).cast("double")))
        on = jumped < shards
        return F.struct(high.alias("high"), low.alias("low"), F.when(state["on"] & on, jumped).otherwise(state["at"]).alias("at"), (state["on"] & on).alias("on"))

    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_M32).cast("long")).alias("low"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["at"].cast("int")


def shard_documents(docs: DataFrame, *, shards: int = 16, buckets: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot (0, 1, ... in each shard) and grown_shard.

    Size is the UTF-8 length plus 1; a null text counts as empty (size 1, crc32 0). A null doc_id
    is hashed as 0. Repeated rows share a shard and get slots of their own. Slots order a shard's
    rows by bucket of the key's md5, key, size and crc32. An empty table gives no rows. Other
    columns of docs don't matter, whatever their names. A very long text is one row like any other; of
    it only the length and the crc32 are carried on.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    text = F.coalesce(F.col("text"), F.lit(""))
    bucket = (F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long") % buckets).cast("int")
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        bucket.alias("_bucket"),
    )
    ids = docs.select(jump_hash(key, shards).alias("shard"), bucket.alias("_bucket"))
    counts = ids.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32")
    return (
        slim.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


#: The same in DuckDB: its 128-bit integers for the generator, and crc32 bit by bit from its polynomial.
ORACLE = r"""
WITH RECURSIVE crc_bits AS (
  SELECT i AS n, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM crc_bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_bits WHERE step = 8),
bytes AS (
  SELECT doc_id, row_number() OVER () AS no, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b, coalesce(doc_id, 0) AS id FROM documents),
crc AS (SELECT no, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)::INT]), 4294967295)) AS text_crc32 FROM bytes, crc_table),
jump AS (
  SELECT no, n, (id::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM bytes, (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT no, n, k, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757 % 18446744073709551616 + 1) % 18446744073709551616 AS k FROM jump WHERE j < n)),
shards AS (SELECT no, n, max(b) AS shard FROM jump GROUP BY no, n)
SELECT x.doc_id, x.size, c.text_crc32, 'key' AS law, s.shard::INT AS shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY ('0x' || substr(md5(x.id::VARCHAR), 1, 6))::BIGINT % 256, x.doc_id NULLS LAST, x.size, c.text_crc32) - 1 AS slot,
       g.shard::INT AS grown_shard
FROM bytes x JOIN crc c USING (no) JOIN shards s ON s.no = x.no AND s.n = 16 JOIN shards g ON g.no = x.no AND g.n = 17
"""
