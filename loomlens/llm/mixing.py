"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get weights, the weights become token targets (no source beyond `max_repeat` times its
size), the targets become whole numbers of blocks by highest quotients target / (2k + 1), and each
source's blocks are dealt to its shards by the same rule. A shard then takes its quota from the
front of its documents, laid out in seeded hash order and, once all are taken, from the front again.

Only DataFrame functions. One scan of the text; one shuffle of (key, source, size) by source and
shard. A source's rows are spread over `shards` groups, and a shard that holds more than `group_rows`
is laid out in ranges of its hash order, so that no source and no shard fills one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.llm.common import WORD, null_safe, written


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, group: Sequence[str], weight: str, seats: str, tie: Sequence[str]) -> DataFrame:
    """Add `quota`: the group's `seats` by highest quotients weight / (2k + 1), ties by `tie`.

    A divisor method moves a party at most 1.5 x its share x parties + 1 seats from its rounded
    share, so only the quotients in that range are ranked: some four for each party.
    """
    all_of = Window.partitionBy(*group)
    share = F.coalesce(F.try_divide(F.col(weight), F.sum(weight).over(all_of)), F.lit(0.0))
    near = F.floor(F.col("_share") * F.col(seats) + 0.5)
    span = F.ceil(1.5 * F.col("_share") * F.col("_n")) + 2
    ranged = (
        parties.withColumn("_share", share)
        .withColumn("_n", F.count(F.lit(1)).over(all_of))
        .withColumn("_low", F.greatest(F.lit(0).cast("long"), near - span))
        .withColumn("_high", near + span)
        .withColumn("_open", F.col(seats) - F.sum("_low").over(all_of))
    )
    ranked = ranged.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high")))).withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), *tie, "_k")),
    )
    keys = [*group, *[t for t in tie if t not in group]]
    won = ranked.groupBy(*keys).agg((F.first("_low") + F.sum(F.when(F.col("_rank") <= F.col("_open"), 1).otherwise(0))).alias("quota"))
    return parties.join(won, keys)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """From (skey, source, source_size): add weight and target.

    Targets are in proportion to the weights, but at most max_repeat x source_size; what that leaves
    goes to the others by weight. Sorted by the level at which each source fills up, the final level
    is the largest that its own source can still take (one pass instead of repeated resharing).
    """
    by_name, everything = Window.orderBy("skey_order", "skey"), Window.partitionBy()
    full = Window.orderBy("_fills", "_no")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.withColumn("skey_order", F.when(F.col("source").isNull(), 1).otherwise(0))
        .withColumn("_no", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_no") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_most", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("_fills", F.col("_most") / F.col("weight"))
        .withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("_final", F.max(F.when(F.col("_level") <= F.col("_fills"), F.col("_level"))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("_most"), F.col("_final") * F.col("weight")), F.col("_most")))
        .select("skey", "source", "source_size", "weight", "target")
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: int = 2,
    block_tokens: int = 8,
    shards: int = 128,
    group_rows: int = 200_000,
    seed: int = 0,
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The `carry` columns with size, source_size, target, taken (words the mix takes of the row).

    Size is the number of words. Sources are taken in code-point order, null (a source like any
    other) last, and get `weights` in turn. Null or empty texts have size 0 and are never taken;
    a source without words has target 0; an empty table gives no rows. Repeated rows count each;
    rows with the same doc_id and size are interchangeable. A null doc_id sorts after all others.
    Other columns of docs don't matter, whatever their names. A very long text is one row like any
    other: its words are counted whole, by one expression.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.col("doc_id").alias("_id"), "source", null_safe("source").alias("skey"), words_in(F.col("text")).alias("size"), digest.alias("_h"))
    slim = written(slim.withColumn("shard", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % shards))
    by_shard = written(slim.groupBy("skey", "source", "shard").agg(F.sum("size").alias("shard_size"), F.count(F.lit(1)).alias("_rows")))
    targets = source_targets(by_shard.groupBy("skey", "source").agg(F.sum("shard_size").alias("source_size")), weights, share, max_repeat)
    seats = targets.withColumn("blocks", F.coalesce(F.round(F.sum("target").over(Window.partitionBy()) / block_tokens), F.lit(0)).cast("long"))
    per_source = sainte_lague(seats, [], "target", "blocks", ["skey"]).withColumnRenamed("quota", "source_blocks")
    dealt = sainte_lague(
        by_shard.drop("source", "_rows").join(per_source.select("skey", "source_size", "target", "source_blocks"), "skey"),
        ["skey"], "shard_size", "source_blocks", ["shard"],
    )
    take = F.least(F.col("quota") * block_tokens, F.col("shard_size") * max_repeat)
    plan = dealt.select("skey", "shard", "source_size", "target", F.coalesce(F.expr("try_divide(1, shard_size)"), F.lit(0)).alias("_any"), take.alias("_take"), "shard_size")
    laid = _starts(slim, by_shard.agg(F.max("_rows")).first()[0] or 0, group_rows)
    whole = F.when(F.col("shard_size") > 0, F.expr("_take div nullif(shard_size, 0)")).otherwise(F.lit(0))
    rest = F.col("_take") - F.col("_whole") * F.col("shard_size")
    return (
        laid.join(plan, ["skey", "shard"])
        .withColumn("_whole", whole)
        .withColumn("taken", (F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))).cast("long"))
        .select(*[F.col(f"c_{c}").alias(c) for c in carry], "size", "source_size", "target", "taken")
    )


def _starts(slim: DataFrame, most: int, group_rows: int) -> DataFrame:
    """Add _start: the words of the shard before the row, in order of _h. Ranges of _h are its first hexadecimal
    digits, as many as it takes for the largest shard (of `most` rows); their sums are added up first."""
    digits = 0
    while most > group_rows * 16**digits:
        digits += 1
    ranged = slim.withColumn("_range", F.substring("_h", 1, digits) if digits else F.lit(""))
    sums = ranged.groupBy("skey", "shard", "_range").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("skey", "shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy("skey", "shard", "_range").orderBy("_h", F.col("_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    if not digits:
        return inner
    offsets = sums.select("skey", "shard", "_range", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    return inner.join(offsets, ["skey", "shard", "_range"]).withColumn("_start", F.col("_start") + F.col("_offset"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix has them: each row as often as taken / size, rounded half up (0, 1, 2 ...)."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    mixed = mix_sources(whole, carry=("_row",), **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5)).otherwise(F.lit(0)).cast("int")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("_row.*")


#: Written out for DuckDB from the definition, for the default parameters.
ORACLE = r"""
WITH slim AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('0|' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
sharded AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % 128 AS shard FROM slim),
sources AS (
  SELECT skey, source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, skey) AS no FROM sharded GROUP BY skey, source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((no - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS most FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY most / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT skey, source_size,
         coalesce(least(most, (max(CASE WHEN level <= most / w THEN level END) OVER ()) * w), most) AS target FROM levels),
seats AS (SELECT coalesce(round(sum(target) / 8), 0)::BIGINT AS n FROM targets),
quotients AS (
  SELECT skey, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, skey, k) AS rank
  FROM targets, seats, LATERAL (SELECT unnest(range(greatest(0, n)::BIGINT)) AS k)
  WHERE k <= target / 8 + 0.5 + 40),
per_source AS (SELECT t.skey, t.source_size, t.target, count(rank)::BIGINT AS blocks
  FROM targets t LEFT JOIN (SELECT * FROM quotients, seats WHERE rank <= n) q USING (skey) GROUP BY ALL),
shards AS (SELECT skey, shard, sum(size)::BIGINT AS shard_size FROM sharded GROUP BY ALL),
quotas AS (
  SELECT skey, shard, row_number() OVER (PARTITION BY skey ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS rank
  FROM shards JOIN per_source USING (skey), LATERAL (SELECT unnest(range(blocks)) AS k)
  WHERE k <= shard_size / 4.0 + 260),
dealt AS (
  SELECT s.skey, s.shard, s.shard_size, p.source_size, p.target, count(rank)::BIGINT AS quota
  FROM shards s JOIN per_source p USING (skey)
  LEFT JOIN (SELECT q.* FROM quotas q JOIN per_source USING (skey) WHERE rank <= blocks) q ON q.skey = s.skey AND q.shard = s.shard
  GROUP BY ALL),
laid AS (
  SELECT sharded.*, coalesce(sum(size) OVER (PARTITION BY skey, shard ORDER BY h, doc_id NULLS LAST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sharded)
SELECT doc_id, size, source_size, target,
       (CASE WHEN shard_size = 0 THEN 0 ELSE
         (least(quota * 8, shard_size * 2) // shard_size) * size
         + greatest(0, least(size, least(quota * 8, shard_size * 2) % shard_size - start)) END)::BIGINT AS taken
FROM laid JOIN dealt USING (skey, shard)
"""
