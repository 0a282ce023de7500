"""Hard negatives by Four-Russians scoring.

Scores are inner products of integer vectors. Components are dealt to groups of eight dimensions. For each group an anchor gets a
table of the 256 sums of subsets of its components; a candidate is packed into bit planes, a byte for each plane and group.
The byte picks the sum of the anchor's components where the candidate has that bit, so the sum over groups, shifted by the plane,
is that plane's part of the inner product: all planes added (the sign plane subtracted) give the full, exact score.

Anchors meet candidates in blocks of anchors x pieces of candidates. A task packs its piece once and builds the tables of `_FEW`
anchors at a time, so it holds one piece, one block and one strip of scores. Two passes: the positives of each anchor first, from the
pieces of its label only; then, with their scores known, the negatives between the bounds. A block and a piece send at most the
wanted number of rows an anchor (or positive), and Spark ranks what they sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlens.llm.common import written

_GROUP, _FEW, _STRIP = 8, 64, 1024
_LAST = np.iinfo(np.int64).max


def whole_numbers(rows: DataFrame, scale: int = 256, anchor_every: int = 50) -> DataFrame:
    """vec_id, label, vector (array<long>), is_anchor of rows (vec_id, embedding, label) that take part: each component
    is floor(scale * x). Rows with a null label, a null vector or a null or non-finite component are left out."""
    x = F.col("embedding").cast("array<double>")
    # coalesce, as a null inside leaves forall null
    fine = F.col("label").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    vector = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), F.coalesce(F.col("vec_id") % anchor_every == 0, F.lit(False)).alias("is_anchor"))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each byte the sum of the anchors' components at the byte's bits."""
    n, dims = anchors.shape
    parts = np.zeros((n, -(-dims // _GROUP) * _GROUP), np.int64)
    parts[:, :dims] = anchors
    parts = parts.reshape(n, parts.shape[1] // _GROUP, _GROUP).transpose(1, 2, 0)
    tables = np.zeros((parts.shape[0], 1, n), np.int64)
    for k in range(_GROUP):
        tables = np.concatenate([tables, tables + parts[:, k : k + 1, :]], axis=1)
    return tables


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """(planes, groups, rows): bytes of two's complement bits, the sign plane last."""
    n, dims = vectors.shape
    padded = np.zeros((n, -(-dims // _GROUP) * _GROUP), np.int64)
    padded[:, :dims] = vectors
    width = max(1, int(np.maximum(padded, ~padded).max(initial=0)).bit_length()) + 1
    planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(width)]
    return np.stack(planes).transpose(0, 2, 1)


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products by lookups, shifts and sums."""
    total = None
    for b in range(len(planes) - 1, -1, -1):  # from the sign plane down, doubling what is there
        plane = tables[0][planes[b, 0]]
        for g in range(1, len(tables)):
            plane += tables[g][planes[b, g]]
        total = -plane if total is None else np.add(total << 1, plane, out=plane)
    return total


def _narrow(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """tables as 32-bit numbers where no score can leave them."""
    most = int(np.abs(tables).max(initial=0)) * len(tables) << len(planes)
    return tables.astype(np.int32) if most < 1 << 31 else tables


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers; shorter ones end in zeros."""
    rows = column.combine_chunks()
    counts = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(rows), max(_GROUP, int(counts.max(initial=0)))), np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(rows)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers; null is the largest."""
    return np.array([_LAST if x is None else x for x in column.to_pylist()], np.int64)


def _strips(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first anchor, first row, scores of the rows with some anchors) of a block and a piece."""
    anchors, vectors = _matrix(left.column("vector")), _matrix(right.column("c_vector"))
    wide = max(anchors.shape[1], vectors.shape[1])
    anchors, vectors = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (anchors, vectors))
    planes = bit_planes(vectors)
    for a in range(0, len(anchors), _FEW):
        tables = _narrow(subset_sums(anchors[a : a + _FEW]), planes)
        yield a, np.concatenate([scores(tables, planes[:, :, r : r + _STRIP]) for r in range(0, len(vectors), _STRIP)])


def _dealt(rows: DataFrame, size: int, by: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with the number `name` of their share of about `size` rows of each key, and (key, shares). The partition is part
    of the hash, so that rows that are equal in all columns are dealt too."""
    n = f"{name}s"
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias(n)) if by else rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias(n))
    dealt = rows.join(counts, by) if by else rows.withColumn(n, F.lit(counts.first()[0]))
    return dealt.withColumn(name, F.pmod(F.xxhash64("vec_id", "vector", F.spark_partition_id()), F.col(n)).cast("int")).drop(n), counts


def _best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` rows of each key with the highest score, then the smallest id (null last), with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("found").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _met(anchors: DataFrame, rows: DataFrame, by: list[str], sizes: tuple[int, int]) -> tuple:
    """Anchors and rows grouped so that every block of anchors meets every piece of rows, of equal keys if `by` is given."""
    blocks, n_blocks = _dealt(anchors, sizes[0], by, "block")
    pieces, n_pieces = _dealt(rows, sizes[1], by, "piece")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    if by:
        left = blocks.join(n_pieces, by).withColumn("piece", every(F.col("pieces"))).drop("pieces")
        right = pieces.join(n_blocks, by).withColumn("block", every(F.col("blocks"))).drop("blocks")
    else:
        left = blocks.withColumn("piece", every(F.lit(n_pieces.first()[0])))
        right = pieces.withColumn("block", every(F.lit(n_blocks.first()[0])))
    right = right.select(*[F.col(c).alias(f"c_{c}") for c in right.columns])
    keys = [*by, "block", "piece"]
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"c_{c}" for c in keys]))


def positives(anchors: DataFrame, rows: DataFrame, most: int = 5, sizes: tuple[int, int] = (1024, 8192)) -> DataFrame:
    """(anchor, found, score, rank): each anchor's best other rows of its label. anchors: (anchor, vec_id, label, vector)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names, own, ids = left.column("anchor").to_numpy(), _ids(left.column("vec_id")), _ids(right.column("c_vec_id"))
            for a, strip in _strips(left, right):
                for k in range(strip.shape[1]):
                    other = np.flatnonzero(ids != own[a + k])
                    s = strip[other, k]
                    if len(other) > most:
                        near = s >= -np.partition(-s, most - 1)[most - 1]  # ties stay for the ids to settle
                        other, s = other[near], s[near]
                    top = np.lexsort((ids[other], -s))[:most]
                    out += [(names[a + k], ids[other[t]], s[t]) for t in top.tolist()]
        return _found(out, ["anchor"])

    met = _met(anchors, rows, ["label"], sizes)
    return _best(met.applyInArrow(run, "anchor long, found long, score long"), ["anchor"], most)


def _found(out: list[tuple], keys: list[str]) -> pa.Table:
    columns = [[int(x[i]) for x in out] for i in range(len(keys) + 2)]
    columns[-2] = [None if x == _LAST else x for x in columns[-2]]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip([*keys, "found", "score"], columns, strict=True)})


def negatives(anchors: DataFrame, rows: DataFrame, most: int = 3, low: int = 50, high: int = 95, sizes: tuple[int, int] = (1024, 8192)) -> DataFrame:
    """(anchor, place, found, score, rank): for each of an anchor's positive scores, the best rows of other labels with
    low * positive <= 100 * score <= high * positive. anchors: (anchor, vec_id, label, vector, wanted: array of scores)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names, labels, wanted = left.column("anchor").to_numpy(), left.column("label").to_numpy(), left.column("wanted").to_pylist()
            ids, kinds = _ids(right.column("c_vec_id")), right.column("c_label").to_numpy()
            for a, strip in _strips(left, right):
                for k in range(strip.shape[1]):
                    bounds = [(-(-low * p // 100), high * p // 100) for p in wanted[a + k]]
                    floor, ceiling = min(b[0] for b in bounds), max(b[1] for b in bounds)
                    all_s = strip[:, k]
                    rest = np.flatnonzero((all_s >= floor) & (all_s <= ceiling) & (kinds != labels[a + k]))
                    order = rest[np.lexsort((ids[rest], -all_s[rest]))]
                    falling = -all_s[order].astype(np.int64)
                    for place, (least, greatest) in enumerate(bounds):
                        first, end = np.searchsorted(falling, -greatest), np.searchsorted(falling, -least, side="right")
                        out += [(names[a + k], place, ids[t], all_s[t]) for t in order[first : min(end, first + most)].tolist()]
        return _found(out, ["anchor", "place"])

    met = _met(anchors, rows, [], sizes)
    return _best(met.applyInArrow(run, "anchor long, place long, found long, score long"), ["anchor", "place"], most)


def mine(rows: DataFrame, *, most_positives: int = 5, most_negatives: int = 3, low: int = 50, high: int = 95, sizes: tuple[int, int] = (1024, 8192)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, vector, is_anchor).

    An anchor's positives are its best other rows of its label; a positive's negatives the best rows of other labels whose score
    is between low and high hundredths of the positive's. Ties go to the smaller vec_id, null last.
    Rows of one vec_id aren't each other's positives; otherwise each repeated row counts as itself, and an anchor that comes
    several times is mined once for each different vector and label. A null vec_id is never an anchor. Vectors of unlike lengths count as if the
    shorter ended in zeros. Scores are 64-bit: components of 64 dimensions up to 2^28 are safe, larger ones are refused by an error.
    Anchors without positives, and positives without negatives, give no row; an empty table gives none. Other columns don't matter.
    """
    rows = written(rows.select("vec_id", "label", "vector", "is_anchor").withColumn("vector", F.when(F.exists("vector", lambda v: F.abs(v) >= 1 << 28), F.raise_error(F.lit("a component is beyond 2^28"))).otherwise(F.col("vector").cast("array<int>"))))
    anchors = rows.where("is_anchor").select("vec_id", "label", "vector").distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "vector"))
    anchors, every = written(anchors), rows.drop("is_anchor")
    best = written(positives(anchors, every, most_positives, sizes))
    wanted = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("wanted"))
    found = negatives(anchors.join(wanted, "anchor"), every, most_negatives, low, high, sizes)
    named = best.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, label is (label + 1) % 10."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


ORACLE = r"""
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM fine a JOIN fine c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS no FROM scored WHERE same) WHERE no <= 5),
negative AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
"""
