"""Memory bank of normal features: sizes, exact coresets, statistics. Coresets of any size are in operators/coresets.py, nearest
neighbours in operators/neighbours.py."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlens.operators.coresets import _first, coreset_distributed, greedy, greedy_order, lazy_order, start_order  # noqa: F401
from loomlens.operators.graph import shared_table
from loomlens.operators.neighbours import knn_distances, knn_marked, matrix


def normal_patches(patches: DataFrame) -> DataFrame:
    return patches.where((F.col("label") == 0) & (F.col("split") == "train"))


def bank_sizes(patches: DataFrame, ratios: Sequence[float], keys: Sequence[str] = ("category",)) -> DataFrame:
    """(keys, ratio, n, n_keep): floor of the share, at least 1, at most all."""
    n = normal_patches(patches).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return n.withColumn("n_keep", F.least("n", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * F.col("ratio")))))


def greedy_centers(features: np.ndarray, keep: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices in order of choice, final distances) of the greedy choice of rows."""
    chosen, _, nearest = greedy_order(features, keep, first)
    return chosen, np.sqrt(np.maximum(nearest, 0))


def coreset(patches: DataFrame, keep: int | None = None, ratio: float = 0.1, seed: int = 0, group: str = "category", key: str = "patch_id") -> DataFrame:
    """(group, key, feature, rank) by exact greedy k-center. Each choice depends on all before it, so one task
    holds a group; for groups of any size see coreset_distributed."""
    rows = patches.select(group, key, "feature").withColumn("_start", start_order(seed, key))
    keep_of = lambda n: keep if keep is not None else max(1, int(n * ratio))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(group).applyInArrow(greedy(keep_of, key), f"{group} {kinds[group]}, {key} {kinds[key]}, feature {kinds['feature']}, rank int")


def bank_statistics(patches: DataFrame, ratios: Sequence[float], seed: int = 0) -> DataFrame:
    """(category, ratio, n, n_keep, kept_share, radius): how far any normal patch is from the bank.

    A greedy bank is a prefix of a larger one, so one run to the largest ratio serves all of them. The radius of a bank is the distance
    at which the next row would be chosen, 0 if it holds all, so no distances are taken again. One task holds a category, as in coreset.
    """
    normal = normal_patches(patches).select("category", "patch_id", "feature")
    sizes = bank_sizes(patches, ratios)
    kind = normal.schema["category"].dataType.simpleString()
    most = max(ratios)

    def radii(table: pa.Table) -> pa.Table:
        table = table.sort_by("patch_id")
        n = table.num_rows
        _, gaps = lazy_order(matrix(table, "feature"), min(n, max(1, int(np.floor(n * most)))) + 1, _first(table))
        gaps = [*gaps[1:], *[0.0] * (len(gaps) == n)]
        return pa.table({"_of": pa.array([table.column("category")[0].as_py()] * len(gaps), table.schema.field("category").type), "_kept": pa.array(range(1, len(gaps) + 1), pa.int64()), "radius": pa.array(gaps, pa.float64())})

    found = normal.withColumn("_start", start_order(seed, "patch_id")).groupBy("category").applyInArrow(radii, f"_of {kind}, _kept long, radius double")
    kept = F.col("n_keep") / F.col("n")
    return sizes.join(found, F.col("category").eqNullSafe(F.col("_of")) & (F.col("n_keep") == F.col("_kept"))).select("category", "ratio", "n", "n_keep", kept.alias("kept_share"), "radius")


def knn_approximate(queries: DataFrame, bank: DataFrame, bucket: float = 1.0, tables: int = 8) -> DataFrame:
    """(patch_id, d1) by random-projection hashing: the nearest bank row of the category among those that share a
    bucket; queries that share one with none are compared exactly, so every query with a bank has a distance.

    A row carries its hashes as marks and isn't multiplied by the tables where their buckets are large, as in knn_marked."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = lambda df: df.select("patch_id", "category", "feature").withColumn("vec", array_to_vector(F.col("feature").cast("array<double>")))
    q, b = vec(queries), vec(bank)
    model = BucketedRandomProjectionLSH(inputCol="vec", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=1).fit(b)
    marks = F.array(*[vector_to_array(F.col("hashes")[i])[0] for i in range(tables)]).alias("marks")
    marked = lambda df: shared_table(model.transform(df).select("patch_id", "category", "feature", marks))
    q, b = marked(q), marked(b)
    found, whole = knn_marked(q, b)
    found = shared_table(found)
    # Other groups may hold queries alone in all their buckets.
    other = lambda df: df.join(whole.select(F.col("category").alias("_c")), F.col("category").eqNullSafe(F.col("_c")), "left_anti").drop("marks")
    alone = knn_distances(other(q).join(found.select("patch_id"), "patch_id", "left_anti"), other(b))
    return found.unionByName(alone.select("patch_id", "d1").where("d1 is not null"))
