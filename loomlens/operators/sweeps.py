"""Sweeps that run: every configuration is a key of the same job, and a bad one becomes a row with its error.

A run takes its category's normal training patches to a bank (k-center coreset of its ratio), its test patches to mean distances of their
nearest k, and images to scores and metrics. What would end a run (an unknown category, settings out of range, features of unlike or
non-finite values, nothing to train on or to test) is found by aggregates before anything is fitted, so the others aren't touched by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlens.operators import bank as B
from loomlens.operators import ranking as R
from loomlens.operators.coresets import coreset_distributed
from loomlens.operators.graph import shared_table
from loomlens.operators.neighbours import knn_distances


def _first(*reasons: tuple[Column, str]) -> Column:
    found = F.lit(None).cast("string")
    for when, reason in reversed(reasons):
        found = F.when(F.coalesce(when, F.lit(False)), F.lit(reason)).otherwise(found)
    return found


def checked(configs: DataFrame, patches: DataFrame) -> DataFrame:
    """configs (config_id, category, coreset_ratio, n_neighbors) with n_train, n_test (images), feature_dim and error (null if they can run)."""
    normal = (F.col("label") == 0) & (F.col("split") == "train")
    fine = F.forall(F.col("feature").cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    facts = patches.groupBy(F.col("category").alias("_category")).agg(
        F.countDistinct(F.when(normal, F.col("image_id"))).alias("n_train"), F.countDistinct(F.when(F.col("split") == "test", F.col("image_id"))).alias("n_test"),
        F.min(F.size("feature")).alias("_least"), F.max(F.size("feature")).alias("feature_dim"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("_fine"),
    )
    rows = configs.join(facts, F.col("category").eqNullSafe(F.col("_category")), "left")
    ratio, k = F.col("coreset_ratio"), F.col("n_neighbors")
    error = _first(
        (F.col("_fine").isNull(), "no such category"), (ratio.isNull() | (ratio <= 0) | (ratio > 1), "coreset_ratio must be above 0 and at most 1"), (k.isNull() | (k < 1), "n_neighbors must be at least 1"),
        (~F.col("_fine"), "features are null or not finite"), (F.col("_least") != F.col("feature_dim"), "features differ in size"), (F.col("n_train") == 0, "nothing to train on"), (F.col("n_test") == 0, "nothing to test"),
    )
    return rows.withColumn("error", error).drop("_category", "_least", "_fine")


def run_sweep(configs: DataFrame, patches: DataFrame, neighbors: Sequence[int] = (1, 3, 5), rows: int = 20_000) -> DataFrame:
    """One row per configuration: config_id, category, coreset_ratio, n_neighbors, status (done or failed), error, n_train, n_test,
    bank_size, feature_dim, image_auroc, image_ap and image_f1 (null without both classes).

    configs: a row per config_id, which is unique and not null; neighbors: the values that n_neighbors may take, others fail. patches:
    (category, patch_id, image_id, split, label, feature).
    """
    plan = checked(configs.select("config_id", "category", "coreset_ratio", "n_neighbors"), patches)
    known = F.col("n_neighbors").isin(*neighbors)
    plan = shared_table(plan.withColumn("error", F.when(F.col("error").isNull() & ~known, F.lit("n_neighbors isn't among those asked for")).otherwise(F.col("error"))))
    good = plan.where("error is null").select("config_id", F.col("category").alias("_category"), "coreset_ratio", "n_neighbors")
    own = patches.join(good, F.col("category").eqNullSafe(F.col("_category"))).drop("_category")
    normal = B.normal_patches(own).select("config_id", "patch_id", "feature", F.col("coreset_ratio"))
    bank = shared_table(coreset_distributed(normal, group="config_id", ratio="coreset_ratio", rows=rows))
    sizes = bank.groupBy("config_id").agg(F.count(F.lit(1)).alias("bank_size"))
    # Patches of several configurations share ids, so the key names both.
    both = F.struct("config_id", "patch_id").alias("key")
    asked = own.where("split = 'test'").select("config_id", both, "feature")
    near = knn_distances(asked, bank.select("config_id", both, "feature"), neighbors, group="config_id", key="key")
    picked = F.coalesce(*[F.when(F.col("n_neighbors") == n, F.col(f"d{n}")) for n in neighbors])
    scored = near.join(good.select("config_id", "n_neighbors"), "config_id").select("config_id", F.col("key.patch_id").alias("patch_id"), picked.alias("d"))
    images = scored.join(patches.select("patch_id", "image_id", "label"), "patch_id").groupBy("config_id", "image_id").agg(F.max("d").alias("score"), F.max("label").alias("label"))
    curve = shared_table(R.cumulative(R.score_counts(images, ["config_id"]), ["config_id"]))
    metrics = R.auroc_ap(curve, ["config_id"]).join(R.best_f1(curve, ["config_id"]).select("config_id", F.col("f1").alias("image_f1")), "config_id", "left")
    out = plan.join(sizes, "config_id", "left").join(metrics, "config_id", "left")
    return out.select("config_id", "category", "coreset_ratio", "n_neighbors", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", "n_train", "n_test", "bank_size", "feature_dim", F.col("auroc").alias("image_auroc"), F.col("ap").alias("image_ap"), "image_f1")


def compare_extractors(runs: DataFrame, first: str, second: str, metrics: Sequence[str]) -> DataFrame:
    """(category, metric, first, second, gain): two extractors on the same categories, from runs (category, extractor, metrics)."""
    long = runs.select("category", "extractor", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("category", "extractor", "m.*")
    side = lambda name: F.max(F.when(F.col("extractor") == name, F.col("value")))
    return long.groupBy("category", "metric").agg(side(first).alias("first"), side(second).alias("second")).withColumn("gain", F.col("second") - F.col("first"))


def benchmark_gap(runs: DataFrame, real: Sequence[str], metrics: Sequence[str], by: str = "extractor") -> DataFrame:
    """(by, metric, benchmark, real, gap): means over the benchmark's categories and over the real ones, and how much is lost."""
    long = runs.select(by, F.col("category").isin(*real).alias("is_real"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(by, "is_real", "m.*")
    mean = lambda is_real: F.avg(F.when(F.col("is_real") == is_real, F.col("value")))
    return long.groupBy(by, "metric").agg(mean(False).alias("benchmark"), mean(True).alias("real")).withColumn("gap", F.col("benchmark") - F.col("real"))
