"""Model store, results log, sweep grid and defect sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_RATIO = 0.1


def save_models(models: DataFrame, bank: DataFrame, path: str) -> None:
    """Two Parquet tables by category: model rows (null until calibrated) and bank vectors."""
    models.write.mode("append").partitionBy("category").parquet(f"{path}/models")
    bank.write.mode("append").partitionBy("category").parquet(f"{path}/bank")


def load_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(models, bank); a missing or null coreset ratio is the default."""
    models = spark.read.option("mergeSchema", True).parquet(f"{path}/models")
    ratio = F.coalesce(F.col("coreset_ratio"), F.lit(DEFAULT_RATIO)) if "coreset_ratio" in models.columns else F.lit(DEFAULT_RATIO)
    return models.withColumn("coreset_ratio", ratio), spark.read.parquet(f"{path}/bank")


def append_results(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with the rows added: columns only they have come at the end, null in older rows."""
    return log.unionByName(rows, allowMissingColumns=True)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to the results log under path, whatever their columns: a numbered folder per call, so older files stay as they are."""
    spark = rows.sparkSession
    last = spark.read.parquet(path).agg(F.max("append")).first()[0] if _exists(spark, path) else 0
    rows.write.mode("errorifexists").parquet(f"{path}/append={last + 1:09d}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log in the order of its appends: columns that only later ones have come at the end, null in older rows."""
    return spark.read.option("mergeSchema", True).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def sweep_grid(categories: DataFrame, layer_sets: DataFrame, base: Mapping[str, object]) -> DataFrame:
    """Every category with every layer set; each base value unless the layer set's row overrides it."""
    every = categories.select("category", F.lit(1).alias("_1")).join(F.broadcast(layer_sets.withColumn("_1", F.lit(1))), "_1").drop("_1")
    for name, value in base.items():
        every = every.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in every.columns else F.lit(value))
    return every.withColumn("config_id", F.md5(F.concat_ws("|", "category", "layer_set", *base)))


def write_defects(defects: DataFrame, path: str, columns: Sequence[str] = ("pos_mm", "size_mm", "points", "x", "y", "w", "h")) -> None:
    defects.select(*columns).write.mode("overwrite").option("header", True).csv(path)
