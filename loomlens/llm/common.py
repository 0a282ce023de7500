"""Pieces that several operators share: fixed patterns, written tables, null-safe keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lost executors can't undo it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe(name: str) -> Column:
    """A string that differs for null and for every value; nulls group and join like a value."""
    return F.when(F.col(name).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(name).cast("string")))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on names."""
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on


def slices(batch: pa.RecordBatch, columns: tuple[str, ...], most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most most_rows rows and, where a row isn't larger, most_bytes bytes in the columns."""
    own = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    ends, start = np.cumsum(sum(own)), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, side="right")))
        stop = min(stop, start + most_rows)
        yield batch.slice(start, stop - start)
        start = stop
