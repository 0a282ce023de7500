"""Structured Streaming forms of the per-frame and running results; each equals its batch counterpart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.functions import columns as C
from loomlens.operators import grading as G


def frame_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def verdicts(frames: DataFrame, models: DataFrame) -> DataFrame:
    """Each frame with its category's threshold (stream-static join), verdict and effective verdict."""
    joined = frames.join(models.select("category", "threshold"), "category", "left")
    return joined.withColumn("is_defective", C.verdict(F.col("score"), F.col("threshold"))).withColumn("defective", C.effective_verdict(F.col("is_defective"), F.col("num_defects")))


def running_summary(frames: DataFrame, *group: str, delay: str | None = None) -> DataFrame:
    """The batch summary as frames arrive; with a delay, repeated frame ids within it count once."""
    if delay is not None:
        frames = frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["frame_id"])
    return G.batch_summary(frames, *group)


#: A roll's running result, as held between batches: frames, failures, defective frames, points, last time in ms.
_ROLL = "total long, failed long, defective long, points long, last_ms long"


def finished_rolls(frames: DataFrame, delay: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """(roll_id, total, defective, points, passed, complete) once per roll: when its last frame is in, or, not complete, when the
    watermark is idle_ms past its newest frame. After either the roll is forgotten, so state holds open rolls only.

    frames: a stream of (roll_id, frame_id, ts, expected: frames of the roll, failed, is_defective, num_defects, points); repeated frame
    ids within the delay count once, null points as none. A frame that comes after its roll was closed opens it again.
    """
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["frame_id"])
    bad = ~F.col("failed") & C.effective_verdict(F.col("is_defective"), F.col("num_defects"))
    slim = timed.select("roll_id", "ts", "expected", F.col("failed").cast("int").alias("failed"), F.coalesce(bad, F.lit(False)).cast("int").alias("bad"), F.when(F.col("failed"), 0).otherwise(F.coalesce("points", F.lit(0))).cast("long").alias("points"))

    def close(key, sums, complete):
        total, _, defective, points, _ = sums
        return pd.DataFrame({"roll_id": [key[0]], "total": [total], "defective": [defective], "points": [points], "passed": [total - defective], "complete": [complete]})

    def run(key, parts, state):
        if state.hasTimedOut:
            yield close(key, state.get, False)
            state.remove()
            return
        total, failed, defective, points, last = state.get if state.exists else (0, 0, 0, 0, 0)
        expected = None
        for part in parts:
            total, failed, defective, points = total + len(part), failed + int(part.failed.sum()), defective + int(part.bad.sum()), points + int(part.points.sum())
            last, expected = max(last, int(part.ts.max().timestamp() * 1000)), int(part.expected.max())
        sums = (total, failed, defective, points, last)
        if expected is not None and total >= expected:
            if state.exists:
                state.remove()
            yield close(key, sums, True)
        else:
            state.update(sums)
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))

    kind = frames.schema["roll_id"].dataType.simpleString()
    schema = f"roll_id {kind}, total long, defective long, points long, passed long, complete boolean"
    return slim.groupBy("roll_id").applyInPandasWithState(run, schema, _ROLL, "append", "EventTimeTimeout")


def windowed_grades(frames: DataFrame, window: str = "1 day", delay: str = "1 day", image_size: int = 224, ppm: float = 5.0) -> DataFrame:
    """(roll_id, day, n_frames, points, p100, grade) per roll and tumbling window of event time.

    In append mode late frames are dropped and open windows held back; state is bounded by the delay.
    """
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp"))
    if frames.isStreaming:
        timed = timed.withWatermark("ts", delay)
    sums = timed.groupBy("roll_id", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n_frames"), F.sum("num_defects").alias("points"))
    side = image_size / ppm
    p100 = C.points_per_100sqyd(F.col("points"), F.col("n_frames") * F.lit(side) / C.MM_PER_YARD, F.lit(side / C.MM_PER_INCH))
    return sums.select("roll_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n_frames", "points", F.round(p100, 4).alias("p100"), C.grade(p100).alias("grade"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run the stream over what is there now into an in-memory table, and give it back. For results that
    fit the driver; use a Parquet sink with append mode otherwise."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_latest(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run the stream in update mode, each batch's changed rows to a folder of its own (written again if the batch
    is), and give back the last row of each key. Only the state that the watermark leaves is kept."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    found = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
