"""Rolls that are closed by their last frame or by the watermark, and then forgotten."""

from __future__ import annotations

from datetime import datetime, timedelta

from loomlens.streaming import frames as Z

SCHEMA = "frame_id long, ts timestamp, roll_id string, expected long, failed boolean, is_defective boolean, num_defects int, points int"


def test_rolls_close_once(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def frame(i, minute, roll, expected, failed=False, verdict=None, n=0, points=0):
        return (i, start + timedelta(minutes=minute), roll, expected, failed, verdict, n, points)

    batches = [
        [frame(1, 0, "a", 3, n=2, points=2), frame(2, 1, "a", 3, failed=True, n=9, points=9), frame(2, 1, "a", 3, failed=True, n=9, points=9), frame(10, 2, "b", 5, verdict=True, points=4)],
        [frame(1, 0, "a", 3, n=2, points=2), frame(3, 5, "a", 3, verdict=False, n=1, points=None), frame(11, 6, "b", 5)],
        [frame(20, 600, "c", 1, verdict=True, points=1)],  # moves the watermark past roll b
        [frame(30, 1200, "d", 2)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    found = Z.run_to_parquet(Z.finished_rolls(stream, delay="30 minutes", idle_ms=3_600_000), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    rows = sorted((r.roll_id, r.total, r.defective, r.points, r.passed, r.complete) for r in found)
    assert rows == [("a", 3, 1, 2, 2, True), ("b", 2, 1, 4, 1, False), ("c", 1, 1, 1, 0, True)]
