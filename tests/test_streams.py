"""Streams over several files: late rows, copies and quarantine."""

import pytest
from pyspark.sql import functions as F

from attestor.streaming import stream

SCHEMA = "event_id long, ts timestamp, user_id long, value double"


@pytest.fixture
def source(spark, tmp_path):
    """One file per batch, read in the order in which they were written."""
    import os
    import time

    def make(*batches):
        for n, rows in enumerate(batches):
            df = spark.createDataFrame([(i, t, u, v) for i, t, u, v in rows], "event_id long, t string, user_id long, value double")
            out = tmp_path / f"b{n}"
            df.select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "value").coalesce(1).write.parquet(str(out))
            for file in out.glob("*.parquet"):
                os.utime(file, (time.time() - 1000 + n * 10,) * 2)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b*")
    return make


def test_late_rows_are_dropped(spark, source):
    events = source([(1, "2024-01-01 00:10:00", 1, 1.0), (2, "2024-01-01 00:20:00", 1, 9.0)],
                    [(3, "2024-01-01 03:00:00", 1, 1.0)],
                    # late rows are told by the watermark that the batch before started with
                    [(7, "2024-01-01 03:01:00", 1, 1.0)],
                    [(4, "2024-01-01 00:30:00", 1, 9.0), (5, "2024-01-01 05:00:00", 1, 1.0)])
    found = stream.run_available(stream.stream_quality(events, F.col("value") > 5), "t")
    rows = {r.window_start.hour: (r.n_rows, r.n_defects, r.dpmo) for r in found.collect()}
    assert rows == {0: (2, 1, 500000.0), 3: (2, 0, 0.0)}


def test_windows_still_open_at_the_end_are_written(spark, source):
    events = source([(1, "2024-01-01 00:10:00", 1, 1.0)], [(2, "2024-01-01 00:20:00", 1, 9.0)], [(3, "2024-01-01 03:00:00", 1, 1.0)])
    found = stream.run_updates(stream.stream_quality(events, F.col("value") > 5), ["window_start"], "t")
    assert {r.window_start.hour: (r.n_rows, r.n_defects) for r in found.collect()} == {0: (2, 1), 3: (1, 0)}


def test_first_arrival_does_not_depend_on_batches(spark, source):
    rows = [(n, f"2024-01-01 00:0{n % 10}:00", n % 3, float(n)) for n in range(30)]
    events = source(rows[:10], rows[10:11], rows[11:])
    found = stream.run_available(stream.stream_first(events, ["user_id"]), "t")
    assert sorted(r.user_id for r in found.collect()) == [0, 1, 2]


def test_first_arrival_passes_and_state_ends_with_the_watermark(spark, source):
    events = source([(1, "2024-01-01 00:00:00", 1, 1.0), (2, "2024-01-01 00:01:00", 1, 1.0)],
                    [(3, "2024-01-01 00:02:00", 1, 1.0), (4, "2024-01-01 09:00:00", 2, 1.0)],
                    # state is cleared at the end of the batch that starts with the new watermark
                    [(7, "2024-01-01 09:01:00", 2, 1.0)],
                    [(5, "2024-01-01 09:05:00", 1, 1.0), (6, "2024-01-01 09:05:00", 2, 1.0)])
    found = stream.run_available(stream.stream_first(events, ["user_id"]), "t")
    assert {(r.user_id, r.event_id in (5,)) for r in found.collect()} == {(1, False), (1, True), (2, False)}


def test_quarantine(spark, source):
    events = source([(1, "2024-01-01 00:00:00", 1, 1.0), (2, "2024-01-01 00:00:00", 7, 99.0), (3, "2024-01-01 00:00:00", None, None)])
    parent = spark.createDataFrame([(1,)], "id long")
    checked = stream.run_available(
        stream.stream_validate(events, {"value": F.col("value") < 50}, parent, ("user_id", "id")), "t")
    assert {r.event_id: r.broken for r in checked.collect()} == {1: [], 2: ["value", "reference"], 3: []}
    assert stream.good_rows(checked).count() == 2 and stream.quarantined_rows(checked).count() == 1
