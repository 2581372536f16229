"""Event windows on a stream: several micro-batches, late events, a restart."""

from datetime import datetime, timedelta

import pytest

from plumbline import streaming

SCHEMA = "ts timestamp, event_type string, value double"
START = datetime(2024, 1, 1)


def put(spark, folder, rows):
    spark.createDataFrame([(START + timedelta(hours=h), k, v) for h, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def place(tmp_path):
    return [str(tmp_path / x) for x in ("in", "out", "checkpoint")]


def told(df):
    return sorted((r.window_start, r.event_type, r.n, r.value) for r in df.collect())


def test_stream_equals_table(spark, place):
    """Files in order, one to a micro-batch: closed windows are those of the table, written once."""
    folder, out, checkpoint = place
    days = [[(24 * d + h, "ab"[h % 2], d + 0.5) for h in range(0, 24, 3)] for d in range(5)]
    for rows in days:
        put(spark, folder, rows)
    query = streaming.append_totals(streaming.event_stream(spark, folder), out, checkpoint)
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 5
    wanted = [r for r in told(streaming.windowed_totals(spark.read.parquet(folder))) if r[0] < START + timedelta(days=4)]
    assert told(spark.read.parquet(out)) == wanted and len(wanted) == 8


def test_late_events_are_dropped_and_a_restart_goes_on(spark, place):
    folder, out, checkpoint = place
    run = lambda: streaming.append_totals(streaming.event_stream(spark, folder, schema=SCHEMA), out, checkpoint, "1 hour", "2 hours").awaitTermination()
    put(spark, folder, [(0.1, "a", 1.0), (0.2, "a", 1.0), (5.5, "a", 2.0)])
    run()
    put(spark, folder, [(0.3, "a", 9.0), (4.5, "a", 3.0), (5.6, "b", 4.0)])  # the first is five hours late, the second one hour
    run()  # a new query from the checkpoint: nothing is read twice
    put(spark, folder, [(20.0, "z", 0.0)])
    run()
    at = lambda h: START + timedelta(hours=h)
    assert told(spark.read.parquet(out)) == [(at(0), "a", 2, 2.0), (at(4), "a", 1, 3.0), (at(5), "a", 1, 2.0), (at(5), "b", 1, 4.0)]


def test_running_totals(spark, place):
    folder, out, checkpoint = place
    for d in range(3):
        put(spark, folder, [(24 * d + h, "a", 1.0) for h in range(4)])
    streaming.running_totals(streaming.event_stream(spark, folder), out, checkpoint).awaitTermination()
    assert told(streaming.latest_totals(spark, out)) == told(streaming.windowed_totals(spark.read.parquet(folder)))
