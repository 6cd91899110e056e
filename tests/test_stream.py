"""The session stream writes the sessions of all rows that are on time, over restarts, failures and late rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from navlens.session import scratch_path
from navlens.sources.fixtures import clickstream
from navlens.streaming.sessionize import SESSION_COLUMNS, SessionStream, batch_sessions, run_session_stream

SF = "/root/testdata/sf0.001"


def whole(events):
    end = F.col("last_event_ts") + F.expr("INTERVAL '12:00:00.000001' HOUR TO SECOND")
    return batch_sessions(events).withColumn("session_end", end).select(*SESSION_COLUMNS)


def same(a, b):
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def drop_in(rows, folder, number):
    """``rows`` as one file of the folder, the ``number``-th by time of change."""
    part = scratch_path(rows.sparkSession, "part")
    rows.coalesce(1).write.parquet(part)
    name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.link(f"{part}/{name}", f"{folder}/{number:03d}.parquet")
    os.utime(f"{folder}/{number:03d}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.fixture(scope="module")
def days(events):
    """Start days of eight stretches of about equal length."""
    found = sorted(r[0] for r in events.select(F.to_date("ts")).distinct().collect())
    return [found[len(found) * k // 8] for k in range(8)] + [found[-1] + dt.timedelta(days=1)]


def stretch(events, days, k):
    return events.where((F.col("ts") >= F.lit(str(days[k])).cast("timestamp_ntz"))
                        & (F.col("ts") < F.lit(str(days[k + 1])).cast("timestamp_ntz")))


def test_stream_sessions_equal_the_derived_visits(spark):
    out = run_session_stream(spark, SF).sessions()
    visits, _ = clickstream(spark, SF)
    joined = out.join(visits, out.first_event_id == visits.visit_id)
    assert out.count() == visits.count() == joined.count()
    assert joined.filter((F.col("events") != F.col("page_views")) | (F.col("session_start") != F.col("date_time"))).count() == 0


def test_files_in_time_order_and_restart_in_mid_input(spark, events, days):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    for k in range(5):
        drop_in(stretch(events, days, k), folder, k)
    stream = SessionStream(spark, folder, out, "*.parquet")
    assert stream.run() == 4
    before = stream.sessions()
    n = before.count()
    assert n > 0.5 * whole(events.where(F.col("ts") < F.lit(str(days[5])).cast("timestamp_ntz"))).count()
    for k in range(5, 8):
        drop_in(stretch(events, days, k), folder, k)
    again = SessionStream(spark, folder, out, "*.parquet")  # a new object: all state is in its tables
    assert again.run() == 7
    most = again.sessions().count()
    assert again.late().count() == 0
    again.finish()
    again.finish()
    assert same(again.sessions(), whole(events))
    assert most > 0.9 * whole(events).count()  # nearly all are closed by the watermark, few by the end of input


def test_failure_between_output_and_commit(spark, events, days):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    for k in range(8):
        drop_in(stretch(events, days, k), folder, k)

    class Failing(SessionStream):
        def _commit(self, watermark, name):
            if name == "marks/batch=3":
                raise RuntimeError("lost here")
            super()._commit(watermark, name)

    with pytest.raises(Exception, match="lost here"):
        Failing(spark, folder, out, "*.parquet").run()
    stream = SessionStream(spark, folder, out, "*.parquet")
    seen = stream.sessions().count()  # batch 3 has written its folder, but nobody sees it
    assert stream.last_batch() == 2
    assert stream.run() == 7
    stream.finish()
    assert seen < stream.sessions().count() and same(stream.sessions(), whole(events))


def test_late_rows_neither_double_nor_hide_a_session(spark, events, days):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    held = (F.col("event_id") % 7 == 0) & (F.col("ts") < F.lit(str(days[2])).cast("timestamp_ntz"))
    on_time = events.where(~held)
    for k in range(8):
        drop_in(stretch(on_time, days, k), folder, k)
    drop_in(events.where(held), folder, 8)
    stream = run_session_stream(spark, folder, out, file_glob="*.parquet")
    assert same(stream.late(), events.where(held)) and stream.late().count() > 0
    assert same(stream.sessions(), whole(on_time))


def test_rows_within_the_lateness_join_their_sessions(spark, events, days):
    folder = scratch_path(spark, "in")
    for k in range(8):  # newest first
        drop_in(stretch(events, days, 7 - k), folder, k)
    stream = run_session_stream(spark, folder, file_glob="*.parquet", lateness_seconds=40_000 * 86_400)
    assert same(stream.sessions(), whole(events)) and stream.late().count() == 0
    assert stream.sessions().agg(F.sum("events")).first()[0] == events.count()


def test_rows_after_the_end_of_input(spark, events, days):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    early = events.where(F.col("ts") < F.lit(str(days[4])).cast("timestamp_ntz"))
    drop_in(early, folder, 0)
    stream = run_session_stream(spark, folder, out, file_glob="*.parquet")
    assert same(stream.sessions(), whole(early))
    rest = events.where(F.col("ts") >= F.lit(str(days[4])).cast("timestamp_ntz"))
    drop_in(rest, folder, 1)
    stream = run_session_stream(spark, folder, out, file_glob="*.parquet")
    flushed_to = early.agg(F.max("ts") + F.expr("INTERVAL 43200 SECONDS 1 MICROSECOND")).first()[0]
    kept = rest.where(F.col("ts") >= F.lit(str(flushed_to)).cast("timestamp_ntz"))
    assert same(stream.late(), rest.exceptAll(kept))
    assert same(stream.sessions(), whole(early).unionByName(whole(kept)))


def test_rows_without_time_and_empty_files(spark, events):
    folder = scratch_path(spark, "in")
    drop_in(events.where("event_id < 50").withColumn("ts", F.when(F.col("event_id") % 5 > 0, F.col("ts"))), folder, 0)
    drop_in(events.where("false"), folder, 1)
    stream = run_session_stream(spark, folder, file_glob="*.parquet")
    assert stream.late().count() == events.where("event_id < 50 and event_id % 5 = 0").count()
    assert same(stream.sessions(), whole(events.where("event_id < 50 and event_id % 5 > 0")))
