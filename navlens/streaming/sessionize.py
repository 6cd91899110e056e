"""Streaming sessionisation of raw events (extension E1, streaming form).

``events`` arrive as files. Every micro-batch merges its events into the open
sessions that earlier batches left, closes the sessions that no event can join
any more, and leaves the rest open:

* the *watermark* is the newest event time of the batches before, less
  ``lateness``. Rows below it, and rows without a time, go to a table of their
  own (``late``) with all their columns; they are in no session and change none;
* a batch's events are first cut into sessions of their own
  (:func:`~navlens.operators.sequence.session_numbers`, balanced for hot users),
  so only a row per session meets the open ones, in a window by user;
* a session is closed when its last event plus the gap is below the new
  watermark: every later row that is on time starts another one. So the closed
  sessions are those of all on-time rows, in whatever order they came;
* at the end of input :func:`finish` closes what is still open.

State and output live in one table per batch, ``sessions/batch=N``, parted by
``is_open``. A batch reads the open part of batch N - 1 only and overwrites its
own folders; its last step writes ``marks/batch=N``, which makes it visible.
A batch that fails half-way is run again by Spark from the same files and the
same state, so nothing is lost or doubled, and a restarted run goes on from the
checkpoint. Executors may be lost at any time: nothing is kept in them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navlens.operators.sequence import session_numbers
from navlens.session import scratch_path

GAP_SECONDS = 12 * 3600
#: How far an event may lag behind the newest one of earlier batches.
LATENESS_SECONDS = 24 * 3600
SESSION_COLUMNS = ["user_id", "session_start", "session_end", "last_event_ts", "first_event_id", "events"]


def batch_sessions(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """The sessions of a finite ``events`` table, one row each."""
    numbered = session_numbers(events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", gap_seconds)
    return numbered.groupBy("user_id", "sn").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("last_event_ts"),
        F.min("event_id").alias("first_event_id"), F.count(F.lit(1)).alias("events")).drop("sn")


def merge_sessions(sessions: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Sessions of one user that are no more than the gap apart become one.

    Both inputs of a batch are sessions already, so a user has at most a row
    per gap and batch here, however many events.
    """
    gap = F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    w = Window.partitionBy("user_id").orderBy("session_start", "last_event_ts", "first_event_id")
    before = F.max("last_event_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = sessions.withColumn("_new", F.when(F.col("session_start") <= before + gap, 0).otherwise(1))
    numbered = marked.withColumn("_sn", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "_sn").agg(
        F.min("session_start").alias("session_start"), F.max("last_event_ts").alias("last_event_ts"),
        F.min("first_event_id").alias("first_event_id"), F.sum("events").alias("events")).drop("_sn")


def _ntz(time) -> Column:
    """A naive time as a literal, whatever the session's zone."""
    return F.lit(None if time is None else time.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


@dataclass
class SessionStream:
    """A session stream over the files of ``events_dir`` with its tables under ``out`` (kept between runs)."""

    spark: SparkSession
    events_dir: str
    out: str
    file_glob: str = "events.parquet"
    gap_seconds: int = GAP_SECONDS
    lateness_seconds: int = LATENESS_SECONDS
    max_files: int = 1

    @cached_property
    def events_schema(self) -> T.StructType:
        return self.spark.read.option("pathGlobFilter", self.file_glob).parquet(self.events_dir).schema

    @cached_property
    def _stored(self) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in self.events_schema}
        return (f"user_id {kinds['user_id']}, session_start timestamp_ntz, last_event_ts timestamp_ntz,"
                f" first_event_id {kinds['event_id']}, events long")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")

    @cached_property
    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, table: str, schema: str, last: int) -> DataFrame:
        """The folders ``batch=0 .. last`` of a table; Spark prunes the others, committed or not."""
        if not self._fs.exists(self._path(table)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.out}/{table}")
        return rows.where(F.col("batch") <= last).drop("batch")

    def _batches(self, table: str) -> list[int]:
        """Numbers of the batches whose folder of a table is complete."""
        if not self._fs.exists(self._path(table)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(table))]
        return sorted(int(n.split("=")[1]) for n in found if self._fs.exists(self._path(f"{table}/{n}/_SUCCESS")))

    def last_batch(self) -> int:
        return max(self._batches("marks"), default=-1)

    def _mark(self, name: str):
        return self.spark.read.schema("watermark timestamp_ntz").parquet(f"{self.out}/{name}").first()[0]

    def state(self, batch_id: int) -> tuple[object, DataFrame | None]:
        """(watermark, open sessions) behind a batch; a flush of that batch leaves no session open."""
        if batch_id in self._batches("flushes"):
            return self._mark(f"flushes/batch={batch_id}"), None
        if batch_id not in self._batches("marks"):
            return None, None
        rows = self.spark.read.schema(f"{self._stored}, is_open boolean").parquet(f"{self.out}/sessions/batch={batch_id}")
        return self._mark(f"marks/batch={batch_id}"), rows.where("is_open").drop("is_open")

    def of_batch(self, events: DataFrame, batch_id: int) -> None:
        """One micro-batch: late rows out, sessions merged, the closed ones marked, the batch committed."""
        watermark, open_ = self.state(batch_id - 1)
        late = F.col("ts").isNull()
        if watermark is not None:
            late |= F.col("ts") < _ntz(watermark)
        events.where(late).write.mode("overwrite").parquet(f"{self.out}/late/batch={batch_id}")
        newest = events.agg(F.max("ts") - F.expr(f"INTERVAL {int(self.lateness_seconds)} SECONDS")).first()[0]
        after = newest if watermark is None or newest is not None and newest > watermark else watermark
        sessions = batch_sessions(events.where(~late), self.gap_seconds)
        if open_ is not None:
            sessions = merge_sessions(sessions.unionByName(open_), self.gap_seconds)
        self._write(sessions, after, f"batch={batch_id}")
        self._commit(after, f"marks/batch={batch_id}")
        # only the newest open sessions are read again, or those before them if this batch's commit was not seen
        self._fs.delete(self._path(f"sessions/batch={batch_id - 2}/is_open=true"), True)

    def _write(self, sessions: DataFrame, watermark, name: str) -> None:
        still = F.lit(True)
        if watermark is not None:
            still = F.col("last_event_ts") + F.expr(f"INTERVAL {int(self.gap_seconds)} SECONDS") >= _ntz(watermark)
        (sessions.withColumn("is_open", still).write.mode("overwrite").partitionBy("is_open")
         .parquet(f"{self.out}/sessions/{name}"))

    def _commit(self, watermark, name: str) -> None:
        mark = self.spark.range(1).select(_ntz(watermark).alias("watermark"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.out}/{name}")

    def run(self) -> int:
        """Process the files that are there, after those of earlier runs; the number of the last batch (-1: none)."""
        events = (self.spark.readStream.schema(self.events_schema).option("pathGlobFilter", self.file_glob)
                  .option("maxFilesPerTrigger", self.max_files).parquet(self.events_dir))
        query = (events.writeStream.foreachBatch(self.of_batch)
                 .option("checkpointLocation", f"{self.out}/source").trigger(availableNow=True).start())
        query.awaitTermination()
        return self.last_batch()

    def finish(self) -> None:
        """End of input: the open sessions are closed, and rows that come yet and could join them are late.

        May be repeated: the flush of a batch overwrites itself.
        """
        last = self.last_batch()
        watermark, open_ = self.state(last)
        if open_ is None:
            return
        end = open_.agg(F.max("last_event_ts") + F.expr(f"INTERVAL {int(self.gap_seconds)} SECONDS 1 MICROSECOND")).first()[0]
        after = end if end is not None and (watermark is None or end > watermark) else watermark
        open_.withColumn("is_open", F.lit(False)).write.mode("overwrite").partitionBy("is_open").parquet(
            f"{self.out}/flushed/batch={last}")
        self._commit(after, f"flushes/batch={last}")

    def sessions(self) -> DataFrame:
        """The closed sessions of all committed batches and flushes."""
        stored = f"{self._stored}, is_open boolean"
        rows = self._read("sessions", stored, self.last_batch()).unionByName(
            self._read("flushed", stored, max(self._batches("flushes"), default=-1)))
        end = F.col("last_event_ts") + F.expr(f"INTERVAL {int(self.gap_seconds)} SECONDS 1 MICROSECOND")
        return rows.where("not is_open").withColumn("session_end", end).select(*SESSION_COLUMNS)

    def late(self) -> DataFrame:
        """The late rows of all committed batches, with the columns of the events."""
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.events_schema)
        return self._read("late", kinds, self.last_batch())


def run_session_stream(spark: SparkSession, events_dir: str, out: str | None = None, **kw) -> SessionStream:
    """Run a stream over everything available now and close it; the stream with its tables."""
    stream = SessionStream(spark, events_dir, out or scratch_path(spark, "session-stream"), **kw)
    stream.run()
    stream.finish()
    return stream
