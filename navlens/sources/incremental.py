"""Tables by day that follow their input files: only days whose files changed are computed again.

The input is a listing of files (path, modified, length), each of one day. A
refresh compares it with the listing of the last refresh (the same diff as for
object listings), reads the files of the days that changed, and overwrites those
days' folders, and no others, by Spark's dynamic partition overwrite. Days whose
last file is gone are removed. The new listing is stored last: a refresh that
fails is repeated by the next one, day by day with the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navlens.operators.snapshot import snapshot_diff

_LISTING = "path string, version string, day date"


class DayTable:
    """A table of ``day=YYYY-MM-DD`` folders at ``path``, built by ``build`` from the files of the days it is given."""

    def __init__(self, spark: SparkSession, path: str, build: Callable[[Sequence[str]], DataFrame],
                 day_of: Callable[[Column], Column], reach: Sequence[int] = (0,)):
        """``build(paths)`` gives rows with a ``day``; ``day_of`` takes a path to its day.

        ``reach`` lists how many days later an input day shows in the output, e.g. (0, 1) where the rows of a day also
        depend on the day before. ``build`` gets all input files of the days that are to be written; rows of other
        days that it makes from them are dropped.
        """
        self.spark, self.path, self.build, self.day_of, self.reach = spark, path.rstrip("/"), build, day_of, list(reach)

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _fs(self):
        return self._hadoop("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listings(self) -> list[int]:
        if not self._fs.exists(self._hadoop("listings")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop("listings"))]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._hadoop(f"listings/{n}/_SUCCESS")))

    def _last(self) -> DataFrame:
        done = self._listings()
        if not done:
            return self.spark.createDataFrame([], _LISTING)
        return self.spark.read.schema(_LISTING).parquet(f"{self.path}/listings/{done[-1]}")

    def refresh(self, listing: DataFrame) -> list[str]:
        """Bring the table up to ``listing`` (path, modified, length); the days that were written or removed."""
        version = F.concat_ws(":", F.col("length").cast("string"), F.col("modified").cast("string"))
        now = listing.select("path", version.alias("version"), self.day_of(F.col("path")).alias("day"))
        if now.where("day is null").limit(1).count():
            raise ValueError("a listed file has no day in its path")
        number = (self._listings() or [0])[-1] + 1
        staged = f"{self.path}/listings/{number}"
        kept = f"{self.path}/staged-{uuid.uuid4().hex}"
        now.write.parquet(kept)  # one listing decides what is read and what is remembered
        now = self.spark.read.schema(_LISTING).parquet(kept)
        before = self._last()
        changed = snapshot_diff(before.select("path", "version"), now.select("path", "version")).where(
            "status <> 'not_modified'").select("path")
        days = before.unionByName(now).join(changed, "path", "left_semi").select("day").distinct()
        shown = days.select(F.explode(F.array(*[F.date_add("day", r) for r in self.reach])).alias("day")).distinct()
        out = sorted(r.day for r in shown.collect())  # at most a row per day of the calendar
        if out:
            wanted = [F.lit(str(d)).cast("date") for d in out]
            needed = F.arrays_overlap(F.array(*[F.date_add("day", r) for r in self.reach]), F.array(*wanted))
            paths = [r.path for r in now.where(needed).select("path").collect()]
            if paths:
                rows = self.build(paths).where(F.col("day").isin(wanted))
                (rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("day").parquet(f"{self.path}/rows"))
            still = {r.day for r in now.where(needed).select(F.explode(F.array(*[F.date_add("day", r) for r in self.reach]))
                                                            .alias("day")).distinct().collect()}
            for d in out:
                if d not in still:
                    self._fs.delete(self._hadoop(f"rows/day={d}"), True)
        now.coalesce(1).write.mode("overwrite").parquet(staged)
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(kept), True)
        return [str(d) for d in out]

    def read(self) -> DataFrame:
        if not self._fs.exists(self._hadoop("rows")):
            raise ValueError(f"{self.path} has never been refreshed")
        return self.spark.read.parquet(f"{self.path}/rows")
