"""Distinct counts of many, possibly overlapping periods from one state per day.

Clients, hit ids and URLs get gapless numbers in an append-only dictionary, and a
day keeps the exact set of its numbers as bitmaps. A period is the union of its
days' bitmaps, so thirty overlapping weeks read each day's bitmaps once and no
visit. A day that lies partly in a period is read from its rows for that period.

One writer at a time. A failed ``write_days`` is repeated with the same result:
numbers are given once, and a day's rows are replaced as a whole. Days that were
never written have no visits. Visits without a time belong to no day; empty and
NULL clients and URLs are in no set; a hit id that stands in several rows of
``hits`` counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navlens.functions.scalars import nonempty_or_null
from navlens.operators.linkage import watch_id_bridge, with_canonical_ids
from navlens.operators.release import _lit_ts, _ts, period_table

FIELDS = ("client", "hit", "url")
_DICTIONARY = "field string, value string, n bigint"
_STATE = ("field string, bucket bigint, bits binary, visits bigint, first_time timestamp_ntz, last_time timestamp_ntz, "
          "day date")


def _elements(keyed: DataFrame, key: str, hits: DataFrame, bridge: DataFrame | None) -> DataFrame:
    """Distinct ``(key, field, value)`` of the visits and of the hits they list."""
    if bridge is None:
        ids = watch_id_bridge(keyed, keep=[key])
    else:
        ids = bridge.select("visit_id", "watch_id").join(keyed.select("visit_id", key), "visit_id")
    ids = with_canonical_ids(ids.select(key, "watch_id")).distinct()
    found = ids.join(with_canonical_ids(hits.select("watch_id", "url")), "watch_id").select(key, F.inline(F.array(
        F.struct(F.lit("hit").alias("field"), F.col("watch_id").alias("value")),
        F.struct(F.lit("url").alias("field"), nonempty_or_null("url").alias("value")))))
    clients = keyed.select(key, F.lit("client").alias("field"), nonempty_or_null("client_id").alias("value"))
    return clients.unionByName(found).where("value is not null").distinct()


class DailyState:
    """Bitmaps by day under ``path``.

    ``rows_of(days)`` gives ``(visits, hits, bridge)`` of ISO days: the visits of those days, the hits to look their ids
    up in, and their stored ``(visit_id, pos, watch_id)`` rows or None where the ids stand in the visits.
    """

    def __init__(self, spark: SparkSession, path: str,
                 rows_of: Callable[[Sequence[str]], tuple[DataFrame, DataFrame, DataFrame | None]]):
        self.spark, self.path, self.rows_of = spark, path.rstrip("/"), rows_of

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _fs(self):
        return self._hadoop("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        if not self._fs.exists(self._hadoop("dictionary")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop("dictionary"))]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._hadoop(f"dictionary/{n}/_SUCCESS")))

    def dictionary(self) -> DataFrame:
        """``(field, value, n)``: every value seen, numbered from 1 without gaps in each field."""
        done = self._generations()
        if not done:
            return self.spark.createDataFrame([], _DICTIONARY)
        return self.spark.read.schema(_DICTIONARY).parquet(*[f"{self.path}/dictionary/{g}" for g in done])

    def state(self) -> DataFrame:
        if not self._fs.exists(self._hadoop("days")):
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/days")

    def _number(self, values: DataFrame):
        """Append the values that have no number yet.

        They are spread by hash and numbered inside each part, above the parts before it and the dictionary's last number.
        """
        known = self.dictionary()
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        new = values.select("field", "value").distinct().join(known, ["field", "value"], "left_anti").withColumn(
            "part", F.pmod(F.xxhash64("value"), F.lit(parts)))
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        new.write.parquet(staged)  # counted and numbered from the same rows
        new = self.spark.read.parquet(staged)
        before = Window.partitionBy("field").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = new.groupBy("field", "part").count().select(  # a row per field and part
            "field", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"))
        last = known.groupBy("field").agg(F.max("n").alias("last"))
        place = F.row_number().over(Window.partitionBy("field", "part").orderBy("value"))
        out = new.withColumn("place", place).join(base, ["field", "part"]).join(last, "field", "left").select(
            "field", "value", (F.coalesce("last", F.lit(0)) + F.col("below") + F.col("place")).cast("bigint").alias("n"))
        number = (self._generations() or [0])[-1] + 1
        out.write.mode("overwrite").parquet(f"{self.path}/dictionary/{number}")
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    def _bitmaps(self, elements: DataFrame, key: str) -> DataFrame:
        """``(key, field, bucket, bits)`` of distinct ``(key, field, value)``; all values are in the dictionary."""
        return elements.join(self.dictionary(), ["field", "value"]).groupBy(
            key, "field", F.bitmap_bucket_number("n").alias("bucket")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))

    def write_days(self, days: Sequence[str]):
        """Compute the state of ``days`` (ISO dates) from their rows, in place of what it was."""
        if not days:
            return
        visits, hits, bridge = self.rows_of(days)
        wanted = [F.lit(str(d)).cast("date") for d in days]
        keyed = visits.withColumn("day", F.to_date("date_time")).where(F.col("day").isin(wanted))
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        _elements(keyed, "day", hits, bridge).write.parquet(staged)
        elements = self.spark.read.parquet(staged)
        self._number(elements)
        asked = self.spark.range(1).select(F.explode(F.array(*wanted)).alias("day"))
        stats = asked.join(keyed.groupBy("day").agg(
            F.count(F.lit(1)).alias("visits"), F.min("date_time").alias("first_time"),
            F.max("date_time").alias("last_time")), "day", "left").na.fill(0, ["visits"])
        # every row of a day carries the day's time range, so a reader sees whether the day lies whole in a period
        rows = self._bitmaps(elements, "day").withColumn("visits", F.lit(0).cast("bigint")).join(
            stats.select("day", "first_time", "last_time"), "day")
        total = stats.select("*", F.lit("visits").alias("field"), F.lit(0).cast("bigint").alias("bucket"),
                             F.lit(None).cast("binary").alias("bits"))
        (rows.unionByName(total).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(f"{self.path}/days"))
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    def counts(self, periods: Sequence[tuple]) -> DataFrame:
        """``(release_ord, visits, client, hit, url)``: visits and distinct values of each period ``(name, start, end)``
        that has visits. The driver gets the days that lie partly in a period, at most two a period."""
        periods = list(periods)
        state = self.state()
        bounds = [(i + 1, _lit_ts(s), _lit_ts(e)) for i, (_, s, e) in enumerate(periods)]
        first, last = F.col("first_time"), F.col("last_time")

        def periods_where(inside):
            tags = F.array(*[F.when(inside(s, e), F.lit(i)) for i, s, e in bounds])
            return state.where(reached).withColumn("release_ord", F.explode(F.filter(tags, lambda t: t.isNotNull())))

        reached = F.col("day").between(F.to_date(_lit_ts(min(_ts(s) for _, s, _ in periods))),
                                       F.to_date(_lit_ts(max(_ts(e) for _, _, e in periods))))
        whole = periods_where(lambda s, e: (first >= s) & (last <= e))
        cut = periods_where(lambda s, e: (first <= e) & (last >= s) & ~((first >= s) & (last <= e)))
        pairs = cut.where("field = 'visits'").select("day", "release_ord").distinct().collect()
        sets = whole.where("field <> 'visits'").select("release_ord", "field", "bucket", "bits")
        visits = whole.where("field = 'visits'").groupBy("release_ord").agg(F.sum("visits").alias("visits"))
        if pairs:
            raw, hits, bridge = self.rows_of(sorted({str(p.day) for p in pairs}))
            by_period: dict[int, list] = {}
            for p in pairs:
                by_period.setdefault(p.release_ord, []).append(F.lit(str(p.day)).cast("date"))
            time, day = F.col("date_time"), F.to_date("date_time")
            tags = F.array(*[F.when(time.between(s, e) & day.isin(by_period[i]), F.lit(i))
                             for i, s, e in bounds if i in by_period])
            keyed = raw.withColumn("release_ord", F.explode(F.filter(tags, lambda t: t.isNotNull())))
            sets = sets.unionByName(self._bitmaps(_elements(keyed, "release_ord", hits, bridge), "release_ord"))
            visits = visits.unionByName(keyed.groupBy("release_ord").agg(F.count(F.lit(1)).alias("visits"))).groupBy(
                "release_ord").agg(F.sum("visits").alias("visits"))
        merged = sets.groupBy("release_ord", "field", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("k"))
        sizes = merged.groupBy("release_ord").agg(
            *[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("k"))), F.lit(0)).alias(f) for f in FIELDS])
        return visits.join(sizes, "release_ord", "left").na.fill(0, list(FIELDS))

    def _per_period(self, periods) -> DataFrame:
        return period_table(self.spark, periods).join(self.counts(periods), "release_ord", "left").na.fill(
            0, ["visits", *FIELDS])

    def release_info(self, periods: Sequence[tuple]) -> DataFrame:
        """Visits, matched hits and distinct clients of each period, as ``release.release_info`` gives them."""
        return self._per_period(periods).select(
            "release_ord", "version", "period_start", "period_end", F.col("visits").alias("total_visits"),
            F.col("hit").alias("total_hits"), F.col("client").alias("unique_clients"))

    def pageview_metrics(self, periods: Sequence[tuple]) -> DataFrame:
        """Matched hits and distinct URLs of each period, as ``release.pageview_metrics`` gives them."""
        return self._per_period(periods).select("release_ord", "version", F.col("hit").alias("total_count"),
                                                F.col("url").alias("unique_urls"))
