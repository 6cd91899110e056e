"""A table by day follows its files: one changed day rewrites one folder."""

import os
import time

import pytest
from pyspark.sql import functions as F

from navlens.session import scratch_path
from navlens.sources import readers as RD
from navlens.sources.incremental import DayTable


def day_of(path):
    return F.regexp_extract(path, r"day=([0-9-]+)", 1).try_cast("date")


class Days:
    def __init__(self, spark, reach=(0,)):
        self.spark, self.folder, self.reads = spark, scratch_path(spark, "in"), []
        self.table = DayTable(spark, scratch_path(spark, "by-day"), self.build, day_of, reach)

    def put(self, day, values, name="a"):
        path = f"{self.folder}/day={day}/{name}.parquet"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = scratch_path(self.spark, "part")
        self.spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.parquet(part)
        os.replace(f"{part}/{next(n for n in os.listdir(part) if n.endswith('.parquet'))}", path)
        os.utime(path, (time.time() + len(values), time.time() + len(values)))
        return path

    def build(self, paths):
        self.reads.append(sorted(p.split("day=")[1][:10] for p in paths))
        return (self.spark.read.parquet(*paths).select("v", day_of(F.col("_metadata.file_path")).alias("day"))
                .groupBy("day").agg(F.sum("v").alias("total")))

    def refresh(self):
        return self.table.refresh(RD.file_listing(self.spark, self.folder, "*.parquet"))

    def rows(self):
        return {str(r.day): r.total for r in self.table.read().collect()}

    def stamps(self):
        out = {}
        for day in os.listdir(f"{self.table.path}/rows"):
            if day.startswith("day="):
                out[day[4:]] = sorted(os.listdir(f"{self.table.path}/rows/{day}"))
        return out


def test_one_changed_day_rewrites_one_folder(spark):
    d = Days(spark)
    for k in range(1, 5):
        d.put(f"2024-01-0{k}", [k, 10])
    assert d.refresh() == [f"2024-01-0{k}" for k in range(1, 5)]
    assert d.rows() == {f"2024-01-0{k}": k + 10 for k in range(1, 5)}
    before = d.stamps()
    d.put("2024-01-03", [1, 1, 1])
    assert d.refresh() == ["2024-01-03"] and d.reads[-1] == ["2024-01-03"]
    after = d.stamps()
    assert d.rows()["2024-01-03"] == 3
    assert {k for k in before if before[k] != after[k]} == {"2024-01-03"}
    assert d.refresh() == [] and len(d.reads) == 2


def test_new_and_deleted_files(spark):
    d = Days(spark)
    d.put("2024-01-01", [1])
    d.refresh()
    second = d.put("2024-01-01", [5], "b")
    d.put("2024-01-02", [7])
    assert d.refresh() == ["2024-01-01", "2024-01-02"] and d.rows() == {"2024-01-01": 6, "2024-01-02": 7}
    os.remove(second)
    os.remove(f"{d.folder}/day=2024-01-02/a.parquet")
    assert d.refresh() == ["2024-01-01", "2024-01-02"] and d.rows() == {"2024-01-01": 1}


def test_failed_refresh_is_repeated(spark, monkeypatch):
    d = Days(spark)
    d.put("2024-01-01", [1])
    d.refresh()
    d.put("2024-01-01", [2, 2])
    whole = d.table.build
    d.table.build = lambda paths: whole(paths).withColumn("total", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        d.refresh()
    assert d.rows() == {"2024-01-01": 1}
    d.table.build = whole
    assert d.refresh() == ["2024-01-01"] and d.rows() == {"2024-01-01": 4}


def test_days_that_reach_into_the_next(spark):
    d = Days(spark, reach=(0, 1))
    seen = []

    def build(paths):  # a day's total holds the day before
        seen.append(sorted(p.split("day=")[1][:10] for p in paths))
        rows = d.spark.read.parquet(*paths).select("v", day_of(F.col("_metadata.file_path")).alias("d"))
        return rows.select("v", F.explode(F.array("d", F.date_add("d", 1))).alias("day")).groupBy("day").agg(F.sum("v").alias("total"))

    d.table.build = build
    for k in (1, 2, 3, 4):
        d.put(f"2024-01-0{k}", [k])
    d.refresh()
    assert d.rows() == {"2024-01-01": 1, "2024-01-02": 3, "2024-01-03": 5, "2024-01-04": 7, "2024-01-05": 4}
    d.put("2024-01-02", [2, 20])
    assert d.refresh() == ["2024-01-02", "2024-01-03"]
    assert seen[-1] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert d.rows() == {"2024-01-01": 1, "2024-01-02": 23, "2024-01-03": 25, "2024-01-04": 7, "2024-01-05": 4}


def test_listing_without_days(spark):
    d = Days(spark)
    with pytest.raises(ValueError, match="refreshed"):
        d.table.read()
    assert d.table.refresh(spark.createDataFrame([], "path string, modified timestamp, length long")) == []
    with pytest.raises(ValueError, match="no day"):
        d.table.refresh(spark.sql("select 'x/y.parquet' as path, current_timestamp() as modified, 1L as length"))
