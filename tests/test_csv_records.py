"""The parallel CSV reader against Python's csv module, over byte ranges of any size."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from navlens.session import scratch_path
from navlens.sources import readers as RD
from navlens.sources.csv_records import read_csv_columns

rnd = random.Random(4)


def write(folder, name, rows, fields, **kw):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fields, **kw)
        w.writeheader()
        w.writerows(rows)


def expected(folder, names):
    out = []
    for name in sorted(os.listdir(folder)):
        with open(f"{folder}/{name}", newline="", encoding="utf-8-sig") as f:
            out += [tuple(r.get(n) or "" for n in names) for r in csv.DictReader(f)]
    return out


def got(spark, folder, names):
    rows = read_csv_columns(spark, folder, names).orderBy("_order")
    return [tuple(r[n] or "" for n in names) for r in rows.collect()]


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def text():
    return "".join(rnd.choices(['"', "\n", ",", "a", "b ", "é", "x" * 40, "\r\n", "\n\n", "'"], k=rnd.randint(0, 12)))


def test_records_over_lines_and_ranges(spark, small_ranges):
    folder = scratch_path(spark, "csv")
    for k in range(3):
        write(folder, f"{k}.csv", [{"a": str(i), "b": text(), "c": text()} for i in range(400)], ["a", "b", "c"])
    write(folder, "3.csv", [{"a": "1", "b": "line\n" * 2000, "c": "a record over many ranges"}, {"a": "2"}], ["a", "b", "c"])
    assert read_csv_columns(spark, folder, ["a"]).rdd.getNumPartitions() > 50
    assert got(spark, folder, ["a", "b", "c"]) == expected(folder, ["a", "b", "c"])


def test_one_large_file_gives_many_tasks_without_python(spark, small_ranges):
    folder = scratch_path(spark, "csv")
    rows = [{"a": str(i), "b": f'say "{i}", then go', "c": ""} for i in range(1000)]
    write(folder, "one.csv", rows, ["a", "b", "c"], lineterminator="\r\n")
    df = read_csv_columns(spark, folder, ["a", "b", "c"])
    assert df.rdd.getNumPartitions() > 20
    assert "MapInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    assert got(spark, folder, ["a", "b", "c"]) == expected(folder, ["a", "b", "c"])


def test_each_file_by_its_own_header(spark):
    folder = scratch_path(spark, "csv")
    write(folder, "0.csv", [{"a": "a0", "b": "b0"}], ["a", "b"])
    write(folder, "1.csv", [{"b": "b1", "x": "x1", "a": "a1"}, {"b": "two\nlines", "a": "a2", "x": ""}], ["b", "x", "a"])
    write(folder, "2.csv", [{"c": "c3"}], ["c"])
    assert got(spark, folder, ["a", "b", "c"]) == expected(folder, ["a", "b", "c"]) == [
        ("a0", "b0", ""), ("a1", "b1", ""), ("a2", "two\nlines", ""), ("", "", "c3")]


def test_files_of_other_column_order_load_right(spark):
    folder = scratch_path(spark, "csv")
    write(folder, "0.csv", [{"watchID": "1", "clientID": "c1", "URL": "/a", "dateTime": "2024-01-01 00:00:00", "title": "t"}],
          ["watchID", "clientID", "URL", "dateTime", "title"])
    write(folder, "1.csv", [{"watchID": "2", "clientID": "c2", "URL": "/b", "dateTime": "2024-01-02 00:00:00", "title": "u"}],
          ["URL", "watchID", "title", "clientID", "dateTime"])
    rows = {r.watch_id: (r.client_id, r.url, r.title) for r in RD.read_hits_csv(spark, folder).collect()}
    assert rows == {"1": ("c1", "/a", "t"), "2": ("c2", "/b", "u")}


def test_odd_files(spark):
    folder = scratch_path(spark, "csv")
    os.makedirs(folder)
    for name, content in {"empty.csv": "", "head.csv": "a,b\n", "bom.csv": "﻿a,b\r\n1,2\r\n\r\n3,4", "short.csv": "a,b\n5\n6,7,8\n",
                          "twice.csv": "a,a\n9,10\na,a\n"}.items():
        with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
            f.write(content)
    rows = sorted((r.a, r.b) for r in read_csv_columns(spark, folder, ["a", "b"]).select(
        F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")).collect())
    assert rows == [("1", "2"), ("10", ""), ("3", "4"), ("5", ""), ("6", "7")]
    with open(f"{folder}/bad.csv", "w") as f:
        f.write('a,"b\nc"\n1,2\n')
    with pytest.raises(ValueError, match="several lines"):
        read_csv_columns(spark, folder, ["a"])


def test_a_quote_that_is_never_closed(spark):
    folder = scratch_path(spark, "csv")
    os.makedirs(folder)
    with open(f"{folder}/x.csv", "w") as f:
        f.write('a,b\n1,2\n3,"open\nrest\n')
    rows = read_csv_columns(spark, folder, ["a", "b"]).orderBy("_order").collect()
    assert [r.a for r in rows] == ["1", "3"]


def test_no_file_has_rows(spark):
    folder = scratch_path(spark, "csv")
    os.makedirs(folder)
    with open(f"{folder}/x.csv", "w"):
        pass
    assert read_csv_columns(spark, folder, ["a"]).collect() == []
