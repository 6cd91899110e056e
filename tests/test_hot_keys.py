"""Keys with more rows than one task should sort: spread over all partitions whatever their times, same results."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from navlens.operators.sequence import ordinal_in_key, session_numbers, split_hot_keys, with_neighbors


T0 = dt.datetime(2024, 1, 1)


def order():
    return [F.col("t").asc_nulls_first(), F.col("id").asc()]


@pytest.fixture(scope="module")
def rows(spark):
    """Key 1: all within one hour; key 2: no times at all; key 3: one single time; key None; small others."""
    rnd = random.Random(2)
    out = [(1, T0 + dt.timedelta(microseconds=rnd.randrange(3600 * 10 ** 6))) for _ in range(4000)]
    out += [(2, None)] * 4000 + [(3, T0)] * 3000 + [(None, T0 + dt.timedelta(seconds=i)) for i in range(2500)]
    out += [(10 + i % 300, T0 + dt.timedelta(seconds=rnd.randrange(10 ** 6))) for i in range(3000)]
    rnd.shuffle(out)
    return spark.createDataFrame([(i, k, t, rnd.choice("abc")) for i, (k, t) in enumerate(out)],
                                 "id long, k long, t timestamp_ntz, u string")


def test_hot_rows_spread_over_the_ranges(spark, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as planned: AQE would merge these few MB
    try:
        plain, hot = split_hot_keys(rows, ["k"], order(), hot_rows=2000)
        counts = {(r.k, r._nl_ck): r.n for r in hot.groupBy("k", "_nl_ck").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plain.count() == 3000 and {k for k, _ in counts} == {1, 2, 3, None}
    assert {c for _, c in counts} == set(range(parts))
    for c in range(parts):  # ranges are even, so no key, and no hour or NULL time, is one task
        assert sum(n for (_, x), n in counts.items() if x == c) < 1.5 * 13_500 / parts


def test_ranges_follow_the_order(rows):
    _, hot = split_hot_keys(rows, ["k"], order(), hot_rows=2000)
    r = hot.select("_nl_ck", F.row_number().over(Window.partitionBy("k").orderBy(*order())).alias("n"), "k")
    back = r.select("*", F.lag("_nl_ck").over(Window.partitionBy("k").orderBy("n")).alias("before"))
    assert back.filter("before > _nl_ck").count() == 0


@pytest.mark.parametrize("hot_rows", [1, 2000, 10 ** 6])
def test_results_equal_the_window(rows, hot_rows):
    w = Window.partitionBy("k").orderBy(*order())
    want = rows.select("id", F.lead("u", 1).over(w).alias("n1"), F.lead("u", 2).over(w).alias("n2"),
                       F.lag("u", 2).over(w).alias("p2"), F.row_number().over(w).cast("long").alias("step"))
    got = with_neighbors(rows, "k", order(), None, "u", leads=(1, 2), lags=(2,), hot_rows=hot_rows)
    got = ordinal_in_key(got, "k", order(), hot_rows=hot_rows)
    assert got.columns == [*rows.columns, "next1", "next2", "prev2", "step"]
    got = got.select("id", "next1", "next2", "prev2", "step").toDF(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("hot_rows", [1, 2000, 10 ** 6])
def test_sessions_equal_the_window(rows, hot_rows):
    timed = rows.filter("t is not null")
    w = Window.partitionBy("k").orderBy("t", "id")
    new = F.when(F.col("t") <= F.lag("t").over(w) + F.expr("INTERVAL 1 SECONDS"), 0).otherwise(1)
    want = timed.withColumn("b", new).select("id", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))
                                             .cast("int").alias("sn"))
    got = session_numbers(timed, "k", "t", "id", 1, hot_rows=hot_rows).select("id", "sn")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_sizes_may_come_from_elsewhere(rows):
    sizes = rows.select("k")
    got = ordinal_in_key(rows, "k", order(), hot_rows=2000, sizes=sizes)
    assert got.exceptAll(ordinal_in_key(rows, "k", order())).count() == 0
