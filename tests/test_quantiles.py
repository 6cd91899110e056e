"""Exact quantiles by rank bracketing equal Spark's percentile, whatever the values."""

import random

import pytest
from pyspark.sql import functions as F

from navlens.operators.quantiles import exact_quantiles

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def reference(df, keys, wanted):
    fields = [F.percentile(F.col(c), F.lit(q)).alias(f"{c}_{i}") for c, qs in wanted.items() for i, q in enumerate(qs)]
    return df.groupBy(*keys).agg(F.struct(*fields).alias("q"))


def same(a, b):
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@pytest.mark.parametrize("values", ["small", "wide", "huge", "one"])
def test_equal_percentile(spark, values):
    rnd = random.Random(values)
    draw = {"small": lambda: rnd.randint(0, 5), "wide": lambda: rnd.randint(-2 ** 31, 2 ** 31 - 1),
            "huge": lambda: rnd.randint(-2 ** 50, 2 ** 50), "one": lambda: 7}[values]
    rows = [(rnd.choice([1, 1, 1, 2, None]), draw() if rnd.random() < .9 else None, rnd.randint(0, 10 ** 5)) for _ in range(4000)]
    rows.append((3, 5, 5))
    df = spark.createDataFrame(rows, "k int, a long, b int")
    wanted = {"a": QS, "b": [0.5]}
    assert same(exact_quantiles(df, ["k"], wanted), reference(df, ["k"], wanted))
    assert same(exact_quantiles(df, [], wanted), reference(df, [], wanted))


def test_a_million_distinct_values_in_no_single_task(spark):
    df = spark.range(1_000_003).select(F.lit(1).alias("k"), (F.col("id") * 977 % 1_000_003).alias("v"))
    got = exact_quantiles(df, ["k"], {"v": [0.25, 0.5, 0.999]})
    assert tuple(got.first().q) == (250000.5, 500001.0, 999001.998)
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "percentile" not in plan and "collect_list" not in plan
    # the running sums read a row per bucket and the values of the hit buckets, never all values in one task
    buckets = df.select(F.shiftright("v", 16).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    assert buckets.count() == 16 and buckets.agg(F.max("n")).first()[0] == 65536


def test_empty_and_missing(spark):
    df = spark.createDataFrame([], "k int, v int")
    assert exact_quantiles(df, ["k"], {"v": QS}).count() == 0
    assert exact_quantiles(df, [], {"v": [0.5]}).first().q.v_0 is None
    missing = spark.createDataFrame([(1, None, 4)], "k int, v int, w int")
    assert tuple(exact_quantiles(missing, ["k"], {"v": [0.5], "w": [0.5]}).first().q) == (None, 4.0)
    with pytest.raises(TypeError):
        exact_quantiles(spark.createDataFrame([(1.5,)], "v double"), [], {"v": [0.5]})
