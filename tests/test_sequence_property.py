"""Property: chunked sequence helpers equal plain per-key windows for any data and chunk size."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from navlens.operators.sequence import ordinal_in_key, session_numbers, time_chunk, with_neighbors

BASE = dt.datetime(2024, 1, 1)
row = st.tuples(st.integers(0, 3),                       # key
                st.one_of(st.none(), st.integers(0, 200)),  # time in minutes (NULL allowed)
                st.sampled_from(["a", "b", "c"]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=40), chunk=st.sampled_from([60, 600, 3600, 10 ** 7]),
       nulls_first=st.booleans())
def test_neighbors_and_ordinals(spark, rows, chunk, nulls_first):
    data = [(i, k, None if m is None else BASE + dt.timedelta(minutes=m), u) for i, (k, m, u) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, t timestamp_ntz, u string")
    t = F.col("t").asc_nulls_first() if nulls_first else F.col("t").asc_nulls_last()
    order = [t, F.col("id")]
    ck = time_chunk("t", chunk, nulls_first)
    got = ordinal_in_key(with_neighbors(df, "k", order, ck, "u", leads=(1, 2), lags=(1, 2)), "k", order, ck)
    w = Window.partitionBy("k").orderBy(*order)
    ref = df.select("id", F.lead("u", 1).over(w).alias("a1"), F.lead("u", 2).over(w).alias("a2"),
                    F.lag("u", 1).over(w).alias("b1"), F.lag("u", 2).over(w).alias("b2"),
                    F.row_number().over(w).alias("r"))
    j = {r["id"]: r for r in got.join(ref, "id").collect()}
    assert len(j) == len(data)
    for r in j.values():
        assert (r["next1"], r["next2"], r["prev1"], r["prev2"], r["step"]) == (r["a1"], r["a2"], r["b1"], r["b2"], r["r"])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(gaps=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30 * 3600)), min_size=1, max_size=40),
       chunk=st.sampled_from([600, 3600, 6 * 3600, 10 ** 7]))
def test_session_numbers(spark, gaps, chunk):
    clock, data = {}, []
    for i, (k, g) in enumerate(gaps):
        clock[k] = clock.get(k, 0) + g
        data.append((i, k, BASE + dt.timedelta(seconds=clock[k])))
    df = spark.createDataFrame(data, "id long, k long, t timestamp_ntz")
    got = {r["id"]: r["sn"] for r in session_numbers(df, "k", "t", "id", 12 * 3600, chunk).collect()}
    expected, last, sn = {}, {}, {}
    for i, k, t in sorted(data, key=lambda x: (x[1], x[2], x[0])):
        if k not in last or t > last[k] + dt.timedelta(hours=12):
            sn[k] = sn.get(k, 0) + 1
        last[k] = t
        expected[i] = sn[k]
    assert got == expected
