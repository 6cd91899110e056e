"""The chunked sequence helpers equal plain per-key windows, whatever the chunking."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from navlens.operators.sequence import ordinal_in_key, session_numbers, time_chunk, with_neighbors


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(7)
    rows, eid = [], 0
    for user in range(6):
        t = dt.datetime(2024, 1, 1)
        for _ in range(rnd.randint(1, 60) if user else 400):        # user 0 is a hot key
            t += dt.timedelta(seconds=rnd.choice([5, 60, 3600, 5 * 3600, 13 * 3600, 43200]))
            eid += 1
            rows.append((eid, user, t, rnd.choice(["a", "b", "c"]),
                         None if rnd.random() < 0.05 else t))
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, u string, t2 timestamp_ntz")


@pytest.mark.parametrize("chunk", [60, 3600, 6 * 3600, 10 ** 9])
def test_session_numbers_match_window(spark, events, chunk):
    got = session_numbers(events, "user_id", "ts", "event_id", 43200, chunk_seconds=chunk)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prev = F.lag("ts").over(w)
    brk = F.when(prev.isNotNull() & (F.col("ts") <= prev + F.expr("INTERVAL 12 HOURS")), 0).otherwise(1)
    ref = events.withColumn("b", brk).withColumn("sn_ref", F.sum("b").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    j = got.join(ref.select("event_id", "sn_ref"), "event_id")
    assert j.filter(F.col("sn") != F.col("sn_ref")).count() == 0 and j.count() == events.count()


@pytest.mark.parametrize("chunk,nulls_first", [(60, True), (3600, False), (10 ** 9, True)])
def test_neighbors_and_ordinals_match_window(spark, events, chunk, nulls_first):
    order_ts = F.col("t2").asc_nulls_first() if nulls_first else F.col("t2").asc_nulls_last()
    order = [order_ts, F.col("event_id")]
    got = with_neighbors(events, "user_id", order, time_chunk("t2", chunk, nulls_first), "u",
                         leads=(1, 2), lags=(1, 2))
    got = ordinal_in_key(got, "user_id", order, time_chunk("t2", chunk, nulls_first), out="step")
    w = Window.partitionBy("user_id").orderBy(*order)
    ref = events.select("event_id", F.lead("u", 1).over(w).alias("r_n1"), F.lead("u", 2).over(w).alias("r_n2"),
                        F.lag("u", 1).over(w).alias("r_p1"), F.lag("u", 2).over(w).alias("r_p2"),
                        F.row_number().over(w).alias("r_step"))
    j = got.join(ref, "event_id")
    bad = j.filter(~(F.col("next1").eqNullSafe(F.col("r_n1")) & F.col("next2").eqNullSafe(F.col("r_n2"))
                     & F.col("prev1").eqNullSafe(F.col("r_p1")) & F.col("prev2").eqNullSafe(F.col("r_p2"))
                     & (F.col("step") == F.col("r_step"))))
    assert bad.count() == 0 and j.count() == events.count()
