"""A key holding a third of all rows is spread over many tasks by the chunked helpers."""

import datetime as dt

from pyspark.sql import functions as F

from navlens.operators.sequence import _spread, session_numbers, time_chunk


def test_hot_key_is_split_across_partitions(spark):
    n_hot, n_other = 30000, 60000
    base = dt.datetime(2024, 1, 1)
    hot = spark.range(n_hot).select(F.col("id").alias("event_id"), F.lit(0).cast("long").alias("user_id"),
                                    (F.lit(base) + F.make_dt_interval(secs=F.col("id") * 90)).alias("ts"))
    other = spark.range(n_other).select((F.col("id") + n_hot).alias("event_id"),
                                        (F.col("id") % 5000 + 1).alias("user_id"),
                                        (F.lit(base) + F.make_dt_interval(secs=F.col("id") * 7)).alias("ts"))
    ev = hot.unionByName(other).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    # look at the shuffle as planned; AQE would merge these few MB into one partition
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = _spread(ev.select("*", time_chunk("ts", 3600).alias("ck")), ["user_id", "ck"]) \
            .filter(F.col("user_id") == 0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the hot user's rows land in every shuffle partition, roughly evenly
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(spread) == n_parts
    assert max(r["count"] for r in spread) <= 1.5 * n_hot / n_parts
    # and the numbering is still the exact per-user result: one session (gaps of 90 s)
    sn = session_numbers(ev, "user_id", "ts", "event_id", 12 * 3600, chunk_seconds=3600)
    assert sn.filter("user_id = 0").agg(F.max("sn")).first()[0] == 1
