"""Small visits and hits that several test modules build."""
import datetime as dt

from pyspark.sql import types as T

VISIT_SCHEMA = T.StructType([
    T.StructField("visit_id", T.LongType()), T.StructField("watch_ids", T.StringType()),
    T.StructField("date_time", T.TimestampNTZType()), T.StructField("is_new_user", T.BooleanType()),
    T.StructField("start_url", T.StringType()), T.StructField("end_url", T.StringType()),
    T.StructField("page_views", T.IntegerType()), T.StructField("visit_duration", T.IntegerType()),
    T.StructField("region_city", T.StringType()), T.StructField("client_id", T.StringType()),
    T.StructField("last_search_engine_root", T.StringType()), T.StructField("device_category", T.IntegerType()),
    T.StructField("operating_system", T.StringType()), T.StructField("browser", T.StringType()),
    T.StructField("screen_orientation_name", T.StringType()), T.StructField("mobile_phone", T.StringType()),
    T.StructField("mobile_phone_model", T.StringType()), T.StructField("screen_format", T.StringType())])
HIT_SCHEMA = T.StructType([
    T.StructField("watch_id", T.StringType()), T.StructField("client_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("datetime_hit", T.TimestampNTZType()),
    T.StructField("title", T.StringType())])

T0 = dt.datetime(2024, 1, 5, 10, 0, 0)


def visit(visit_id, watch_ids, date_time=T0, page_views=1, duration=10, start_url="/a", end_url="/a",
          is_new_user=True, client_id="c1", city="X", engine="google", device=1, os_="os_1",
          browser="b1", orientation="landscape", phone="", model="", screen="16:9"):
    return (visit_id, watch_ids, date_time, is_new_user, start_url, end_url, page_views, duration, city,
            client_id, engine, device, os_, browser, orientation, phone, model, screen)


def make_visits(spark, rows):
    return spark.createDataFrame(rows, VISIT_SCHEMA)


def make_hits(spark, rows):
    return spark.createDataFrame(rows, HIT_SCHEMA)


def path_tables(spark, paths):
    """One visit per path; hit i of path k has id f'{k}_{i}' and time T0 + i minutes."""
    visits, hits = [], []
    for k, path in enumerate(paths, start=1):
        ids = [f"{k}_{i}" for i in range(len(path))]
        visits.append(visit(k, ",".join(ids), page_views=len(path)))
        for i, u in enumerate(path):
            hits.append((ids[i], "c1", u, T0 + dt.timedelta(minutes=i), "t"))
    return make_visits(spark, visits), make_hits(spark, hits)
