"""Readers: raw-export prefixes, CSV loaders, object listings.

All readers return lazy DataFrames with explicit schemas (no inference), so
Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navlens.functions.scalars import nonempty, parse_bool, parse_datetime, parse_int
from navlens.sources.csv_records import read_csv_columns

# Column prefixes of the raw analytics exports.
VISIT_PREFIX = "ym:s:"
HIT_PREFIX = "ym:pv:"

# CSV header names -> column names of the hits / visits tables.
HIT_CSV_COLUMNS = {"watchID": "watch_id", "clientID": "client_id", "URL": "url",
                   "dateTime": "datetime_hit", "title": "title"}
VISIT_CSV_COLUMNS = {
    "visitID": "visit_id", "watchID": "watch_id", "dateTime": "date_time", "isNewUser": "is_new_user",
    "startURL": "start_url", "endURL": "end_url", "pageViews": "page_views",
    "visitDuration": "visit_duration", "regionCity": "region_city", "clientID": "client_id",
    "lastsignSearchEngineRoot": "last_search_engine_root", "deviceCategory": "device_category",
    "operatingSystem": "operating_system", "browser": "browser",
    "screenOrientationName": "screen_orientation_name", "mobilePhone": "mobile_phone",
    "mobilePhoneModel": "mobile_phone_model", "screenFormat": "screen_format"}


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Drop ``prefix`` from every column name (a metadata-only rename)."""
    return df.toDF(*[c[len(prefix):] if c.startswith(prefix) else c for c in df.columns])


def _text(c: str):
    """A CSV text field as the loader keeps it: missing -> ''."""
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def read_hits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of hits -> ``hits``; rows without an id are dropped, bad
    dates become NULL, a duplicated id keeps its earliest (time, URL) row."""
    raw = read_csv_columns(spark, path, list(HIT_CSV_COLUMNS))
    # absent text is stored as '' (not NULL), as the loader does; dates parse to NULL
    h = raw.select(*[F.col(k).alias(v) for k, v in HIT_CSV_COLUMNS.items()]) \
           .filter(nonempty("watch_id")) \
           .select("watch_id", _text("client_id"), _text("url"), parse_datetime("datetime_hit").alias("datetime_hit"),
                   _text("title"))
    first = F.min(F.struct(F.coalesce(F.col("datetime_hit"), F.expr("TIMESTAMP_NTZ'9999-12-31 00:00:00'")),
                           F.coalesce(F.col("url"), F.lit("")), "client_id", "url", "datetime_hit", "title"))
    return h.groupBy("watch_id").agg(first.alias("_r")).select(
        "watch_id", "_r.client_id", "_r.url", "_r.datetime_hit", "_r.title")


def regroup_visit_rows(rows: DataFrame, order_col: str) -> DataFrame:
    """CSV visits are one row per (visit, hit id): collect the ids in row order
    (no de-duplication) and keep the first row's other columns. A visit whose
    only row lists no id is kept, with NULL for its ids.

    ``order_col`` is anything that sorts the rows (an ordinal or a struct). The collected list of a visit is exactly its
    own id list, i.e. bounded by one output row.
    """
    others = [c for c in rows.columns if c not in ("visit_id", "watch_id", order_col)]
    order = F.struct(F.col(order_col).alias("o"))  # never NULL itself: min_by skips NULL orders
    # a row carries its order twice, once for its id and once for all other columns together
    ids = F.array_sort(F.collect_list(F.when(F.col("watch_id").isNotNull(), F.struct(order.alias("o"), F.col("watch_id").alias("w")))))
    return rows.groupBy("visit_id").agg(
        F.nullif(F.array_join(F.transform(ids, lambda s: s["w"]), ","), F.lit("")).alias("watch_ids"),
        F.min_by(F.struct(*others), order).alias("_first")).select("visit_id", "watch_ids", "_first.*")


def read_visits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of visits (one row per listed hit id) -> ``visits``.

    Rows are taken in the order of a ``rowNo`` column, or without one as they
    stand in the file.
    """
    raw = read_csv_columns(spark, path, [*VISIT_CSV_COLUMNS, "rowNo"])
    v = raw.select(*[F.col(k).alias(n) for k, n in VISIT_CSV_COLUMNS.items()],
                   F.struct(parse_int("rowNo").alias("no"), F.col("_order")).alias("row_no"))
    # rows without a visit id are skipped; empty hit ids are not listed; text
    # fields keep '' for missing values, numbers and dates parse to NULL
    v = v.filter(nonempty("visit_id")).select(
        parse_int("visit_id").alias("visit_id"),
        F.when(nonempty("watch_id"), F.col("watch_id")).alias("watch_id"),
        parse_datetime("date_time").alias("date_time"),
        parse_bool("is_new_user").alias("is_new_user"), _text("start_url"), _text("end_url"),
        parse_int("page_views").cast("int").alias("page_views"),
        parse_int("visit_duration").cast("int").alias("visit_duration"), _text("region_city"), _text("client_id"),
        _text("last_search_engine_root"), parse_int("device_category").cast("int").alias("device_category"),
        _text("operating_system"), _text("browser"), _text("screen_orientation_name"), _text("mobile_phone"),
        _text("mobile_phone_model"), _text("screen_format"), "row_no")
    return regroup_visit_rows(v, "row_no")


def file_listing(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """Object listing ``(path, modified, length)`` of files under ``base``
    matching the glob ``pattern``; file contents are never read (the binary
    source skips the ``content`` column when it is not selected)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                 .option("recursiveFileLookup", "true").load(base)
                 .select("path", F.col("modificationTime").alias("modified"), "length"))
