"""Visit filters (P4 - P10) and the small visit-level aggregates behind the
service endpoints (A4 duration statistics, A5 data range, A6 top start URLs).

All predicates are native expressions on columns of the scan, so Catalyst
pushes them into the Parquet reader (``PushedFilters``) and prunes columns.
Bounds are parameters: they are parsed once on the driver, never per row.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navlens.functions.scalars import py_round
from navlens.operators.quantiles import quantile_row

DEFAULT_WINDOW_DAYS = 7
TOP_START_URLS = 20


def parse_bound(text: str, tz_policy: str = "strip") -> dt.datetime:
    """ISO bound (``Z`` allowed) -> naive datetime.

    ``strip`` drops the offset and keeps the wall time (the aggregator's rule);
    ``to_utc`` converts to UTC first (the repository's rule).
    """
    d = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    if d.tzinfo is not None and tz_policy == "to_utc":
        d = d.astimezone(dt.timezone.utc)
    return d.replace(tzinfo=None)


def _lit_ts(d: dt.datetime) -> Column:
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def visits_in_period(visits: DataFrame, start: str, end: str, tz_policy: str = "strip") -> DataFrame:
    """Visits with ``start <= date_time <= end`` (both inclusive)."""
    lo, hi = parse_bound(start, tz_policy), parse_bound(end, tz_policy)
    return visits.filter(F.col("date_time").between(_lit_ts(lo), _lit_ts(hi)))


def visits_by_new_user(visits: DataFrame, is_new_user: int) -> DataFrame:
    return visits.filter(F.col("is_new_user") == F.lit(bool(is_new_user)))


def visits_by_region(visits: DataFrame, region_country: str | None, region_city: str) -> DataFrame:
    """City filter; the country argument is accepted and ignored (as in the source)."""
    return visits.filter(F.col("region_city") == region_city)


def _orientation(is_landscape) -> str:
    return "landscape" if str(is_landscape) == "1" else "portrait"


def visits_by_device(visits: DataFrame, device, operating_system: str | None,
                     is_landscape=None) -> DataFrame:
    """Repository rule: ``device_category = int(device)`` AND ``operating_system =
    operating_system`` (always applied; a missing OS matches nothing, as SQL
    ``= NULL`` does) AND, when given, the orientation ('1' -> landscape, else
    portrait). The web endpoint's optional-OS variant is :func:`composed_filter`."""
    os_match = F.col("operating_system") == F.lit(operating_system).cast("string")
    preds = [F.col("device_category") == int(device), os_match]
    if is_landscape is not None:
        preds.append(F.col("screen_orientation_name") == _orientation(is_landscape))
    return visits.filter(reduce(lambda a, b: a & b, preds))


def composed_filter(visits: DataFrame, is_new_user: bool, device: str,
                    operating_system: str | None = None, is_landscape=None,
                    region_city: str | None = None) -> DataFrame:
    """New user AND device AND [OS] AND [orientation] AND [city]; empty = off."""
    preds = [F.col("is_new_user") == F.lit(bool(is_new_user)),
             F.col("device_category") == int(device) if str(device).isdigit() else F.lit(False)]
    if operating_system:
        preds.append(F.col("operating_system") == operating_system)
    if is_landscape is not None:
        preds.append(F.col("screen_orientation_name") == _orientation(is_landscape))
    if region_city:
        preds.append(F.col("region_city") == region_city)
    return visits.filter(reduce(lambda a, b: a & b, preds))


def duration_stats(visits: DataFrame) -> DataFrame:
    """Count, mean, median, min, max of non-NULL durations (2 digits, half-even).

    Empty input gives count 0 and NULL statistics (one global aggregate).
    """
    d = F.col("visit_duration")
    known = visits.filter(d.isNotNull())
    return known.agg(
        F.count(F.lit(1)).alias("count"),
        py_round(F.avg(d), 2).alias("avg_duration_sec"),
        F.min(d).alias("min_duration_sec"),
        F.max(d).alias("max_duration_sec")).select(
            "count", "avg_duration_sec",
            py_round(quantile_row(known, {"visit_duration": [0.5]})["visit_duration_0"], 2).alias("median_duration_sec"),
            "min_duration_sec", "max_duration_sec")


def ux_metrics(visits: DataFrame, time_start: str | None, time_end: str | None,
               is_new_user: bool, device: str, operating_system: str | None = None,
               is_landscape=None, region_city: str | None = None,
               as_of: str | None = None) -> DataFrame:
    """Filtered duration statistics; missing bounds = the 7 days before ``as_of``."""
    if time_start is None or time_end is None:
        ref = parse_bound(as_of) if as_of else dt.datetime.utcnow()
        time_start = time_start or (ref - dt.timedelta(days=DEFAULT_WINDOW_DAYS)).isoformat()
        time_end = time_end or ref.isoformat()
    v = visits_in_period(visits, time_start, time_end, tz_policy="to_utc")
    return duration_stats(composed_filter(v, is_new_user, device, operating_system,
                                          is_landscape, region_city))


def visits_last_days(visits: DataFrame, as_of: str, days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    ref = parse_bound(as_of)
    return visits.filter(F.col("date_time").between(_lit_ts(ref - dt.timedelta(days=days)), _lit_ts(ref)))


def available_dates(visits: DataFrame) -> DataFrame:
    return visits.agg(F.min("date_time").alias("min_date"), F.max("date_time").alias("max_date"),
                      F.count("visit_id").alias("total_visits"))


def top_start_urls(visits: DataFrame, limit: int = TOP_START_URLS) -> DataFrame:
    """Most frequent entry URLs (NULL excluded, ``''`` kept), count desc, URL asc."""
    return (visits.filter(F.col("start_url").isNotNull())
                  .groupBy(F.col("start_url").alias("url")).agg(F.count("visit_id").alias("visits"))
                  .orderBy(F.col("visits").desc(), F.col("url").asc()).limit(limit))
