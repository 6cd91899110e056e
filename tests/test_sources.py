"""Loaders, sinks and filters: the rules the reference's loaders and endpoints apply."""

import datetime as dt
import os

from pyspark.sql import functions as F

from helpers import make_visits, visit
from navlens.operators import filters as FL
from navlens.session import scratch_path
from navlens.sources import readers as RD
from navlens.sources import sinks as SK


def test_hits_csv_drops_empty_ids_parses_dates_and_dedupes(spark):
    path = scratch_path(spark, "hits-in")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.csv"), "w") as f:
        f.write("watchID,clientID,URL,dateTime,title\n"
                "1,c,/b,2024-01-02 10:00:00,t1\n"
                "1,c,/a,2024-01-01T09:00:00,t0\n"      # duplicate id: the earliest row wins
                ",c,/x,2024-01-01 00:00:00,t\n"        # empty id: dropped
                "2,c,/y,not a date,\n")                # bad date -> NULL, empty title -> NULL
    rows = {r["watch_id"]: r for r in RD.read_hits_csv(spark, path).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"]["url"] == "/a" and rows["1"]["datetime_hit"] == dt.datetime(2024, 1, 1, 9)
    assert rows["2"]["datetime_hit"] is None


def test_visits_csv_round_trip_keeps_list_order_and_duplicates(spark):
    v = make_visits(spark, [visit(7, "b,a,b", page_views=3), visit(8, None)])
    back = RD.read_visits_csv(spark, SK.write_visits_csv(v)).collect()
    assert [(r["visit_id"], r["watch_ids"], r["page_views"], r["is_new_user"]) for r in back] == \
        [(7, "b,a,b", 3, True), (8, None, 1, True)]


def test_csv_by_header_name_with_quotes_breaks_and_no_row_number(spark):
    path = scratch_path(spark, "csv-in")
    os.makedirs(os.path.join(path, "h"))
    os.makedirs(os.path.join(path, "v"))
    with open(os.path.join(path, "h", "part.csv"), "w") as f:
        f.write('title,URL,watchID,extra,dateTime\n'
                '"He said ""hi"", ok",/a,1,x,2024-01-02 10:00:00\n'
                '"two\nlines",/b,2,x,2024-01\n')
    hits = {r["watch_id"]: r for r in RD.read_hits_csv(spark, os.path.join(path, "h")).collect()}
    assert hits["1"]["title"] == 'He said "hi", ok' and hits["2"]["title"] == "two\nlines"
    assert hits["1"]["client_id"] == "" and hits["2"]["datetime_hit"] is None
    with open(os.path.join(path, "v", "part.csv"), "w") as f:
        f.write("pageViews,watchID,visitID\n3,b,7\n9,a,7\n2,,8\n")
    visits = {r["visit_id"]: r for r in RD.read_visits_csv(spark, os.path.join(path, "v")).collect()}
    assert (visits[7]["watch_ids"], visits[7]["page_views"]) == ("b,a", 3)
    assert (visits[8]["watch_ids"], visits[8]["page_views"]) == (None, 2)


def test_quoted_text_survives_the_hits_csv(spark):
    from helpers import make_hits
    text = 'a "q", \n b'
    back = RD.read_hits_csv(spark, SK.write_hits_csv(make_hits(spark, [("1", "c", "/a", None, text)]))).collect()
    assert back[0]["title"] == text


def test_ids_in_any_encoding_join(spark):
    from helpers import make_hits
    from navlens.functions.ids import normalize_id
    from navlens.operators import linkage as L
    forms = spark.createDataFrame([("1.2345678901234567e+18",), ("1.5E+3",), ("-2.5e+0",), ("1e+25",), ("xe+",), (" '7' ",)], "s string")
    assert [r[0] for r in forms.select(normalize_id("s")).collect()] == \
        [str(int(1.2345678901234567e18)), "1500", "-2", str(int(1e25)), "xe+", "7"]
    doubles = spark.createDataFrame([(123.0,), (12345678.0,), (None,)], "d double")
    assert [r[0] for r in doubles.select(normalize_id("d")).collect()] == ["123", "12345678", None]
    v = make_visits(spark, [visit(1, "[1.5e+3,22]")])
    h = make_hits(spark, [("1500", "c", "/a", None, "t"), ("'22'", "c", "/b", None, "t")])
    assert L.joined_table(v, h).count() == 2
    assert L.hits_matching_visits(h, L.watch_id_bridge(v, bracketed=True)).count() == 2
    nested = L.visits_with_hits(make_visits(spark, [visit(7, "b,a,b")]),
                                make_hits(spark, [("a", "c", "/a", None, "t"), ("b", "c", "/b", None, "t")])).collect()
    assert [x["watch_id"] for x in nested[0]["hits"]] == ["b", "a"]


def test_period_bounds_strip_or_convert_offsets(spark):
    rows = [visit(i, None, date_time=dt.datetime(2024, 1, 10, h)) for i, h in enumerate([0, 2, 4])]
    v = make_visits(spark, rows)
    lo, hi = "2024-01-10T03:00:00+03:00", "2024-01-10T05:00:00+03:00"
    assert sorted(r["visit_id"] for r in FL.visits_in_period(v, lo, hi, "strip").collect()) == [2]
    assert sorted(r["visit_id"] for r in FL.visits_in_period(v, lo, hi, "to_utc").collect()) == [0, 1]


def test_device_filter_os_always_applies_orientation_optional(spark):
    v = make_visits(spark, [visit(1, None, device=2, orientation="landscape"),
                            visit(2, None, device=2, orientation="portrait"), visit(3, None, device=1)])
    assert [r["visit_id"] for r in FL.visits_by_device(v, "2", "os_1", "1").collect()] == [1]
    assert [r["visit_id"] for r in FL.visits_by_device(v, "2", "os_1", "0").collect()] == [2]
    assert sorted(r["visit_id"] for r in FL.visits_by_device(v, "2", "os_1").collect()) == [1, 2]
    assert FL.visits_by_device(v, "2", None).count() == 0      # OS = NULL matches nothing
    assert FL.visits_by_device(v, "2", "").count() == 0


def test_endpoint_filter_treats_empty_os_as_off(spark):
    v = make_visits(spark, [visit(1, None, device=2, is_new_user=True), visit(2, None, device=2, is_new_user=False)])
    assert [r["visit_id"] for r in FL.composed_filter(v, True, "2", "", None, "").collect()] == [1]


def test_duration_stats_empty_and_median(spark):
    v = make_visits(spark, [visit(1, None, duration=10), visit(2, None, duration=15), visit(3, None, duration=None)])
    r = FL.duration_stats(v).collect()[0]
    assert (r["count"], r["avg_duration_sec"], r["median_duration_sec"], r["min_duration_sec"]) == (2, 12.5, 12.5, 10)
    e = FL.duration_stats(v.filter(F.lit(False))).collect()[0]
    assert e["count"] == 0 and e["avg_duration_sec"] is None


def test_top_start_urls_keeps_empty_string_group(spark):
    v = make_visits(spark, [visit(1, None, start_url=""), visit(2, None, start_url=""), visit(3, None, start_url=None),
                            visit(4, None, start_url="/a")])
    assert [(r["url"], r["visits"]) for r in FL.top_start_urls(v).collect()] == [("", 2), ("/a", 1)]


def test_snapshot_diff_statuses(spark):
    from navlens.operators.snapshot import snapshot_diff
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "path string, version double")
    new = spark.createDataFrame([("b", 2.0), ("c", None), ("d", 4.0), ("a", 1.5)], "path string, version double")
    got = {r["path"]: r["status"] for r in snapshot_diff(old, new).collect()}
    assert got == {"a": "modified", "b": "not_modified", "c": "not_modified", "d": "new"}
    got2 = {r["path"]: r["status"] for r in snapshot_diff(new, old.filter("path <> 'a'")).collect()}
    assert got2["a"] == "deleted" and got2["d"] == "deleted"
