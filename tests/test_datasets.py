"""Exported datasets: names, prefixes, types and absent columns reconciled; versions joined inside, then united."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import make_hits, make_visits, visit
from navlens.operators.linkage import HIT_COLS, VISIT_COLS, ids_common, ids_distinct, ids_only_hits, ids_only_visits
from navlens.session import scratch_path
from navlens.sources.datasets import HIT_EXPORT, VISIT_EXPORT, Dataset, Registry, reconcile
from navlens.sources.sinks import write_export

T0 = dt.datetime(2024, 1, 5, 10)


def exported(spark, version, visits, hits, **kw):
    paths = scratch_path(spark, "v"), scratch_path(spark, "h")
    write_export(make_visits(spark, visits), make_hits(spark, hits), *paths, **kw)
    return Dataset(version, *paths)


def test_two_versions_with_the_same_ids_stay_apart(spark):
    a = exported(spark, "2022", [visit(1, "'x','y'")], [("x", "c", "/old", T0, "t")])
    b = exported(spark, "2024", [visit(1, "x")], [("x", "c", "/new", T0, "t"), ("z", "c", "/z", T0, "t")], brackets=False)
    registry = Registry(spark, [a, b])
    rows = registry.joined().collect()
    assert sorted((r.version, r.release_ord, r.visit_id, r.watch_id, r.url) for r in rows) == [
        ("2022", 1, 1, "x", "/old"), ("2024", 2, 1, "x", "/new")]
    assert registry.versions == ["2022", "2024"] and registry.visits().count() == 2 and registry.hits().count() == 3
    visits, hits = registry["2022"].matched(spark)
    assert [r.watch_id for r in visits.collect()] == ["x"] and hits.count() == 1
    with pytest.raises(ValueError):
        registry.add(a)


def test_schemas_are_reconciled(spark):
    raw = spark.createDataFrame(
        [("7", 3.0, "2024-01-05 10:00:00", 1, [10, 11], "kept", "no")],
        "`ym:s:visitID` string, `ym:s:pageViews` double, `ym:s:dateTime` string, `ym:s:isNewUser` int,"
        " `ym:s:watchIDs` array<long>, `browser` string, `ym:s:unknown` string")
    row = reconcile(raw, VISIT_EXPORT, VISIT_COLS, "ym:s:")
    assert row.columns == VISIT_COLS
    got = row.first()
    assert (got.visit_id, got.page_views, got.date_time, got.is_new_user, got.watch_ids, got.browser, got.start_url) == (
        7, 3, T0, True, "10,11", "kept", None)
    kinds = dict(row.dtypes)
    assert kinds["visit_id"] == "bigint" and kinds["date_time"] == "timestamp_ntz" and kinds["screen_format"] == "string"


def test_ids_that_went_through_a_float(spark):
    raw = spark.createDataFrame([(1234567.0, "2024-13-01"), (None, None)], "`ym:pv:watchID` double, `ym:pv:dateTime` string")
    rows = reconcile(raw, HIT_EXPORT, HIT_COLS, "ym:pv:").collect()
    assert [(r.watch_id, r.datetime_hit) for r in rows] == [("1234567", None), (None, None)]


def test_csv_datasets(spark):
    import os
    folder = scratch_path(spark, "csv")
    os.makedirs(f"{folder}/v")
    os.makedirs(f"{folder}/h")
    with open(f"{folder}/v/a.csv", "w") as f:
        f.write('ym:s:visitID,ym:s:watchIDs,ym:s:dateTime,pageViews\n5,"[1,2]",2024-01-05 10:00:00,2\n')
    with open(f"{folder}/h/a.csv", "w") as f:
        f.write("ym:pv:URL,ym:pv:watchID\n/a,1\n/b,3\n")
    rows = Registry(spark, [Dataset("x", f"{folder}/v", f"{folder}/h", format="csv")]).joined().collect()
    assert [(r.visit_id, r.watch_id, r.url, r.page_views, r.version) for r in rows] == [(5, "1", "/a", 2, "x")]


def test_id_sets_compare_canonical_ids(spark):
    left = spark.createDataFrame([("1500",), ("22",), ("9",)], "watch_id string")
    hits = spark.createDataFrame([("1.5e+3",), ("'22'",), ("8",)], "watch_id string")
    assert sorted(r[0] for r in ids_common(left, hits).collect()) == ["1500", "22"]
    assert [r[0] for r in ids_only_visits(left, hits).collect()] == ["9"]
    assert [r[0] for r in ids_only_hits(left, hits).collect()] == ["8"]
    assert ids_distinct(hits.unionByName(left)).count() == 4


def test_release_hits_find_ids_in_any_encoding(spark):
    from navlens.operators.release import ReleaseFacts
    v = make_visits(spark, [visit(1, "1500,22")])
    h = make_hits(spark, [("1.5e+3", "c", "/a", T0, "t"), ("'22'", "c", "/b", T0, "t")])
    facts = ReleaseFacts(v, h, [("x", "2024-01-01 00:00:00", "2024-02-01 00:00:00")])
    assert facts.release_hits.count() == facts.path_rows.count() == 2


def test_empty_registry_and_empty_export(spark):
    with pytest.raises(ValueError):
        Registry(spark).joined()
    empty = exported(spark, "e", [], [])
    assert Registry(spark, [empty]).joined().count() == 0
    assert Registry(spark, [empty]).visits().select(F.count("*")).first()[0] == 0
