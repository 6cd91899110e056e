"""Figures that must not grow faster than the input: shuffles of the derived tables, of the id sets, of the CSV reload."""
import datetime as dt

import pytest

from navlens.operators import linkage as L
from navlens.sources import fixtures as FX
from navlens.sources.csv_records import read_csv_columns
from navlens.sources.readers import regroup_visit_rows


def plan(df, mode="extended"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    """Users of few and many events, a NULL user, NULL times, rows that come twice, ids without a visit list."""
    t0, at = dt.datetime(2024, 1, 1), str(tmp_path_factory.mktemp("events"))
    rows = [(k, t0 + dt.timedelta(hours=(k * 7) % 200) if k % 41 or k < 120 else None, None if k % 37 == 0 else 1 if k < 120 else k % 9 + 2,
             "view", 1.0, "{}") for k in range(1, 300)]
    spark.createDataFrame(rows + rows[::10], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
                          "props string").write.parquet(f"{at}/events.parquet")
    spark.createDataFrame([(k, f"n{k}") for k in range(25)], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    return at


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("hot_rows", [10 ** 6, 50])
def test_tables_equal_the_separate_derivation(spark, events_dir, hot_rows):
    visits, hits, bridge = FX.derive_tables(spark, events_dir, hot_rows)
    events = spark.read.parquet(f"{events_dir}/events.parquet")
    nation = spark.read.parquet(f"{events_dir}/nation.parquet")
    ev = FX.sessionize(events)
    assert rows_of(visits) == rows_of(FX.visits_from_sessions(ev, nation))
    assert rows_of(bridge) == rows_of(FX.bridge_from_sessions(ev))
    assert rows_of(hits) == rows_of(FX.hits_from_events(events))


def test_places_need_no_shuffle_beyond_the_sessions(spark, events_dir):
    ev = FX._event_rows(spark.read.parquet(f"{events_dir}/events.parquet"))
    placed = FX._with_places(FX.plain_session_numbers(ev, "user_id", "ts", "event_id", FX.SESSION_GAP_SECONDS))
    assert plan(placed, "simple").count("Exchange") == 1


def test_ids_common_is_one_shuffle_without_sorts(spark):
    v = spark.createDataFrame([(x,) for x in ["1", "1", "1500", "7", None, "3"]], "watch_id string")
    h = spark.createDataFrame([(x,) for x in ["1", "1.5e+3", "9", None, "'3'", "9"]], "watch_id string")
    got = L.ids_common(v, h)
    assert sorted(map(str, (r[0] for r in got.collect()))) == ["1", "1500", "3", "None"]
    assert L.ids_common(v, h.where("watch_id is not null")).where("watch_id is null").count() == 0
    assert plan(L.ids_common(v, h), "simple").count("Exchange") == 1 and "Sort" not in plan(L.ids_common(v, h), "simple")


def test_a_csv_record_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n4\n")
    (tmp_path / "b.csv").write_text("d,c,a,a\n5,6,7,8\n")
    for path, expected in ((tmp_path / "a.csv", [("1", "2", "3", None), ("4", None, None, None)]),
                           (tmp_path, [("1", "2", "3", None), ("4", None, None, None), ("8", None, "6", "5")])):
        got = read_csv_columns(spark, str(path), ["a", "b", "c", "d"])
        assert plan(got, "simple").count("from_csv") == 1
        assert sorted(tuple(r)[:4] for r in got.collect()) == expected


def test_regrouped_visits_carry_their_order_twice(spark):
    rows = spark.createDataFrame([(1, None, 2, None, "x"), (1, "b", 3, "p", "y"), (1, "a", 1, "q", None), (2, None, 4, None, None)],
                                 "visit_id long, watch_id string, no int, city string, url string")
    got = regroup_visit_rows(rows, "no")
    assert [tuple(r) for r in got.orderBy("visit_id").collect()] == [(1, "a,b", "q", None), (2, None, None, None)]
    assert plan(got, "simple").count("partial_min_by") == 1
