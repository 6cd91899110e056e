"""The reference's comparison fixture (1000 -> 1200 visits) and rule boundaries."""

import datetime as dt

import pytest

from navlens.operators import compare as CM

COLS = ("release_ord int, version string, period_start timestamp_ntz, period_end timestamp_ntz, "
        "total_visits long, total_hits long, new_users long, returning_users long, avg_duration_sec int, "
        "avg_page_views double, reverse_nav_pct double, loop_list_len long, high_interaction_pct double, "
        "url_revisit_pct double")
S, E = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 7)


def release(ord_, version, visits, dur=120, pv=5.0, rev=10.0, loops=1, hi=5.0, revis=20.0):
    return (ord_, version, S, E, visits, 5000, 600, visits - 600, dur, pv, rev, loops, hi, revis)


def compare(spark, old, new):
    summary = spark.createDataFrame([old, new], COLS)
    cmp_ = CM.release_comparison(summary)
    return cmp_.collect()[0], CM.release_concerns(cmp_).collect()[0]


def test_reference_fixture_total_change(spark):
    c, k = compare(spark, release(1, "1.0.0", 1000), release(2, "1.1.0", 1200))
    assert c["total_change"] == 200 and c["total_change_pct"] == 20.0
    assert c["version_old"] == "1.0.0" and c["version_new"] == "1.1.0"
    assert k["n_concerns"] == 0 and k["concern_level"] == "low"


def test_sample_payload_scaled_by_1_15(spark):
    # the sample payload x1.0 vs x1.15: +15 % visits, duration 180 -> 206, no concerns
    c, k = compare(spark, release(1, "a", 10000, dur=180, pv=5.2, rev=20.0, hi=10.0, revis=25.0),
                   release(2, "b", 11500, dur=int(180 * 1.15), pv=5.98, rev=23.0, hi=11.5, revis=28.75))
    assert c["total_change"] == 1500 and c["total_change_pct"] == pytest.approx(15.0)
    assert c["avg_duration_change"] == 26 and k["concern_level"] == "low"


@pytest.mark.parametrize("kw,expected", [
    (dict(rev=15.0), 0), (dict(rev=15.1), 1),            # reverse-nav change must exceed 5
    (dict(loops=1), 0), (dict(loops=2), 1),              # any increase of the loop list
    (dict(revis=25.0), 0), (dict(revis=25.5), 1),        # revisit share change must exceed 5
    (dict(dur=150), 0), (dict(dur=151), 1),              # duration change must exceed 30
])
def test_each_rule_at_and_over_its_limit(spark, kw, expected):
    _, k = compare(spark, release(1, "o", 1000), release(2, "n", 1000, **kw))
    assert k["n_concerns"] == expected
    assert k["concern_level"] == ("medium" if expected else "low")


def test_three_and_four_concerns_are_high(spark):
    _, k3 = compare(spark, release(1, "o", 1000), release(2, "n", 1000, rev=16.0, loops=3, revis=26.0))
    _, k4 = compare(spark, release(1, "o", 1000), release(2, "n", 1000, rev=16.0, loops=3, revis=26.0, dur=200))
    assert (k3["n_concerns"], k3["concern_level"]) == (3, "high")
    assert (k4["n_concerns"], k4["concern_level"]) == (4, "high")


def test_zero_old_visits_guards_percentage(spark):
    c, _ = compare(spark, release(1, "o", 0), release(2, "n", 10))
    assert c["total_change_pct"] == 0.0


def test_validation_rules(spark):
    summary = spark.createDataFrame([release(1, "o", 10)], COLS)
    dist = spark.createDataFrame([(1, 1, 10, 50.0)], "release_ord int, bucket int, count long, percentage double")
    dev = spark.createDataFrame([(1, 1)], "release_ord int, device_category int")
    rows = {(r["release_ord"], r["rule"]): r["passed"]
            for r in CM.payload_validation(summary, dist, dev, "").collect()}
    assert rows[(0, "exactly_two_releases")] is False
    assert rows[(0, "project_name_present")] is False
    assert rows[(1, "start_before_end")] is True
