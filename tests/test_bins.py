"""Hand-worked bins of FIXTURES.md C4."""

from helpers import make_hits, make_visits, visit
from navlens.operators import linkage as L
from navlens.operators import release as R
from navlens.operators import wandering as WD


def _facts(spark, rows):
    periods = R.period_table(spark, [("v", "2024-01-01 00:00:00", "2024-01-31 00:00:00")])
    return R.ReleaseFacts(make_visits(spark, rows), make_hits(spark, []), periods)


def test_page_view_buckets(spark):
    rows = [visit(i, None, page_views=pv) for i, pv in enumerate([0, 1, 2, 5, 6, 10, 11])]
    got = [r["count"] for r in R.dist_page_views(_facts(spark, rows)).orderBy("bucket").collect()]
    assert got == [1, 2, 2, 1]


def test_duration_buckets_null_is_zero(spark):
    rows = [visit(i, None, duration=d) for i, d in enumerate([0, 30, 31, 120, 121, 300, 301, None])]
    out = R.dist_duration(_facts(spark, rows)).orderBy("bucket").collect()
    assert [r["count"] for r in out] == [3, 2, 2, 1]
    assert [r["percentage"] for r in out] == [37.5, 25.0, 25.0, 12.5]


def _joined_with_hits(spark, counts):
    visits, hits = [], []
    for v, n in enumerate(counts, start=1):
        ids = [f"{v}_{i}" for i in range(n)]
        visits.append(visit(v, ",".join(ids)))
        hits += [(h, "c", f"/p{i % 3}", None, None) for i, h in enumerate(ids)]
    return L.joined_table(make_visits(spark, visits), make_hits(spark, hits))


def test_wandering_segments_threshold_falls_out(spark):
    j = _joined_with_hits(spark, [8, 9, 15, 16, 25, 26, 50, 51])
    got = [r["sessions"] for r in WD.wandering_segments(j).orderBy("bin").collect()]
    assert got == [2, 2, 2, 1]          # hits == 8 is wandering but in no segment


def test_wandering_levels(spark):
    j = _joined_with_hits(spark, [8, 9, 15, 16])
    got = [(r["segment"], r["sessions"]) for r in WD.wandering_levels(j).orderBy("bin").collect()]
    assert got == [("0-8", 1), ("9-15", 2), ("16+", 1)]


def test_backtrack_segments(spark):
    b = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 2, 3, 5, 6])], "visit_id long, backtracks long")
    got = [r["sessions"] for r in WD._binned_counts(b, "backtracks", WD.BACKTRACK_SEGMENTS, "all")
           .orderBy("bin").collect()]
    assert got == [1, 2, 2, 1]


def test_histogram_single_value_lands_in_middle_bin(spark):
    df = spark.createDataFrame([(3,), (3,)], "x long")
    rows = WD.equal_width_histogram(df, "x", 20).orderBy("bin").collect()
    assert len(rows) == 20 and rows[10]["count"] == 2 and sum(r["count"] for r in rows) == 2


def test_approx_quantiles_close_to_exact(spark):
    j = _joined_with_hits(spark, list(range(8, 60)))
    exact = WD.wandering_quantiles(j).collect()[0].asDict()
    approx = WD.wandering_quantiles(j, approx=True).collect()[0].asDict()
    assert set(exact) == set(approx)
    assert all(abs(exact[k] - approx[k]) <= 1.0 for k in exact)
