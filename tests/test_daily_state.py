"""Distinct counts from bitmaps by day equal those of the rows; a new day rereads no other."""
import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import make_hits, make_visits, visit
from navlens.operators import release as R
from navlens.operators.daily_state import DailyState
from navlens.session import scratch_path

DAYS = [f"2024-03-0{k}" for k in range(1, 7)]


def tables(spark, seed=1):
    rnd = random.Random(seed)
    visits, hits = [], []
    for k in range(400):
        day = dt.datetime.fromisoformat(rnd.choice(DAYS))
        at = day + dt.timedelta(seconds=rnd.randrange(86400), microseconds=rnd.choice([0, 500000]))
        ids = [str(rnd.randrange(600)) for _ in range(rnd.randrange(5))]
        visits.append(visit(k, ",".join(ids), date_time=None if k % 50 == 0 else at,
                            client_id=rnd.choice([None, "", *[f"c{i}" for i in range(90)]])))
    for h in range(0, 600, 2):
        hits.append((f"{h}.0" if h % 3 == 0 else str(h), "c", rnd.choice([None, "", *[f"/p{i}" for i in range(40)]]),
                     dt.datetime(2024, 3, 1), "t"))
    return make_visits(spark, visits), make_hits(spark, hits)


class State:
    def __init__(self, spark, visits, hits):
        self.asked, self.visits, self.hits = [], visits, hits
        self.state = DailyState(spark, scratch_path(spark, "daily"), self.rows_of)

    def rows_of(self, days):
        self.asked.append(list(days))
        return self.visits.where(F.to_date("date_time").cast("string").isin(list(days))), self.hits, None


def rows(df):
    return sorted(tuple(r) for r in df.collect())


PERIODS = ([(f"{a}-{b}", f"{DAYS[a]} 00:00:00", f"{DAYS[b]} 23:59:59") for a in range(6) for b in range(a, 6)]
           + [("cut", "2024-03-02 10:30:00", "2024-03-04 07:00:00"), ("hours", "2024-03-03 09:00:00", "2024-03-03 15:00:00"),
              ("none", "2023-01-01 00:00:00", "2023-01-02 00:00:00")])


def test_equals_the_metrics_of_the_rows(spark):
    visits, hits = tables(spark)
    s = State(spark, visits, hits)
    s.state.write_days(DAYS[:2])
    s.state.write_days(DAYS[2:])
    facts = R.ReleaseFacts(visits, hits, PERIODS)
    assert rows(s.state.release_info(PERIODS)) == rows(R.release_info(facts))
    assert rows(s.state.pageview_metrics(PERIODS)) == rows(R.pageview_metrics(facts))


def test_numbers_have_no_gaps_and_stay(spark):
    visits, hits = tables(spark)
    s = State(spark, visits, hits)
    s.state.write_days(DAYS[:3])
    before = {(r.field, r.value): r.n for r in s.state.dictionary().collect()}
    s.state.write_days(DAYS[3:])
    after = {(r.field, r.value): r.n for r in s.state.dictionary().collect()}
    assert all(after[k] == n for k, n in before.items()) and len(after) > len(before)
    for field in ("client", "hit", "url"):
        numbers = sorted(n for (f, _), n in after.items() if f == field)
        assert numbers == list(range(1, len(numbers) + 1))


def test_a_new_day_rereads_no_other(spark):
    visits, hits = tables(spark)
    s = State(spark, visits, hits)
    s.state.write_days(DAYS[:5])
    whole = [("all", "2024-03-01 00:00:00", "2024-03-07 00:00:00")]
    s.state.counts(whole).collect()
    s.state.write_days(DAYS[5:])
    assert s.asked == [DAYS[:5], DAYS[5:]]
    assert rows(s.state.release_info(whole)) == rows(R.release_info(R.ReleaseFacts(visits, hits, whole)))
    assert len(s.asked) == 2  # whole days come from their bitmaps alone
    s.state.counts([("cut", "2024-03-02 12:00:00", "2024-03-05 00:00:00")]).collect()
    assert s.asked[2:] == [["2024-03-02"]]


def test_a_day_written_again_replaces_itself(spark):
    visits, hits = tables(spark)
    s = State(spark, visits, hits)
    s.state.write_days(DAYS)
    s.visits = visits.where("visit_id % 3 = 0 and to_date(date_time) <> '2024-03-04'")
    s.state.write_days(["2024-03-04", "2024-03-05"])
    now = visits.where("to_date(date_time) not in (date'2024-03-04', date'2024-03-05')").unionByName(
        s.visits.where("to_date(date_time) = '2024-03-05'"))
    whole = PERIODS[:21]
    assert rows(s.state.release_info(whole)) == rows(R.release_info(R.ReleaseFacts(now, hits, whole)))


def test_failed_write_is_repeated(spark, monkeypatch):
    visits, hits = tables(spark)
    s = State(spark, visits, hits)
    s.state.write_days(DAYS[:3])
    build = s.state._bitmaps

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(s.state, "_bitmaps", lost)  # after the numbers, before the days
    try:
        s.state.write_days(DAYS[3:])
    except RuntimeError:
        pass
    monkeypatch.setattr(s.state, "_bitmaps", build)
    s.state.write_days(DAYS[3:])
    facts = R.ReleaseFacts(visits, hits, PERIODS)
    assert rows(s.state.release_info(PERIODS)) == rows(R.release_info(facts))


def test_nothing_written_and_empty_days(spark):
    visits, hits = tables(spark)
    s = State(spark, visits, hits)
    period = [("p", "2024-03-01 00:00:00", "2024-03-03 00:00:00")]
    assert [r.total_visits for r in s.state.release_info(period).collect()] == [0]
    s.state.write_days([])
    s.state.write_days(["2024-05-01"])
    assert [tuple(r)[4:] for r in s.state.release_info([("may", "2024-05-01 00:00:00", "2024-05-31 00:00:00")]).collect()] == [(0, 0, 0)]


def test_more_values_than_one_bitmap_holds(spark):
    big = spark.range(100_000).selectExpr(
        "id as visit_id", "'' as watch_ids", "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(cast(id % 3 as int), 1) as date_time",
        "concat('c', id % 70000) as client_id")
    s = State(spark, big, make_hits(spark, []))
    s.state.write_days(DAYS[:3])
    whole = [("all", "2024-03-01 00:00:00", "2024-03-04 00:00:00"), ("two", "2024-03-01 00:00:00", "2024-03-02 23:00:00")]
    want = rows(R.release_info(R.ReleaseFacts(big, s.hits, whole)))
    assert rows(s.state.release_info(whole)) == want and want[0][6] == 70000
