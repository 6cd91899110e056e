"""Hand-worked paths of FIXTURES.md C3: one session each, in time order."""

import pytest

from helpers import path_tables
from navlens.operators import linkage as L
from navlens.operators import paths as PA
from navlens.operators import release as R
from navlens.operators import wandering as WD

N = None
# path, reverse, transitions, loops, backtracks, (revisits, unique revisited)
CASES = [
    (["A"], 0, {}, {}, 0, (0, 0)),
    (["A", "A"], 1, {("A", "A"): 1}, {}, 0, (1, 1)),
    (["A", "B", "A"], 1, {("A", "B"): 1, ("B", "A"): 1}, {"A -> B -> A": 1}, 1, (1, 1)),
    (["A", "A", "A"], 2, {("A", "A"): 2}, {}, 1, (2, 1)),
    (["A", "B", "A", "B"], 2, {("A", "B"): 2, ("B", "A"): 1}, {"A -> B -> A": 1, "B -> A -> B": 1}, 2, (2, 2)),
    (["A", "B", "C", "A"], 1, {("A", "B"): 1, ("B", "C"): 1, ("C", "A"): 1}, {}, 0, (1, 1)),
    (["A", N, "A"], 1, {("A", "A"): 1}, {}, 1, (1, 1)),
    ([N, "B", N], 0, {}, {}, 1, (0, 0)),
]


def facts_for(spark, path):
    visits, hits = path_tables(spark, [path])
    periods = R.period_table(spark, [("v", "2024-01-01 00:00:00", "2024-01-31 00:00:00")])
    return R.ReleaseFacts(visits, hits, periods), L.joined_table(visits, hits)


@pytest.mark.parametrize("path,reverse,transitions,loops,backtracks,revisits", CASES,
                         ids=["-".join(str(x) for x in c[0]) for c in CASES])
def test_sequence_rules(spark, path, reverse, transitions, loops, backtracks, revisits):
    facts, joined = facts_for(spark, path)
    rn = PA.reverse_navigation(facts).collect()[0]
    assert rn["total_reverse_transitions"] == reverse
    got_t = {(r["from_url"], r["to_url"]): r["transition_count"] for r in PA.common_transitions(facts).collect()}
    assert got_t == transitions
    got_l = {r["sequence"]: r["occurrences"] for r in PA.loop_patterns(facts).collect()}
    assert got_l == loops
    bt = WD.backtracks(joined).collect()
    assert [r["backtracks"] for r in bt] == [backtracks]
    ur = PA.url_revisits(facts).collect()[0]
    if revisits[0]:
        assert ur["sessions_with_url_revisits"] == 1
        assert ur["avg_revisits_per_session"] == revisits[0]
        assert ur["avg_unique_urls_revisited"] == revisits[1]
    else:
        assert ur["sessions_with_url_revisits"] == 0


def test_revisit_flags_row_level(spark):
    facts, _ = facts_for(spark, ["A", "B", "A", "A"])
    flags = [r["seen_before"] for r in PA.revisit_flags(facts).orderBy("pos").collect()]
    assert flags == [False, False, True, True]


def test_equal_times_break_ties_by_list_position(spark):
    import datetime as dt
    from helpers import make_hits, make_visits, visit
    t = dt.datetime(2024, 1, 5)
    visits = make_visits(spark, [visit(1, "h3,h1,h2")])
    hits = make_hits(spark, [("h1", "c", "B", t, None), ("h2", "c", "A", t, None), ("h3", "c", "A", t, None)])
    periods = R.period_table(spark, [("v", "2024-01-01 00:00:00", "2024-01-31 00:00:00")])
    f = R.ReleaseFacts(visits, hits, periods)
    got = {(r["from_url"], r["to_url"]) for r in PA.common_transitions(f).collect()}
    assert got == {("A", "B"), ("B", "A")}          # list order h3(A), h1(B), h2(A)
    assert [r["sequence"] for r in PA.loop_patterns(f).collect()] == ["A -> B -> A"]


def test_duplicate_ids_in_list_count_twice(spark):
    from helpers import make_hits, make_visits, visit
    visits = make_visits(spark, [visit(1, "h1,h1, h2 ,,")])
    hits = make_hits(spark, [("h1", "c", "A", None, None), ("h2", "c", "B", None, None)])
    bridge = L.watch_id_bridge(visits).orderBy("pos").collect()
    assert [(r["pos"], r["watch_id"]) for r in bridge] == [(1, "h1"), (2, "h1"), (3, "h2")]
    periods = R.period_table(spark, [("v", "2024-01-01 00:00:00", "2024-01-31 00:00:00")])
    f = R.ReleaseFacts(visits, hits, periods)
    assert PA.reverse_navigation(f).collect()[0]["total_reverse_transitions"] == 1
    assert R.release_info(f).collect()[0]["total_hits"] == 2     # each hit fetched once
