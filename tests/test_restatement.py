"""Plain-Python restatement of the path rules on sf0.001, compared with Spark."""

from collections import Counter, defaultdict

import pytest

from navlens.operators import linkage as L
from navlens.operators import paths as PA
from navlens.operators import release as R
from navlens.operators import wandering as WD
from navlens.sources.fixtures import clickstream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    visits, hits = clickstream(spark, SF)
    return visits, hits, visits.collect(), {h["watch_id"]: h for h in hits.collect()}


def _ids(s):
    return [w.strip() for w in (s or "").split(",") if w.strip()]


def test_wandering_and_backtracks(spark, data):
    visits, hits, vrows, hmap = data
    per = defaultdict(list)
    for v in vrows:
        for w in _ids(v["watch_ids"]):
            if w in hmap:
                per[v["visit_id"]].append(hmap[w])
    exp_w = {vid: (len({h["url"] for h in hs if h["url"] is not None}), len(hs))
             for vid, hs in per.items() if len(hs) >= 8}
    got_w = {r["visit_id"]: (r["unique_pages"], r["hits"])
             for r in WD.wandering_sessions(L.joined_table(visits, hits)).collect()}
    assert got_w == exp_w
    exp_b = {}
    for vid, hs in per.items():
        u = [h["url"] or "" for h in sorted(hs, key=lambda h: (h["datetime_hit"], h["watch_id"]))]
        exp_b[vid] = sum(1 for i in range(2, len(u)) if u[i] == u[i - 2])
    got_b = {r["visit_id"]: r["backtracks"] for r in WD.backtracks(L.joined_table(visits, hits)).collect()}
    assert got_b == exp_b


def test_navigation_patterns(spark, data):
    visits, hits, vrows, hmap = data
    trans, loops, rev_visits, rev_total = Counter(), Counter(), 0, 0
    lo, hi = R._ts(R.DEFAULT_PERIODS[0][1]), R._ts(R.DEFAULT_PERIODS[0][2])
    for v in vrows:
        if not (lo <= v["date_time"] <= hi):
            continue
        hs = [(i, hmap[w]) for i, w in enumerate(_ids(v["watch_ids"])) if w in hmap]
        hs.sort(key=lambda p: (p[1]["datetime_hit"], p[0]))
        urls = [h["url"] for _, h in hs if h["url"]]
        if len(urls) < 2:
            continue
        seen, n = set(), 0
        for u in urls:
            n += u in seen
            seen.add(u)
        rev_visits += n > 0
        rev_total += n
        trans.update(zip(urls, urls[1:]))
        loops.update((a, b) for a, b, c in zip(urls, urls[1:], urls[2:]) if a == c and a != b)
    facts = R.ReleaseFacts(visits, hits, R.period_table(spark))
    rn = PA.reverse_navigation(facts).filter("release_ord = 1").collect()[0]
    assert (rn["visits_with_reverse_nav"], rn["total_reverse_transitions"]) == (rev_visits, rev_total)
    exp_t = sorted(trans.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    got_t = [((r["from_url"], r["to_url"]), r["transition_count"])
             for r in PA.common_transitions(facts).filter("release_ord = 1").orderBy("rank").collect()]
    assert got_t == exp_t
    exp_l = sorted(loops.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    got_l = [(tuple(r["sequence"].split(" -> ")[:2]), r["occurrences"])
             for r in PA.loop_patterns(facts).filter("release_ord = 1").orderBy("rank").collect()]
    assert got_l == exp_l


def test_bridge_from_events_equals_parsed_id_text(spark):
    from navlens.operators.linkage import watch_id_bridge
    from navlens.sources.fixtures import bridge_from_sessions, sessionize
    events = spark.read.parquet(f"{SF}/events.parquet")
    visits, _ = clickstream(spark, SF)
    parsed = watch_id_bridge(visits)
    stored = bridge_from_sessions(sessionize(events), path_chunk_seconds=600)
    assert parsed.count() == stored.count()
    assert parsed.exceptAll(stored).count() == 0 and stored.exceptAll(parsed).count() == 0
