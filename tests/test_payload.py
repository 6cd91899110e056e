"""The nested release document (C1) and its optional placeholders."""

import json

from helpers import make_hits, make_visits, visit
from navlens.operators import release as R
from navlens.plans import payload as PL

P = [("v", "2024-01-01 00:00:00", "2024-01-31 00:00:00")]


def doc(spark, placeholders):
    visits = make_visits(spark, [visit(1, "h1", os_="", engine=None), visit(2, "h2", os_="", engine=None)])
    hits = make_hits(spark, [("h1", "c", "/a", None, "A"), ("h2", "c", "/b", None, None)])
    row = PL.release_payload_json(R.ReleaseFacts(visits, hits, P), with_placeholders=placeholders).collect()[0]
    return json.loads(row["payload"])


def test_document_shape(spark):
    d = doc(spark, False)
    assert d["release_info"]["total_visits"] == 2 and d["release_info"]["total_hits"] == 2
    assert d["device_breakdown"]["by_os"] == []
    assert d["traffic_sources"]["by_search_engine"][0]["segment_value"] == "direct"
    assert {p["url"] for p in d["page_metrics"]} == {"/a", "/b"}
    assert [b["range_min"] for b in d["session_distribution"]["by_page_views"]] == [1, 2, 6, 11]


def test_placeholders_fill_empty_lists(spark):
    d = doc(spark, True)
    assert [s["segment_value"] for s in d["device_breakdown"]["by_os"]] == ["Unknown"]
    assert d["navigation_patterns"]["loop_patterns"] == [{"sequence": ["/"], "occurrences": 0}]
    assert d["navigation_patterns"]["common_transitions"][0]["to_url"] == "/page"


def test_every_placeholder_of_a_release_with_visits(spark):
    visits = make_visits(spark, [visit(1, None, os_="", browser="", orientation="", engine=None, city=None, device=3,
                                       start_url="", end_url="", client_id=c) for c in ("c1", None)])
    facts = R.ReleaseFacts(visits, make_hits(spark, []), P)
    d = json.loads(PL.release_payload_json(facts, with_placeholders=True).collect()[0]["payload"])
    zero = {"visits": 0, "percentage": 0.0, "avg_page_views": 0.0, "avg_duration_sec": 0, "single_page_visits": 0}
    for name in ("by_os", "by_browser", "by_screen_orientation"):
        assert d["device_breakdown"][name] == [{"segment_value": "Unknown"} | zero]
    assert d["geographic_distribution"]["top_cities"] == [
        {"segment_value": "Unknown"} | zero | {"visits": 2, "percentage": 100.0}]
    assert d["page_metrics"] == [{"url": "/", "title": "Home", "visits_as_entry": 2, "visits_as_exit": 2, "total_hits": 0,
                                  "unique_visitors": 2, "visits_with_single_page": 2, "subsequent_page_diversity": 0}]
    assert d["navigation_patterns"]["common_transitions"] == [{"from_url": "/", "to_url": "/page", "transition_count": 0}]
    assert d["funnel_metrics"]["application_funnel"] == [{"step": 1, "url": "/", "visits_entered": 2, "visits_completed": 2}]


def test_empty_release(spark):
    facts = R.ReleaseFacts(make_visits(spark, []), make_hits(spark, []), P)
    d = json.loads(PL.release_payload_json(facts, with_placeholders=True).collect()[0]["payload"])
    assert d["release_info"]["total_visits"] == 0
    assert d["session_distribution"] == {
        "by_page_views": [{"range_min": 1, "range_max": 1, "count": 0, "percentage": 0.0}],
        "by_duration_sec": [{"range_min": 0, "range_max": 30, "count": 0, "percentage": 0.0}]}
    assert [c["segment_value"] for c in d["device_breakdown"]["by_category"]] == ["Desktop"]
    assert d["traffic_sources"]["by_search_engine"][0]["segment_value"] == "Unknown"
    assert d["navigation_patterns"]["common_transitions"] == [{"from_url": "/", "to_url": "/", "transition_count": 0}]
    assert d["page_metrics"][0] | {"url": "/", "title": "Home", "total_hits": 0} == d["page_metrics"][0]


def test_payload_holds_two_releases(spark):
    import pytest
    visits, hits = make_visits(spark, [visit(1, "h1")]), make_hits(spark, [("h1", "c", "/a", None, "A")])
    two = P + [("w", "2023-01-01 00:00:00", "2023-01-02 00:00:00")]
    got = json.loads(PL.as_json(PL.payload_document(R.ReleaseFacts(visits, hits, two), "site", "2024-02-01 00:00:00"),
                                "payload").collect()[0]["payload"])
    assert got["metadata"] == {"project_name": "site", "generated_at": "2024-02-01T00:00:00.000",
                               "data_source": "postgres_analytics"}
    assert [r["release_info"]["version"] for r in got["releases"]] == ["v", "w"]
    with pytest.raises(ValueError, match="exactly 2 releases"):
        PL.payload_document(R.ReleaseFacts(visits, hits, P), "site", "2024-02-01 00:00:00")


def test_flattened_documents(spark):
    from pyspark.sql import types as T
    kind = T.StructType.fromDDL("a struct<b:int,c:array<struct<d:string,e:array<double>>>>, f array<string>, g boolean")
    rows = spark.createDataFrame([(1, '{"a": {"b": 3, "c": [{"d": "x", "e": [1.5, 2]}, {"d": null, "e": []}]}, "f": [], "g": true}')],
                                 "k int, doc string")
    got = {(r.path, r.number, r.text) for r in PL.flatten_document(rows, "doc", kind, ["k"]).collect()}
    assert got == {("a.b", 3.0, None), ("a.c[0].d", None, "x"), ("a.c[0].e[0]", 1.5, None), ("a.c[0].e[1]", 2.0, None),
                   ("a.c[1].d", None, None), ("a.c[1].e", None, "[]"), ("f", None, "[]"), ("g", None, "true")}
