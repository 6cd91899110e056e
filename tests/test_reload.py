"""Several tables become current together or not at all."""

import os

import pytest

from navlens.session import scratch_path
from navlens.sources.reload import ReloadError, TableSet, not_empty, unique_key


@pytest.fixture
def tables(spark):
    out = TableSet(spark, scratch_path(spark, "reload"))
    out.reload(pair(spark, "old"))
    return out


def pair(spark, mark, n=3):
    return {"visits": spark.range(n).selectExpr("id", f"'{mark}' as mark"),
            "hits": spark.range(2 * n).selectExpr("cast(id as string) as watch_id", f"'{mark}' as mark")}


def marks(tables):
    return {name: {r.mark for r in tables.read(name).collect()} for name in ("visits", "hits")}


def test_reload_switches_both(spark, tables):
    assert marks(tables) == {"visits": {"old"}, "hits": {"old"}}
    assert tables.reload(pair(spark, "new")) == 2
    assert marks(tables) == {"visits": {"new"}, "hits": {"new"}}
    assert tables.read("hits", 1).first().mark == "old"
    assert [tables.manifest()["tables"][t]["rows"] for t in ("visits", "hits")] == [3, 6]


def test_failure_between_the_writes_leaves_the_old_pair(spark, tables):
    new = pair(spark, "new")
    new["hits"] = spark.range(4).selectExpr("cast(raise_error('no more disk') as string) as watch_id", "'new' as mark")
    with pytest.raises(Exception, match="no more disk"):
        tables.reload(new)
    assert marks(tables) == {"visits": {"old"}, "hits": {"old"}} and tables.versions() == [1]
    assert tables.reload(pair(spark, "again")) == 2
    assert marks(tables) == {"visits": {"again"}, "hits": {"again"}}


def test_failure_at_the_switch_and_its_repetition(spark, tables, monkeypatch):
    monkeypatch.setattr(TableSet, "_switch", lambda self, entries: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.reload(pair(spark, "new"))
    assert marks(tables) == {"visits": {"old"}, "hits": {"old"}}
    monkeypatch.undo()
    assert tables.reload(pair(spark, "new")) == 2


def test_checks(spark, tables):
    twice = pair(spark, "new")
    twice["visits"] = twice["visits"].unionByName(twice["visits"])
    checks = {"visits": [unique_key("id"), not_empty]}
    with pytest.raises(ReloadError, match="same"):
        tables.reload(twice, checks)
    with pytest.raises(ReloadError, match="no rows"):
        tables.reload(pair(spark, "new", n=0), checks)
    with pytest.raises(ReloadError, match="without"):
        tables.reload({"visits": spark.sql("select cast(null as long) as id")}, checks)
    assert marks(tables) == {"visits": {"old"}, "hits": {"old"}}


def test_readers_keep_their_load_until_it_is_dropped(spark, tables):
    reading = tables.read("visits")
    for k in range(3):
        tables.reload(pair(spark, f"m{k}"))
    assert {r.mark for r in reading.collect()} == {"old"}
    assert tables.drop_old_loads(keep=2) == [1, 2] and tables.versions() == [3, 4]
    assert marks(tables)["hits"] == {"m2"}
    assert len(os.listdir(f"{tables.base}/manifests")) - sum(
        n.endswith(".crc") for n in os.listdir(f"{tables.base}/manifests")) == 2


def test_nothing_loaded(spark):
    with pytest.raises(ReloadError):
        TableSet(spark, scratch_path(spark, "none")).read("visits")
