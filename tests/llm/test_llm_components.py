"""Connected components: few rounds, and the same components as a plain union-find."""
import random

import numpy as np
import pytest

from navlens.llm import components as C


def plain(edges):
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    return {n: top(n) for n in root}


def count_writes(monkeypatch):
    names, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: names.append(name) or write(df, name))
    return names


def test_a_long_way_in_one_task_takes_one_round(spark, monkeypatch):
    """Rounds that only shorten such ways fill the driver with plans and tasks."""
    names = count_writes(monkeypatch)
    way = random.Random(3).sample(range(10 ** 6), 800)
    edges = list(zip(way, way[1:])) + [(5, 5), (None, 7)]
    got = C.connected_components(spark.createDataFrame(edges, "u long, v long").coalesce(1)).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((n, min(way)) for n in way)
    assert len(names) == 2


@pytest.mark.parametrize("tasks, rows", [(1, 7), (5, 7), (5, 1 << 18)])
def test_components_as_in_a_plain_version(spark, monkeypatch, tasks, rows):
    monkeypatch.setattr(C, "CONTRACT_ROWS", rows)
    rnd = random.Random(tasks)
    edges = [(rnd.randint(-10 ** 17, 10 ** 17), 0) for _ in range(3)] + [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(90)]
    got = C.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(tasks)).collect()
    want = {n: r for n, r in plain(edges).items() if any(u != v and n in (u, v) for u, v in edges)}
    assert sorted((r.node, r.root) for r in got) == sorted(want.items())


def test_no_edges(spark):
    assert C.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_stars():
    rnd = random.Random(8)
    for _ in range(200):
        edges = [(rnd.randint(-30, 30), rnd.randint(-30, 30)) for _ in range(rnd.randint(1, 40))]
        u, v = C.star_edges(*np.array(edges, np.int64).T)
        assert dict(zip(u.tolist(), v.tolist())) == {n: r for n, r in plain(edges).items() if n != r}
