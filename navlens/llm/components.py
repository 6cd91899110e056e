"""Connected components of an edge table by alternating star contractions (large star, small star)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from navlens.llm.common import written

MAX_ROUNDS = 60
#: Edges that a task contracts at once.
CONTRACT_ROWS = 1 << 18


def star_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes: each node with the smallest of its component among these edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[:len(u)], at[len(u):], np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[a] != root[b])):
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (jump := root[root])).any():
            root = jump
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges -> stars of every ``CONTRACT_ROWS`` or more of a task: the rounds have shorter ways to go."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CONTRACT_ROWS:
            yield _stars(held)
            held, n = [], 0
    if n:
        yield _stars(held)


def _stars(held: list[pd.DataFrame]) -> pd.DataFrame:
    edges = pd.concat(held)
    return pd.DataFrame(dict(zip("uv", star_edges(edges["u"].to_numpy(np.int64), edges["v"].to_numpy(np.int64)))))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root = the smallest node of the component.

    The edges of a task are contracted to stars first, so few rounds follow (each has shuffles whose plans and tasks
    the driver keeps). Each round moves every edge towards the smallest neighbour of its ends, and is written to the
    shared folder.
    Minima are partial aggregates; the joins that bring them back are left to Spark's skew handling.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def large_star(pairs: DataFrame) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = smallest(both).withColumn("m", F.least("u", "m"))
        return both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(pairs: DataFrame) -> DataFrame:  # pairs: u > v
        m = smallest(pairs)
        return (pairs.join(m, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(m.select("u", F.col("m").alias("v"))))

    def sealed(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                         F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_003)))).first()

    now = written(edges.where("u <> v").select("u", "v").mapInPandas(_contract, "u long, v long").distinct(), name)
    seal = sealed(now)
    for _ in range(MAX_ROUNDS):
        now = written(small_star(large_star(now).distinct()).distinct(), name)
        # at rest every node has one edge, to a node that has none: then nothing moves any more
        new_seal = sealed(now)
        if new_seal == seal:
            break
        seal = new_seal
    else:
        raise RuntimeError(f"no rest after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
