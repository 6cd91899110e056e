"""Periodic runs of words.

A run is a stretch of words with smallest period q (words q apart are equal),
of at least ``max(least, 3 * q)`` words, that no neighbouring word extends. All
runs of a text are found at once:

* a suffix tree (Ukkonen) of the words and one of their reversal; the leaves in
  the order of an Euler tour, and between neighbouring leaves the least string
  depth that the tour passes there. A sparse table of these minima answers the
  depth of any two leaves' lowest common ancestor in constant time: how many
  words two suffixes (in the reversal: two prefixes) have in common (LCE);
* from the leaf order, the longest Lyndon word at every position under the
  order of the words and under its reverse (next smaller and next greater
  suffix): one of them is a root of every run;
* each root, taken as a period, is extended to the right by the first tree and
  to the left by the second. What is long enough is a run.

Each 8 words of a run come again q words after or before, at most a third of
the run away. Texts are cut down to the stretches where that is so before the
trees are built (``repeated_stretches``); no run is lost by it and none is cut.

Everything happens inside one row; no shuffle. Memory is that of the trees of
one text's repeated stretches, some 700 bytes a word.

Cases: null and empty texts have no words and no runs; repeated rows give equal
results; ties: runs are listed by start, then period; extra columns pass
through, result columns replace columns of the same name; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

LEAST_WORDS = 24

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                    T.StructField("period", T.LongType())])
_RESULT = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


class SuffixTree:
    """Ukkonen's suffix tree of a list of whole numbers, all above 0; a 0 is added as the end."""

    def __init__(self, symbols: list[int]):
        s = symbols + [0]
        self.n = n = len(s)
        # a node is the word s[start:end] on the edge to it; leaves (end = n) know their suffix
        start, end, link, suffix = [0], [0], [0], [-1]
        kids: list[dict[int, int] | None] = [{}]
        node = edge = length = open_ = 0
        for i, c in enumerate(s):
            last = 0
            open_ += 1
            while open_:
                if length == 0:
                    edge = i
                of_node = kids[node]
                child = of_node.get(s[edge])
                if child is None:
                    of_node[s[edge]] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(i - open_ + 1)
                    kids.append(None)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    at = start[child]
                    size = (end[child] if end[child] < i else i) - at
                    if length and length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                    if s[at + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    inner = len(start)
                    of_node[s[edge]] = inner
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    suffix += (-1, i - open_ + 1)
                    kids += ({s[at + length]: child, c: inner + 1}, None)
                    start[child] = at + length
                    if last:
                        link[last] = inner
                    last = inner
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_ + 1
        self._tour(start, end, suffix, kids)

    def _tour(self, start, end, suffix, kids) -> None:
        """Leaves in Euler-tour order (children by symbol) and the least string depth between neighbours."""
        order, lowest = [], []
        stack = [(0, 0, 0)]  # node, string depth of its parent, least depth since the last leaf
        while stack:
            node, depth, low = stack.pop()
            of_node = kids[node]
            if of_node is None:
                order.append(suffix[node])
                lowest.append(low)
                continue
            depth += end[node] - start[node]
            first = True
            todo = []
            for _, child in sorted(of_node.items()):
                todo.append((child, depth, low if first else depth))
                first = False
            stack.extend(reversed(todo))
        self.rank = np.empty(self.n, dtype=np.int64)
        self.rank[np.array(order)] = np.arange(self.n)
        self.table = [np.array(lowest, dtype=np.int32)]
        step = 1
        while 2 * step <= self.n:
            row = self.table[-1]
            self.table.append(np.minimum(row[:-step], row[step:]))
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b (a != b), element by element."""
        ra, rb = self.rank[a], self.rank[b]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k)) + 1])
        return out


def next_lower(values: list[int]) -> list[int]:
    """For each place the next place with a lower value; the length where there is none."""
    out, stack = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(symbols: list[int], least: int) -> np.ndarray:
    """(start, length, period) rows, by start and period, of all runs of a list of whole numbers above 0."""
    n = len(symbols)
    forward, backward = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = forward.rank
    after = np.concatenate([np.array(next_lower(rank.tolist())), np.array(next_lower((-rank).tolist()))])
    at = np.tile(np.arange(n + 1), 2)
    period = after - at
    some = (at < n) & (after < n) & (3 * period <= n)
    at, period = at[some], period[some]
    end = at + period + forward.common(at, at + period)
    start = at - backward.common(n - at, n - at - period)
    length = end - start
    ok = length >= np.maximum(least, 3 * period)
    return np.unique(np.stack([start[ok], length[ok], period[ok]], axis=1)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every window of ``size`` words, a power of two."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    run = 1
    while run < size:
        h = (h[:-run] ^ (h[:-run] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[run:] * np.uint64(0x94D049BB133111EB)
        run *= 2
    return h


def repeated_stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of words that hold all runs, each run whole in one of them.

    A window counts when an equal one (by 64-bit hash: a collision adds words, it loses none) is within a third of the
    stretch that it stands in. With windows of at most a third of ``least`` words, a run of period q is at least 2 * q
    words and a window long: each window inside it has its equal q words after or before, inside it too.
    """
    window = 1 << ((least // 3).bit_length() - 1)
    h = _window_hashes(ids, window)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    near = np.full(len(h), len(ids))
    gap = order[1:][same] - order[:-1][same]
    near[order[1:][same]] = gap
    near[order[:-1][same]] = np.minimum(near[order[:-1][same]], gap)
    limit = np.full(len(h), len(ids) // 3)
    while True:
        hit = np.concatenate([[0], (near <= limit).astype(np.int8), [0]])
        starts, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1) + window - 1
        keep = ends - starts >= least
        starts, ends = starts[keep], ends[keep]
        narrower = np.zeros(len(h), dtype=np.int64)
        for a, b in zip(starts, ends):
            narrower[a:b - window + 1] = (b - a) // 3
        if (narrower == limit).all():
            return list(zip(starts.tolist(), ends.tolist()))
        limit = narrower


def word_runs(words: list, least: int = LEAST_WORDS) -> np.ndarray:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    none = np.empty((0, 3), dtype=np.int64)
    if len(words) < least:
        return none
    of: dict = {}
    ids = np.array([of.setdefault(w, len(of)) for w in words], dtype=np.int64) + 1
    stretches = repeated_stretches(ids, least)
    if not stretches:
        return none
    # one string of all stretches; the numbers between them occur once, so nothing reaches over them
    joined, places, mark = [], [], len(of) + 1
    for a, b in stretches:
        places.append((len(joined), a))
        joined.extend(ids[a:b].tolist())
        joined.append(mark)
        mark += 1
    found = runs_of(joined, least)
    base = np.array(places)
    shift = base[np.searchsorted(base[:, 0], found[:, 0], side="right") - 1]
    found[:, 0] += shift[:, 1] - shift[:, 0]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


def find_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period) and ``collapsed``, the text's words without what runs repeat."""

    @F.pandas_udf(_RESULT)
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                # bytes split at exactly the ASCII white space that ends a word
                words = text.encode("utf-8").split() if isinstance(text, str) else []
                runs = word_runs(words, least)
                if len(runs):
                    words = [words[i] for i in kept_words(len(words), runs).tolist()]
                rows.append(([{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()],
                             b" ".join(words).decode("utf-8")))
            yield pd.DataFrame(rows, columns=["runs", "collapsed"])

    return (docs.withColumn("__r", of_texts(F.col("text")))
            .withColumns({"runs": F.col("__r.runs"), "collapsed": F.col("__r.collapsed")}).drop("__r"))
