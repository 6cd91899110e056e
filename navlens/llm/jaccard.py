"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct shingles of ``Rule.words`` words. Documents link
when the Jaccard similarity of their sets is ``Rule.num / Rule.den`` or more (three
words and 90 / 100 unless a caller says otherwise); the result is each document's
component under the links. No link between different sets is lost,
and no list of pairs is made: only what connects components leaves a task.

1. Equal sets are one node, told by a 64-bit digest of the sorted set; the
   steps below work on nodes.
2. Shingles are ordered rarest first, by the counts of 2^18 hash buckets over
   all documents (any order is right; this one keeps common passages out of the
   prefixes). Linked sets of sizes n and m differ in D = (n + m) (den - num) /
   (den + num) shingles at most. A set of up to ``Rule.part_shingles`` is one part; larger ones are cut by
   hash in 2, 4, 8 ... parts, of which one must differ in D / parts at most.
   Such parts share one of their first D / parts + 1 shingles.
3. Index lists, one for each such shingle, hold (size, position, 192-bit parity
   bitmap) of the parts, sorted by size. A list is read by blocks, past the sizes
   that can link blocks are skipped, and so is every pair already connected.
   Pairs whose sizes, positions and bitmaps allow a link connect into candidate
   groups. Lists longer than ``LIST_ROWS`` are cut in cells, and each pair of
   cells is a list; which lists are that long is told by the real rows of one
   set in ``SAMPLE`` (which cells there are changes the work's spread, no result).
4. Candidate groups, nearly all of them a few sets, are verified with the whole
   sets. A set's overlaps with the group are derived from those of the most
   similar set already answered: only the index lists of the shingles in which
   the two differ are read. A group of more than ``GROUP_SHINGLES`` shingles is
   cut in cells; each pair of cells is verified by a task of its own. Where a
   document's number of links is asked for, all sets of a group are answered,
   not only those that still connect something.

Shingles are compared by 64-bit hashes.

Cases: null and empty texts have an empty set and link with nothing (not with
each other either); a text shorter than a shingle has one shingle, its word
sequence; repeated rows are equal sets; a row without a doc_id links like others
and is nobody's component_id (null if no row of its component has one); ties: of
equal sets any stands for all; an empty table gives an empty result; extra
columns are not read by ``link_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from navlens.llm.common import ascii_lower, text_partitions, words, written
from navlens.llm.components import connected_components

BUCKETS = 1 << 18
#: Rows of an index list beyond which it is cut in cells.
LIST_ROWS = 20_000
#: Shingles of a candidate group beyond which it is cut in cells.
GROUP_SHINGLES = 250_000
#: One set in so many is looked at to find the lists that are longer than LIST_ROWS, and the most lists that are cut.
SAMPLE, MAX_CUT_LISTS = 64, 1_000_000
#: Longs in the bitmap that drops documents outside candidate groups before their texts are shuffled.
FILTER_WORDS = 1 << 16
#: Longs of a set's parity bitmap in an index row: half of what a row takes in the shuffle.
BITMAP_LONGS = 3
#: Rows of an index list that are compared at once, and answers of a group that are kept to derive others from.
BLOCK, KEPT_ANSWERS = 256, 16


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity ``num / den`` from which on sets link."""

    words: int = 3
    num: int = 90
    den: int = 100

    @property
    def part_shingles(self) -> int:
        """Shingles of a part (800 at 90 / 100): linked parts differ in about 84, so that the bitmaps stay telling."""
        return max(1, 1600 * (self.num + self.den) // (38 * max(1, self.den - self.num)))

    def largest(self, n):
        """Size of the largest set that can link with one of ``n`` shingles."""
        return self.den * n // self.num

    def least_overlap(self, a, b):
        """Smallest intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def most_apart(self, a, b):
        """Largest symmetric difference of linked sets of sizes a and b."""
        return a + b - 2 * self.least_overlap(a, b)


RULE = Rule()

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.ListArray, k: int = RULE.words) -> list[np.ndarray]:
    """Word hashes of each text -> sorted distinct hashes of its k-word shingles (of the sequence, if shorter)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ends = np.cumsum(np.array([0, *column.value_lengths().fill_null(0).to_pylist()], np.int64))
    if len(flat) >= k:
        runs = flat[:len(flat) - k + 1]
        for j in range(1, k):
            runs = _mix(runs) * _GOLD + flat[j:len(flat) - k + 1 + j]
        runs = _mix(runs).view(np.int64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a:b - k + 1]))
        elif b > a:
            one = flat[a:a + 1]
            for j in range(a + 1, b):
                one = _mix(one) * _M2 + flat[j:j + 1]
            out.append(_mix(one + _M1).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def _word_hashes(text: Column) -> Column:
    return F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))


def _text_tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _survey(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, tag, word hashes) -> a row for each document, and in the end one for each hash bucket that was met."""
        names = ["doc_id", "tag", "n_shingles", "node", "bucket", "n"]
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            sets = shingle_sets(batch.column("hashes"), rule.words)
            if sets:
                counts += np.bincount(np.concatenate(sets) & (BUCKETS - 1), minlength=BUCKETS)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("tag"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.int32()), none], names=names)
        met = np.flatnonzero(counts)
        none = pa.nulls(len(met), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(met.astype(np.int32)), pa.array(counts[met])],
                                         names=names)

    return run


def _set_class(n: int, rule: Rule) -> int:
    """0 up to ``rule.part_shingles``, 1 up to twice as many, ...; class k has 2^k parts."""
    return max(0, (-(-n // rule.part_shingles) - 1).bit_length())


def _index_rows(shared, long_lists, rule: Rule):
    """Sets -> (token, cell, n, node, pos, bitmap) of their parts' prefixes; equal sets of a batch give rows once.

    ``long_lists``: broadcast of (token, class) -> number of cells; None: no list is cut.
    """
    def rows_of(s: np.ndarray, node: int, kind: int, counts: np.ndarray, cut: dict) -> Iterator[np.ndarray]:
        parts = 1 << kind
        most = rule.most_apart(len(s), rule.largest(len(s))) // parts
        part = (s >> 40) & (parts - 1)
        for q in range(parts):
            own = s[part == q] if parts > 1 else s
            bucket = own & (BUCKETS - 1)
            order = np.lexsort((own, counts[bucket]))[:most + 1]
            parity = np.bincount(((own >> 20) & 0xFFFFFF) % (64 * BITMAP_LONGS), minlength=64 * BITMAP_LONGS) & 1
            tokens = own[order]
            if len(own) <= most:  # parts that small may differ in all: they share the list of the small
                tokens = np.append(tokens, -1 - q)
            cells = np.array([cut.get((t, kind), 1) for t in tokens.tolist()]) if cut else np.ones(len(tokens), np.int64)
            rows = np.empty((len(tokens), len(_INDEX_COLUMNS)), np.int64)
            rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = tokens, kind << 48, len(s), node
            rows[:, 4], rows[:, 5:] = np.arange(len(tokens)), np.packbits(parity.astype(np.uint8)).view(np.int64)
            if len(own) <= most:
                rows[-1, 4] = 0
            yield rows[cells <= 1]
            for k in np.flatnonzero(cells > 1).tolist():  # each pair of cells is a list
                c = int(cells[k])
                mine, other = node % c, np.arange(c)
                many = np.repeat(rows[k:k + 1], c, axis=0)
                many[:, 1] += 1 + np.minimum(mine, other) * c + np.maximum(mine, other)
                yield many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cut = shared.value, long_lists.value if long_lists is not None else {}
        for batch in batches:
            out, seen = [], set()
            for s in shingle_sets(batch.column("hashes"), rule.words):
                node = set_digest(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                # a set that may link with larger ones of a later class stands in both
                for k in range(_set_class(len(s), rule), _set_class(rule.largest(len(s)), rule) + 1):
                    out.extend(rows_of(s, node, k, counts, cut))
            if out:
                rows = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in range(rows.shape[1])],
                                                 names=_INDEX_COLUMNS)

    return run


_INDEX_COLUMNS = ["token", "cell", "n", "node", "pos", *(f"b{i}" for i in range(BITMAP_LONGS))]
_INDEX_SCHEMA = ", ".join(f"{c} long" for c in _INDEX_COLUMNS)


def _may_link(n1, pos1, bits1, n2, pos2, bits2, parts, rule):
    """Whether sizes, positions (of a first shared prefix shingle) and bitmaps allow a link."""
    most = rule.most_apart(n1, n2) // parts
    apart = np.bitwise_count((bits1 ^ bits2).view(np.uint64)).sum(axis=-1).astype(np.int64)
    return (rule.den * np.minimum(n1, n2) >= rule.num * np.maximum(n1, n2)) & (pos1 + pos2 <= most) & (apart <= most)


def list_edges(n: np.ndarray, node: np.ndarray, pos: np.ndarray, bits: np.ndarray, parts: int,
               rule: Rule = RULE) -> list[tuple[int, int]]:
    """Edges that connect the sets of one list as the pairs that may link do; rows sorted by size, distinct nodes."""
    m = len(n)
    root, edges = np.arange(m), []
    last = np.searchsorted(n, rule.largest(n), side="right")  # past the sizes that can link
    for k in range(m):
        for a in range(k + 1, int(last[k]), BLOCK):
            b = min(a + BLOCK, int(last[k]))
            other = np.flatnonzero(root[a:b] != root[k]) + a
            if not len(other):
                continue  # the whole block is connected with the set already
            hits = other[_may_link(n[k], pos[k], bits[k], n[other], pos[other], bits[other], parts, rule)]
            for h in hits.tolist():
                if root[h] != root[k]:
                    edges.append((int(node[k]), int(node[h])))
                    root[root == root[h]] = root[k]
    return edges


def _read_lists(rule: Rule):
    """Index rows sorted by (token, cell, n, node) -> candidate edges (u, v)."""
    def edges_of(rows: np.ndarray) -> Iterator[np.ndarray]:
        new = np.ones(len(rows), bool)  # equal sets from several batches
        new[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
        rows = rows[new]
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        two = starts[sizes == 2]  # most lists that hold more than one set: all at once
        x, y = rows[two], rows[two + 1]
        ok = _may_link(x[:, 2], x[:, 4], x[:, 5:], y[:, 2], y[:, 4], y[:, 5:], 1 << (x[:, 1] >> 48), rule)
        yield np.stack([x[ok, 3], y[ok, 3]], axis=1)
        for a, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            part = rows[a:a + m]
            found = list_edges(part[:, 2], part[:, 3], part[:, 4], part[:, 5:], 1 << int(part[0, 1] >> 48), rule)
            if found:
                yield np.array(found, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, len(_INDEX_COLUMNS)), np.int64)
        for batch in batches:
            rows = np.concatenate([held, batch.to_numpy(np.int64)])
            if not len(rows):
                continue
            open_ = (rows[:, :2] == rows[-1, :2]).all(axis=1)  # the last list may go on
            first = int(np.argmax(open_))
            done, held = rows[:first], rows[first:]
            if len(done):
                pairs = np.concatenate(list(edges_of(done)))
                yield pd.DataFrame(np.unique(np.sort(pairs, axis=1), axis=0), columns=["u", "v"])
        if len(held):
            pairs = np.concatenate(list(edges_of(held)))
            yield pd.DataFrame(np.unique(np.sort(pairs, axis=1), axis=0), columns=["u", "v"])

    return run


def group_links(nodes: list[int], sets: list[np.ndarray], rule: Rule = RULE,
                linked_pairs: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges that connect the sets as their links do (exact). Sets are sorted arrays of distinct hashes.

    With a list for ``linked_pairs`` all links are found: (place, places) of ``nodes`` are added to it.
    """
    order = sorted(range(len(nodes)), key=lambda k: (len(sets[k]), nodes[k]))
    nodes, sets = [nodes[k] for k in order], [sets[k] for k in order]
    m = len(nodes)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    by_token = np.argsort(token, kind="stable")
    members = owner[by_token]  # index lists, one after another, each sorted by size
    begins = np.searchsorted(token[by_token], np.arange(token.max() + 2))
    tokens = np.split(token, np.cumsum(size)[:-1])
    last = np.searchsorted(size, rule.largest(size), side="right")
    root, edges = np.arange(m), []
    kept: list[tuple[int, np.ndarray]] = []  # answered sets and their overlaps with all

    def counts(of: np.ndarray) -> np.ndarray:
        lists = [members[begins[t]:begins[t + 1]] for t in of.tolist()]
        return np.bincount(np.concatenate(lists), minlength=m) if lists else np.zeros(m, np.int64)

    for k in range(m):
        span = slice(k + 1, int(last[k]))
        if linked_pairs is None and not (root[span] != root[k]).any():
            continue  # nothing that could link is unconnected
        near = min(kept, key=lambda a: size[a[0]] + size[k] - 2 * a[1][k], default=None)
        if near is not None and size[near[0]] + size[k] - 2 * near[1][k] < size[k] // 2:
            own, base = tokens[k], tokens[near[0]]
            overlap = near[1] + counts(np.setdiff1d(own, base, assume_unique=True)) \
                - counts(np.setdiff1d(base, own, assume_unique=True))
        else:
            overlap = counts(tokens[k])
        kept.append((k, overlap))
        if len(kept) > KEPT_ANSWERS:
            kept.pop(0)
        linked = np.flatnonzero(overlap[span] >= rule.least_overlap(size[k], size[span])) + k + 1
        if linked_pairs is not None and len(linked):
            linked_pairs.append((order[k], [order[h] for h in linked.tolist()]))
        for h in linked.tolist():
            if root[h] != root[k]:
                edges.append((nodes[k], nodes[h]))
                root[root == root[h]] = root[k]
    return edges


def _verify(rule: Rule, count: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Edges (u, v) of a pair of cells, and with ``count`` rows (node, null, documents linked with it)."""
        places = {n: i for i, n in enumerate(table.column("node").to_pylist())}  # equal texts without ids: one counts
        rows = table.take(pa.array(list(places.values()), pa.int64())) if len(places) < len(table) else table
        nodes, sets = rows.column("node").to_pylist(), shingle_sets(rows.column("hashes").combine_chunks(), rule.words)
        edges, links = [], np.zeros(len(nodes), np.int64)
        pairs: list[tuple[int, list[int]]] | None = [] if count else None
        if len(nodes) > 1:
            edges = group_links(nodes, sets, rule, pairs)
        if count:
            copies, own = rows.column("copies").to_numpy(), rows.column("own").to_numpy()
            low, high = divmod(key[1].as_py(), rows.column("cells")[0].as_py())
            for k, others in pairs:  # pairs inside a cell meet in every pair of it: they count in that with itself
                o = np.array(others)
                o = o[(own[o] != own[k]) | (low == high)]
                links[k] += copies[o].sum()
                links[o] += copies[k]
        some = np.flatnonzero(links)
        both = np.array(edges, np.int64).reshape(-1, 2)
        none = pa.nulls(len(some), pa.int64())
        return pa.table({
            "u": pa.concat_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.array(nodes, np.int64)[some])]),
            "v": pa.concat_arrays([pa.array(np.ascontiguousarray(both[:, 1])), none]),
            "n": pa.concat_arrays([pa.nulls(len(both), pa.int64()), pa.array(links[some])])})

    return run


def _long_lists(hashed: DataFrame, shared, list_rows: int, rule: Rule, sample: int) -> dict[tuple[int, int], int]:
    """(token, class) -> cells, for index lists that the rows of one set in ``sample`` make longer than ``list_rows``."""
    some = hashed.where(F.pmod(F.col("tag"), F.lit(sample)) == 0).select("hashes")
    rows = some.mapInArrow(_index_rows(shared, None, rule), _INDEX_SCHEMA).groupBy("token", "cell").agg(
        (F.countDistinct("node") * sample).alias("n"))
    found = rows.where(F.col("n") > list_rows).orderBy(F.col("n").desc(), "token").limit(MAX_CUT_LISTS).collect()
    return {(r["token"], r["cell"] >> 48): -(-r["n"] // list_rows) for r in found}


def _id_slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(64 * FILTER_WORDS))


def _id_bits(chosen: DataFrame) -> Column:
    """A bitmap of hashed doc_ids, ``FILTER_WORDS`` longs whatever the corpus, as a scalar subquery."""
    words_ = chosen.select(_id_slot(F.col("doc_id")).alias("slot")).groupBy(
        F.shiftright("slot", 6).alias("id")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS INT)))").alias("bits"))
    dense = chosen.sparkSession.range(FILTER_WORDS).join(words_, "id", "left").select(
        "id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"])).scalar()


def _has_bit(doc_id: Column, bits: Column) -> Column:
    """False only for ids that are not among those of the bitmap."""
    slot = _id_slot(doc_id)
    word = F.get(bits, F.shiftright(slot, 6).cast("int"))
    return F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def set_components(docs: DataFrame, list_rows: int = LIST_ROWS, group_shingles: int = GROUP_SHINGLES, rule: Rule = RULE,
                   count: bool = False, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(members: doc_id, tag, n_shingles, node of every row; roots: node, root of every node that has a link; with
    ``count`` links: node, documents of other sets that it links with).
    """
    spark, parts = docs.sparkSession, text_partitions(docs)
    hashed = docs.select("doc_id", _text_tag(F.col("text")).alias("tag"), _word_hashes(F.col("text")).alias("hashes"))
    survey = written(hashed.mapInArrow(
        _survey(rule), "doc_id long, tag long, n_shingles long, node long, bucket int, n long"), "jaccard-survey")
    members = survey.where("bucket is null").select("doc_id", "tag", "n_shingles", "node")
    met = survey.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[met["bucket"].to_numpy(np.int64)] = met["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(counts)  # BUCKETS numbers, whatever the corpus
    cut = spark.sparkContext.broadcast(_long_lists(hashed, shared, list_rows, rule, sample))  # MAX_CUT_LISTS at most
    index = hashed.select("hashes").mapInArrow(_index_rows(shared, cut, rule), _INDEX_SCHEMA)
    candidates = written(
        index.repartition(parts, "token", "cell").sortWithinPartitions("token", "cell", "n", "node")
        .mapInPandas(_read_lists(rule), "u long, v long").distinct(), "jaccard-candidates")
    groups = connected_components(candidates, "jaccard-groups").withColumnRenamed("root", "grp")
    # one document stands for each node, with an id where one has it; its set is made again from its text
    stand_in = members.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tag")).alias("d"),
        F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    chosen = groups.join(stand_in, "node")
    totals = chosen.groupBy("grp").agg(F.sum("n").alias("total"))
    chosen = written(chosen.join(totals, "grp").select(
        F.col("d.doc_id").alias("__id"), F.col("d.tag").alias("__tag"), "node", "grp", "copies",
        F.ceil(F.col("total") / F.lit(group_shingles)).cast("long").alias("cells")), "jaccard-chosen")
    wanted = _id_bits(chosen.select(F.col("__id").alias("doc_id")))
    whole = (docs.where(_has_bit(F.col("doc_id"), wanted))  # drops most texts before the join shuffles them
             .select("doc_id", "text", _text_tag(F.col("text")).alias("tag"))
             .join(chosen, F.col("tag").eqNullSafe(F.col("__tag")) & F.col("doc_id").eqNullSafe(F.col("__id"))))
    own = F.pmod(F.col("node"), F.col("cells"))
    cell = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda c: (
        F.least(own, c) * F.col("cells") + F.greatest(own, c))))
    links = (whole.select("grp", "node", "text", "copies", "cells", own.alias("own"), cell.alias("cell"))
             .repartition(parts, "grp", "cell")  # the texts are shuffled; their hashes would take more
             .select("grp", "cell", "node", "copies", "cells", "own", _word_hashes(F.col("text")).alias("hashes"))
             .groupBy("grp", "cell").applyInArrow(_verify(rule, count), "u long, v long, n long"))
    if not count:
        return members, connected_components(links.where("v is not null").select("u", "v"), "jaccard-links"), None
    links = written(links, "jaccard-verified")
    degrees = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    return members, connected_components(links.where("v is not null").select("u", "v"), "jaccard-links"), degrees


def link_documents(docs: DataFrame, rule: Rule = RULE, count: bool = True, **bounds) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and with ``count`` n_links (other
    documents that it links with) of every row.
    """
    members, roots, degrees = set_components(docs, rule=rule, count=count, **bounds)
    nodes = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"),
                                                                F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids, columns, none = nodes.join(first, "root"), ["doc_id", "n_shingles", "component_id"], []
    if count:
        ids = ids.join(degrees, "node", "left").withColumn(
            "n_links", F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1)
        columns, none = [*columns, "n_links"], [F.lit(0).cast("long").alias("n_links")]
    full = members.where("n_shingles > 0").join(ids.drop("first_id", "copies"), "node").select(*columns)
    return full.unionByName(members.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *none))


def keep_first(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """One row of each component: that with the smallest doc_id. Columns of ``docs``; empty sets all stay.

    A doc_id stands for one document: repeated rows of it stay once.
    """
    linked = link_documents(docs, rule, count=False)
    gone = linked.where("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti")
    again = written(linked.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("doc_id"), "jaccard-repeats")
    if again.head(1):
        out = out.join(again, "doc_id", "left_anti").unionByName(
            out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)
