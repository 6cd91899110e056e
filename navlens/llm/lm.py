"""Language-model scoring with a weighted backoff automaton.

Model: word trigrams, smoothed towards bigrams and those towards unigrams by
Dirichlet priors of strength ``mu_pair`` and ``mu``. As an automaton: each pair
of words that training has seen in sequence is a state, so is each word, and so
is the start of a text. From state gh, a seen trigram (g, h, w) is an arc of
weight log10((c(ghw) + mu_pair P(w|h)) / (c(gh) + mu_pair)); for other words the
failure arc of weight log10(mu_pair / (c(gh) + mu_pair)) leads to state h. There
a seen bigram (h, w) is an arc of weight log10((c(hw) + mu P(w)) / (c(h) + mu)),
and the next failure arc, of weight log10(mu / (c(h) + mu)), leads to the root,
whose arcs weigh log10 P(w), P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). A text is
traversed once from left to right: the state after a token is the longest of
its last two tokens that training has seen, or the root.

The model grows with the corpus and is nowhere held whole. Documents are taken
in blocks of ``BLOCK_ROWS`` rows in scan order. Each block asks for the
training counts of its own distinct n-grams: sorted 64-bit n-gram keys, packed
by key range, are shuffled to the key ranges, where counts of all blocks are
summed, and each block's counts are sent back. Together they are the part of
the automaton that the block's texts can reach. Key ranges hold each n-gram
once per block, so a frequent n-gram makes no hot spot.

Words are compared by 64-bit hashes, n-grams by hashes of 62 bits beside their order. ``docs`` must give the same
rows in the same order when read twice (a table, or anything written); if it
doesn't, scoring fails rather than giving wrong counts.

Cases: null and empty texts have one token, the end; repeated rows are scored
alike, one result each, and each counts in training; without training rows all
counts are 0; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from navlens.llm.common import ascii_lower, text_partitions, words, written

ADD = 0.1
MU = 300.0
MU_PAIR = 3.0
#: Rows in a block: 2^BLOCK_BITS.
BLOCK_BITS = 11
#: Keys, of all blocks, of a key range that are summed at a time.
SLICE_KEYS = 500_000

_END, _START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD, _ORDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _tokens(arrays) -> tuple[np.ndarray, np.ndarray]:
    """(tokens with an end after each text, first position of each text)."""
    lens = np.array([len(a) for a in arrays], dtype=np.int64)
    ends = np.cumsum(lens + 1) - 1
    token = np.empty(int(lens.sum()) + len(lens), dtype=np.uint64)
    is_word = np.ones(len(token), dtype=bool)
    is_word[ends] = False
    token[is_word] = np.concatenate([np.asarray(a, dtype=np.int64) for a in arrays]).view(np.uint64)
    token[ends] = _END
    return token, ends - lens


def _ngrams(token: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the distinct n-grams (low bits: order less 1), and for each token the places of the unigram,
    bigram and trigram that it ends; a text's first token ends no trigram (-1)."""
    word, known = pd.factorize(token)
    size = np.int64(len(known) + 1)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[starts] = size - 1
    known = np.append(known, _START)
    pair, pairs = pd.factorize(before * size + word)
    pair_hash = _mix(_mix(known[pairs // size]) * _GOLD + known[pairs % size])
    inner = np.ones(len(token), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    triple, triples = pd.factorize(pair[inner - 1] * size + word[inner])
    keys = np.concatenate([_mix(known[:-1]) & ~_ORDER, pair_hash & ~_ORDER | np.uint64(1),
                           _mix(pair_hash[triples // size] * _GOLD + known[triples % size]) & ~_ORDER | np.uint64(2)])
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    third = np.full(len(token), -1, np.int64)
    third[inner] = place[triple + (size - 1 + len(pairs))]
    return keys[order], place[word], place[pair + (size - 1)], third


def _range_ends(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal key ranges ends in the sorted keys."""
    bounds = [((p + 1) << 64) // parts - 1 for p in range(parts)]
    return np.searchsorted(keys, np.array(bounds, dtype=np.uint64), side="right")


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, without the high bytes that all lack."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, steps[0] = steps[0], 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return first.tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width = data[8]
    steps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64) + np.frombuffer(data[:8], np.uint64)[0]


def _pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.int64)


def _blocks(docs: DataFrame, trains: Column) -> DataFrame:
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    return docs.select(F.col("doc_id").cast("string"), "text", block.alias("block"), trains.alias("trains"))


def _hashed(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "block", "trains", F.transform(
        words(ascii_lower(F.col("text"))), lambda w: F.xxhash64(w)).alias("hashes"))


def _request(parts: int):
    """Blocks of consecutive rows -> their distinct n-grams with the block's own training counts, by key range."""
    def packs(block: int, rows: list[pd.DataFrame]) -> pd.DataFrame:
        arrays = [a for r in rows for a in r["hashes"]]
        trains = np.concatenate([r["trains"].to_numpy(bool) for r in rows])
        token, starts = _tokens(arrays)
        keys, *places = _ngrams(token, starts)
        in_training = np.repeat(trains, np.diff(np.r_[starts, len(token)]))
        counts = np.zeros(len(keys), np.int64)
        for place in places:
            counts += np.bincount(place[in_training & (place >= 0)], minlength=len(keys))
        ends = _range_ends(keys, parts)
        begins = np.r_[0, ends[:-1]]
        some = np.flatnonzero(ends > begins)
        return pd.DataFrame({"block": block, "part": some.astype(np.int32),
                             "keys": [_pack_keys(keys[begins[p]:ends[p]]) for p in some],
                             "counts": [_pack_counts(counts[begins[p]:ends[p]]) for p in some]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, rows = None, []
        for batch in batches:
            for b, part in batch.groupby("block", sort=True):  # ids ascend within a partition
                if rows and b != block:
                    yield packs(block, rows)
                    rows = []
                block = b
                rows.append(part)
        if rows:
            yield packs(block, rows)

    return run


def _sum_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """All packs of a key range -> each block's keys' total counts, and one row (block -1) with the range's N and V."""
    keys = [_unpack_keys(k) for k in pdf["keys"]]
    back = [_unpack_counts(c) for c in pdf["counts"]]
    largest = max(keys, key=len)
    pieces = 1 + sum(len(k) for k in keys) // SLICE_KEYS
    bounds = largest[np.arange(1, pieces) * len(largest) // pieces]
    cuts = [np.r_[0, np.searchsorted(k, bounds), len(k)] for k in keys]
    n = v = 0
    for i in range(pieces):  # the packs are sorted, so a slice of the range is a slice of each
        slices = [slice(c[i], c[i + 1]) for c in cuts]
        distinct, place = np.unique(np.concatenate([k[p] for k, p in zip(keys, slices)]), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([c[p] for c, p in zip(back, slices)]))
        for c, p, sums in zip(back, slices, np.split(total[place], np.cumsum([p.stop - p.start for p in slices])[:-1])):
            c[p] = sums
        unigrams = total[(distinct & _ORDER) == 0]
        n, v = n + int(unigrams.sum()), v + int((unigrams > 0).sum())
    out = pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "counts": [_pack_counts(c) for c in back],
                        "n": 0, "v": 0})
    sums = pd.DataFrame({"block": [-1], "part": pdf["part"].iloc[:1].to_list(), "counts": [b""],
                         "n": [n], "v": [v]})
    return pd.concat([out, sums], ignore_index=True)


def _score(n_train: int, v_train: int, mu: float, mu_pair: float, add: float):
    """A block's rows and its counts -> scores."""
    norm = n_train + add * (v_train + 1)

    def run(rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        token, starts = _tokens(list(rows["hashes"]))
        keys, first, second, third = _ngrams(token, starts)
        packs = counted.sort_values("part")
        counts = np.concatenate([_unpack_counts(c) for c in packs["counts"]])
        if len(counts) != len(keys):
            raise ValueError("the documents changed between two reads: write them to a table first")
        c_word, c_pair = counts[first], counts[second]
        c_triple = np.where(third >= 0, counts[third], 0)
        c_state = np.empty_like(c_word)  # the state is the token before; at the start, as many as training texts
        c_state[1:] = c_word[:-1]
        c_state[starts] = c_word[np.r_[starts[1:], len(token)] - 1]
        c_pair_state = np.zeros_like(c_pair)  # the state is the two tokens before, the start of the text one of them
        c_pair_state[1:] = c_pair[:-1]
        c_pair_state[starts] = 0
        p_root = (c_word + add) / norm
        p_word = np.where(c_pair > 0, (c_pair + mu * p_root) / (c_state + mu),  # arc of the word's state
                          mu / (c_state + mu) * p_root)  # failure arc, then the root's
        weight = np.log10(np.where(c_triple > 0, (c_triple + mu_pair * p_word) / (c_pair_state + mu_pair),
                                   mu_pair / (c_pair_state + mu_pair) * p_word))
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "held_out": ~rows["trains"].astype(bool),
            "n_tokens": np.diff(np.r_[starts, len(token)]),
            "n_known": np.add.reduceat((c_word > 0).astype(np.int64), starts),
            "base_score": np.round(np.add.reduceat(np.log10(p_root), starts), 6),
            "score": np.round(np.add.reduceat(weight, starts), 6)})

    return run


def score_texts(docs: DataFrame, trains: Column, mu: float = MU, mu_pair: float = MU_PAIR, add: float = ADD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; trained on ``trains`` rows."""
    parts = text_partitions(docs)
    blocks = _blocks(docs, F.coalesce(trains, F.lit(False)))
    packs = _hashed(blocks).drop("doc_id").mapInPandas(_request(parts), "block long, part int, keys binary, counts binary")
    counted = written(packs.groupBy("part").applyInPandas(
        _sum_range, "block long, part int, counts binary, n long, v long"), "lm-counts")
    sums = counted.where("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    placed = _hashed(blocks.repartition(parts, "block"))  # the texts are shuffled; their hashes would take more
    scored = placed.groupBy("block").cogroup(
        counted.where("block >= 0").select("block", "part", "counts").groupBy("block")).applyInPandas(
        _score(n, v, mu, mu_pair, add),
        "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("train_tokens", F.lit(n).cast("long"))
