"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern; each *distinct* word of a batch is
encoded once: its bytes start as single-byte pieces, and the adjacent pair
whose concatenation has the lowest rank (the leftmost of equals) is merged
until no pair has a rank. All distinct words of a batch take their merges
together, one merge of each per pass, on arrays of piece ids; words of more
than ``LONG_WORD`` bytes, of which a text may be one, go through a heap
instead. Decoding looks each id up in the table of binary pieces and
concatenates.

Only the rank table (50,256 rows in the public vocabularies; ``MAX_RANKS`` is
checked) is sent to the tasks. A task remembers words up to ``MEMORY_WORDS``
and then starts over. No shuffle.

Cases: null and empty texts have no tokens; repeated rows are encoded alike,
one result each; extra columns pass through, result columns replace columns of
the same name. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

LONG_WORD = 48
MEMORY_WORDS = 150_000
MAX_RANKS = 1_000_000
NO_RANK = np.iinfo(np.int64).max

_RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file (base64 of the bytes, rank) -> piece -> rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{len(ranks)} ranks are more than {MAX_RANKS}, too many to send to every task")
    return ranks


class ByteBpe:
    """Ranked merges over arrays of piece ids (a piece's id is its rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.pieces = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.size = size
        # every way to cut a piece in two pieces is a pair that merges into it
        pairs = {ranks[p[:i]] * size + ranks[p[i:]]: r for p, r in ranks.items() for i in range(1, len(p))
                 if p[:i] in ranks and p[i:] in ranks}
        self.merges = pairs
        self.keys = np.fromiter(sorted(pairs), dtype=np.int64, count=len(pairs))
        self.into = np.fromiter((pairs[k] for k in self.keys.tolist()), dtype=np.int64, count=len(pairs))

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.into[at], NO_RANK)

    def _long(self, word: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, size, merges = len(ids), self.size, self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := merges.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or merges.get(ids[i] * size + ids[j]) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := merges.get(r * size + ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := merges.get(ids[p] * size + r)) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
        out: list[list[int]] = [[]] * len(words)
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = self._long(w)
        if not short:
            return out
        ids = self.of_byte[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        word = np.repeat(np.arange(len(short)), [len(words[k]) for k in short])
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), NO_RANK)
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same] = self._ranks_of(ids[same], ids[same + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            still = best != NO_RANK
            done_ids.append(ids[~still])
            done_word.append(word[~still])
            hit = np.flatnonzero(still & (rank == best))
            first = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]] if len(hit) else hit
            ids[first] = best[first]
            still[first + 1] = False
            ids, word = ids[still], word[still]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        parts = np.split(ids[order], np.cumsum(np.bincount(word, minlength=len(short)))[:-1])
        for k, p in zip(short, parts):
            out[k] = p.tolist()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (ids joined by commas) and decoded_sha256 of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(_RESULT)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, split = ByteBpe(shared.value), regex.compile(pattern).findall
        ids_of: dict[str, str] = {}
        bytes_of: dict[str, bytes] = {}
        for texts in batches:
            rows = []
            for chunk in range(0, len(texts), 512):
                split_texts = [split(t) if isinstance(t, str) else [] for t in texts.iloc[chunk:chunk + 512]]
                if len(ids_of) > MEMORY_WORDS:
                    ids_of.clear()
                    bytes_of.clear()
                new = list({w for ws in split_texts for w in ws if w not in ids_of})
                for w, ids in zip(new, bpe.encode_words([w.encode("utf-8") for w in new])):
                    ids_of[w], bytes_of[w] = ",".join(map(str, ids)), bpe.decode(ids)
                for ws in split_texts:
                    ids = ",".join([ids_of[w] for w in ws])
                    rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                                 hashlib.sha256(b"".join([bytes_of[w] for w in ws])).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.withColumn("__d", digest(F.col("text")))
            .withColumns({c: F.col(f"__d.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("__d"))
