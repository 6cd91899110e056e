"""Benchmark decontamination.

Test items are indexed: an inverted index with BM25 impacts, each divided by
the item's own score (the item as its query). No passage holds much of an item
of more than ``WHOLE_WORDS`` words, so such an item is also indexed as overlapping
pieces of ``PIECE_WORDS``, each with its own score; a passage that retrieves a
piece retrieves its item, so that one threshold fits items of all lengths. Postings are cut into blocks, each with its largest impact.
Every document is cut into overlapping passages, and every passage is a query
that retrieves all items scoring ``THRESHOLD`` or more by block-max WAND:
cursors ordered by item, the pivot where the terms' largest impacts could
reach the threshold, then the blocks' largest impacts, then the score itself.
Passages whose terms' largest impacts sum to less than the threshold have no
pivot at all; that test is made for all passages of a batch at once.

A retrieved pair is verified: the item's question (all sentences but the last)
and its answer (the last) must each have at least ``OVERLAP`` of their
5-word shingles in the document. Words are lower-cased runs of letters and
digits.

Only test items are sent to tasks, ``SLICE_ITEMS`` items and pieces at a time; more mean
more passes over the documents, never a larger broadcast. No shuffle of
documents.

Cases: null and empty texts and items have no words and match nothing; items
of fewer than 5 words match by their whole word sequence; repeated documents
and repeated items give one row per pair of rows; without items the result is
empty; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from navlens.llm.common import from_state, send_state

K1, B = 1.2, 0.75
PASSAGE_WORDS, PASSAGE_STEP = 32, 16
#: Share of the item's own BM25 score. The best passage holds about half or more of a whole item, and half or more of a piece.
THRESHOLD = 0.35
#: Items of more words are indexed in pieces too.
WHOLE_WORDS = 64
PIECE_WORDS, PIECE_STEP = 48, 24
SHINGLE, OVERLAP = 5, 0.8
SLICE_ITEMS = 20_000
#: Postings in a block.
BLOCK = 8
#: Equal runs of items for which all passages of a document are bounded together, before any cursor moves.
RUNS = 64

_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_SENTENCES = regex.compile(r"[.!?]+(?:\s+|$)|\n+")


def text_words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """(words of all sentences but the last, words of the last); of one sentence: its first and second half."""
    parts = [w for s in _SENTENCES.split(text or "") if s and (w := text_words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else \
        {tuple(words)} if words else set()


def item_pieces(words: list[str]) -> list[list[str]]:
    """The overlapping pieces of a long item; none of a short one."""
    if len(words) <= WHOLE_WORDS:
        return []
    return [words[a:a + PIECE_WORDS] for a in range(0, len(words) - PIECE_WORDS + PIECE_STEP, PIECE_STEP)]


def _postings(benchmark: DataFrame) -> DataFrame:
    """(item, piece, term, impact): BM25 weight over the own score of the item (piece 0) or of its piece.

    item = a number that keeps repeated rows apart. All weights use the statistics of the whole items.
    """
    @F.udf("array<array<string>>")
    def terms(text):  # a test item is short; documents never come here
        words = text_words(text)
        return [words, *item_pieces(words)]

    items = benchmark.select("item_id", "text", F.monotonically_increasing_id().alias("item"))
    tokens = (items.select("item", F.posexplode(terms("text")).alias("piece", "words"))
              .select("item", "piece", F.explode("words").alias("term")))
    every = tokens.groupBy("item", "piece", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = every.where("piece = 0")
    length = every.groupBy("item", "piece").agg(F.sum("tf").alias("len"))
    total = length.where("piece = 0").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    n, avg = total["n"], total["avg"] or 1.0
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg)))
    weights = every.join(length, ["item", "piece"]).join(df, "term").select("item", "piece", "term", weight.alias("w"))
    own = weights.groupBy("item", "piece").agg(F.sum("w").alias("own"))
    return weights.join(own, ["item", "piece"]).select("item", "piece", "term", (F.col("w") / F.col("own")).alias("impact"))


class ItemIndex:
    """Block-max index of the items of one slice; the pieces of long items are numbered after the items."""

    def __init__(self, rows: list[tuple[int, str, float]], texts: dict[int, str],
                 pieces: list[tuple[int, int, str, float]] = ()):
        self.ids = sorted(texts)
        number = {item: k for k, item in enumerate(self.ids)}
        cut = sorted({(item, piece) for item, piece, _, _ in pieces})
        piece_number = {key: len(self.ids) + k for k, key in enumerate(cut)}
        self.item_of = [*range(len(self.ids)), *(number[item] for item, _ in cut)]
        lists: dict[str, list[tuple[int, float]]] = {}
        for item, term, impact in rows:
            lists.setdefault(term, []).append((number[item], impact))
        for item, piece, term, impact in pieces:
            lists.setdefault(term, []).append((piece_number[item, piece], impact))
        self.term_id = {t: k for k, t in enumerate(sorted(lists))}
        self.items, self.impacts, self.block_last, self.block_max = [], [], [], []
        for t in self.term_id:
            post = sorted(lists[t])
            self.items.append([p[0] for p in post])
            self.impacts.append([p[1] for p in post])
            cuts = range(0, len(post), BLOCK)
            self.block_last.append([post[min(c + BLOCK, len(post)) - 1][0] for c in cuts])
            self.block_max.append([max(p[1] for p in post[c:c + BLOCK]) for c in cuts])
        self.largest = np.array([max(x) for x in self.impacts] + [0.0])  # the last: unknown words
        # largest impact of each term in each run of items, a little rounded up
        n_runs = min(RUNS, max(1, len(self.item_of)))
        self.run_max = np.zeros((len(lists) + 1, n_runs), np.float32)
        for t, (items, impacts) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.run_max[t], np.array(items) * n_runs // max(1, len(self.item_of)),
                          np.float32(1.00001) * np.array(impacts, np.float32))
        self.long = {number[item]: {} for item, _ in cut}  # term -> impact in the whole item
        for item, term, impact in rows:
            if number[item] in self.long:
                self.long[number[item]][self.term_id[term]] = impact
        self.parts = [tuple(shingles(w) for w in question_and_answer(texts[i])) for i in self.ids]

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item number, score) with a score of ``threshold`` or more for the distinct terms, by block-max WAND."""
        lists = [(self.items[t], self.impacts[t], self.block_last[t], self.block_max[t], float(self.largest[t]))
                 for t in terms]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        out, slack = [], threshold - 1e-9
        while True:
            live = [k for k in live if at[k] < len(lists[k][0])]
            live.sort(key=lambda k: lists[k][0][at[k]])
            bound, pivot = 0.0, -1
            for place, k in enumerate(live):
                bound += lists[k][4]
                if bound >= slack:
                    pivot = place
                    break
            if pivot < 0:
                return out
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            reach, next_item = 0.0, 1 << 60
            for k in live[:pivot + 1]:  # the blocks that hold, or would hold, the pivot item
                block = at[k] // BLOCK
                last = lists[k][2]
                while block < len(last) and last[block] < item:
                    block += 1
                if block < len(last):
                    reach += lists[k][3][block]
                    next_item = min(next_item, last[block] + 1)
            if reach < slack:  # no item before the first of these blocks ends can reach it
                if pivot + 1 < len(live):
                    next_item = min(next_item, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                target = max(next_item if next_item < 1 << 60 else item + 1, item + 1)
            else:
                score = 0.0
                for k in live[:pivot + 1]:
                    at[k] = self._seek(lists[k], at[k], item)
                    if at[k] < len(lists[k][0]) and lists[k][0][at[k]] == item:
                        score += lists[k][1][at[k]]
                if score >= slack:
                    out.append((item, score))
                target = item + 1
            for k in live[:pivot + 1]:
                at[k] = self._seek(lists[k], at[k], target)

    @staticmethod
    def _seek(postings, at: int, item: int) -> int:
        """The first posting from ``at`` on whose item is ``item`` or later; whole blocks are skipped."""
        items, last = postings[0], postings[2]
        block = at // BLOCK
        while block < len(last) and last[block] < item:
            block += 1
            at = block * BLOCK
        while at < len(items) and items[at] < item:
            at += 1
        return at

    def _reaching(self, ids: np.ndarray, starts: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
        """The passages that could reach the threshold in some run of items."""
        unknown = len(self.term_id)
        for a in range(0, len(starts), 256):
            passages = np.sort(ids[starts[a:a + 256, None] + np.arange(PASSAGE_WORDS)], axis=1)
            again = np.zeros(passages.shape, bool)
            again[:, 1:] = passages[:, 1:] == passages[:, :-1]
            bounds = self.run_max[np.where(again, unknown, passages)].sum(axis=1).max(axis=1)
            yield from passages[bounds >= threshold - 1e-6]

    def matches(self, words: list[str], threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item number, best score, question overlap, answer overlap) of each verified item of a document."""
        if not words:
            return []
        get, unknown = self.term_id.get, len(self.term_id)
        ids = np.array([get(w, unknown) for w in words], dtype=np.int64)
        upto = np.concatenate([[0.0], np.cumsum(self.largest[ids])])
        starts = np.arange(0, max(1, len(ids) - PASSAGE_WORDS + PASSAGE_STEP), PASSAGE_STEP)
        ends = np.minimum(starts + PASSAGE_WORDS, len(ids))
        hopeful = np.flatnonzero(upto[ends] - upto[starts] >= threshold - 1e-9)
        padded = np.append(ids, np.full(PASSAGE_WORDS, unknown))
        best: dict[int, float] = {}
        for passage in self._reaching(padded, starts[hopeful], threshold):
            terms = np.unique(passage)
            for entry, score in self.retrieve(terms[terms < unknown].tolist(), threshold):
                item = self.item_of[entry]
                best[item] = max(score if entry == item else 0.0, best.get(item, 0.0))
        if not best:
            return []
        out, by_size = [], {}
        for item, score in sorted(best.items()):
            shares = []
            for part in self.parts[item]:
                if not part:
                    shares.append(1.0)
                    continue
                size = len(next(iter(part)))
                if size not in by_size:
                    by_size[size] = shingles(words, size)
                shares.append(len(part & by_size[size]) / len(part))
            if min(shares) >= overlap:
                if not score:  # found by its pieces only: the whole item's share is below the threshold
                    impact = self.long[item]
                    score = max(sum(impact.get(t, 0.0) for t in set(padded[a:a + PASSAGE_WORDS].tolist()))
                                for a in starts.tolist())
                out.append((item, score, *shares))
        return out


def _slices(spark: SparkSession, benchmark: DataFrame, size: int) -> Iterator[ItemIndex]:
    """The items, ``size`` items and pieces at a time (bounded: about 60 postings each), as indexes for broadcast."""
    @F.udf("long")
    def entries(text):
        return 1 + len(item_pieces(text_words(text)))

    items = benchmark.select("item_id", "text", F.monotonically_increasing_id().alias("item"))
    n = items.count()
    postings = _postings(benchmark).persist()
    try:
        after = -1
        while n > 0:
            sizes = (items.where(F.col("item") > after).orderBy("item").limit(size)
                     .select("item", entries("text").alias("entries")).collect())
            if not sizes:
                return
            total, last = 0, sizes[0]["item"]
            for r in sizes:  # one item at least
                total += r["entries"]
                if total > size and r is not sizes[0]:
                    break
                last = r["item"]
            part = items.where(F.col("item").between(sizes[0]["item"], last)).orderBy("item").collect()
            texts = {r["item"]: r["text"] for r in part}
            first, after = part[0]["item"], part[-1]["item"]
            found = postings.where(F.col("item").between(first, after)).collect()
            index = ItemIndex([(r["item"], r["term"], r["impact"]) for r in found if not r["piece"]], texts,
                              [tuple(r) for r in found if r["piece"]])
            index.item_ids = [r["item_id"] for r in part]
            yield index
    finally:
        postings.unpersist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
               slice_items: int = SLICE_ITEMS) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, bm25_share, question_overlap, answer_overlap."""
    out = docs.sparkSession.createDataFrame(
        [], "doc_id long, item_id long, bm25_share double, question_overlap double, answer_overlap double")
    for index in _slices(docs.sparkSession, benchmark, slice_items):
        leaks = _leaks(send_state(docs.sparkSession, index), threshold, overlap)
        out = out.unionByName(docs.select("doc_id", F.explode(leaks(F.col("text"))).alias("leak"))
                              .select("doc_id", "leak.*"))
    return out


def _leaks(shared, threshold: float, overlap: float):
    @F.pandas_udf("array<struct<item_id: bigint, bm25_share: double, question_overlap: double, answer_overlap: double>>")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = from_state(ItemIndex, shared.value)
        for texts in batches:
            yield pd.Series([[{"item_id": index.item_ids[item], "bm25_share": round(score, 6),
                               "question_overlap": q, "answer_overlap": a}
                              for item, score, q, a in index.matches(text_words(t), threshold, overlap)]
                             for t in texts], dtype=object)

    return leaks


def _is_clean(shared, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = from_state(ItemIndex, shared.value)
        for texts in batches:
            yield pd.Series([not index.matches(text_words(t), threshold, overlap) for t in texts], dtype=bool)

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
               slice_items: int = SLICE_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, in the columns of ``docs``."""
    out = docs
    for index in _slices(docs.sparkSession, benchmark, slice_items):
        out = out.where(_is_clean(send_state(docs.sparkSession, index), threshold, overlap)(F.col("text")))
    return out
