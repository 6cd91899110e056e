"""Toxicity by noisy-channel deobfuscation.

A token that looks disguised (letters mixed with digits or symbols, letters
drawn out, letters spaced or dotted apart) is read as a noisy copy of a clean
word. Each of its characters allows some intended letters at a channel cost
("1": i or l; a repeated character: nothing; a blank between single letters:
nothing or a word's end, and so for separators; "*": any letter). The characters
form a lattice, and Viterbi finds the path that is most probable under the
channel costs and a character 4-gram model, over all states (the last three
letters) and tokens of any length: on a table of states while they are few, on
arrays of all 27^3 where a token has several wild characters. Other tokens stand
for themselves. The restored words are then scored.

The character model counts the 4-grams of all documents' plain words over
a-z and the word boundary, accents dropped: a table of 27^4 cells, whatever the
corpus. The scorer is a logistic regression (L1) on the presence of words and word starts,
fitted on at most ``SAMPLE_ROWS`` labelled training rows (a hash order decides
which) and ``MAX_FEATURES`` words. Both are broadcast: 27^4 + ``MAX_FEATURES``
numbers at most.

Cases: null and empty texts have no words and get the base score; several
labels of a document count as the largest, null labels as none; repeated rows
are scored alike, one result each; where nothing can be learnt (no labels of
both kinds, or no word that tells them apart) every score is the smoothed share of
toxic labels, but at most ``UNLEARNT``, which predicts nothing toxic; ties: features
of equal gain are taken in order of their text, readings of equal cost in that of
theirs; extra columns pass through (``score``, ``predicted`` and the counts replace
columns of the same name).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from navlens.llm.common import from_state, send_state

PREDICT_FROM = 0.3
#: Highest score where no feature could be learnt: below ``PREDICT_FROM``.
UNLEARNT = 0.2
SAMPLE_ROWS = 20_000
MAX_FEATURES = 2_000
MIN_FEATURE_ROWS = 4
#: A feature's odds of a toxic row are this many times higher or lower than those of all rows, at least.
MIN_ODDS_RATIO = 3.0
L1 = 0.0005
ORDER = 4
LETTERS = 27  # 0: word boundary, 1-26: a-z
#: Wild characters of a token from which on it is decoded on arrays of all states.
MANY_WILD = 3
#: Positions between the score arrays that such a decoding keeps; the steps between two are done twice.
CHECKPOINT = 128

# What a character may stand for in a disguised word.
LEET: dict[str, str] = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
ANY_LETTER = "*#"
SEPARATORS = ".-_~'*#/\\,:"
# Costs in nats: a stand-in, a repetition dropped from a run of three or more, or of two, a dropped separator, a blank kept as a word's end, any letter.
STAND_IN, DRAWN_OUT, DOUBLED, DROPPED, WORD_END, WILD = -0.7, -0.3, -6.0, -0.1, -2.0, -4.0

# Letters with accents -> their plain letters.
_FOLD = {c: "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
         for c in range(0xC0, 0x250)} | {ord("ß"): "ss", ord("ø"): "o", ord("æ"): "ae", ord("œ"): "oe", ord("ł"): "l"}
_PLAIN = regex.compile(r"\p{L}+")
_SPACED = regex.compile(r"(?<!\S)[\p{L}0-9@$!|+*](?:[ ._\-]++[\p{L}0-9@$!|+*](?![\p{L}\p{N}])){2,}+")
_EDGES = regex.compile(r"^[^\p{L}0-9@$!|+(<€£*]+|[^\p{L}0-9]+$")
#: Inside a token: a letter beside a digit or symbol that stands for one, or a letter three times on end.
_NOISY = regex.compile(r"\p{L}[0-9@$!|+(<€£*#._~\-]+\p{L}|[0-9@$!|+(<€£]+\p{L}|\p{L}[0-9]|(\p{L})\1\1")
_MARKS = re.compile(r"[0-9@$!|+(<€£*#._~\-]+")
_LISTED = re.compile(r"[,;:/\\]+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
#: Lengths of the word starts that are features beside whole words.
STARTS = (4, 6)


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else text.translate(_FOLD)


def disguised(lower: str) -> list[str]:
    """Distinct tokens that look disguised; a run of spaced or dotted single letters is one token."""
    out, end = {m.group() for m in _SPACED.finditer(lower)}, len(lower)
    done = 0
    for at in sorted(_noisy_places(lower)):
        if at < done:
            continue  # in the token just seen
        first = done = at
        while first and not lower[first - 1].isspace():
            first -= 1
        while done < end and not lower[done].isspace():
            done += 1
        if done - first >= 3:
            token = _EDGES.sub("", lower[first:done])
            if len(token) >= 3 and _NOISY.search(token):
                out.add(token)
                if _LISTED.search(token):  # the parts of a list without blanks are read on their own too
                    out.update(p for p in _LISTED.split(token) if len(p) >= 3 and _NOISY.search(p))
    return sorted(out)


def _noisy_places(lower: str) -> list[int]:
    """Where ``_NOISY`` may match; cheaper on long texts than to search for it."""
    out = [m.start() for m in _THRICE.finditer(lower)]
    for m in _MARKS.finditer(lower):
        a, b = m.span()
        before, after = a > 0 and lower[a - 1].isalpha(), b < len(lower) and lower[b].isalpha()
        if after or before and lower[a].isdigit():
            out.append(a)
    return out


def word_features(words: set[str]) -> set[str]:
    """The words, their starts ("ab-"), and starts that two ("ab--") or three ("ab---") words or more share."""
    out = set(words)
    for k in STARTS:
        seen = Counter(w[:k] for w in words if len(w) > k)
        out.update(x + "-" for x in seen)
        out.update(x + "--" for x, n in seen.items() if n > 1)
        out.update(x + "---" for x, n in seen.items() if n > 2)
    return out


def count_ngrams(words: dict[str, int], counts: np.ndarray) -> None:
    """Adds the character 4-grams of folded a-z words, boundaries included, to ``counts`` (27^4 cells)."""
    plain = [(w, n) for w, n in words.items() if w.isascii() and w.isalpha()]
    if not plain:
        return
    text = "```" + "```".join(w for w, _ in plain) + "```"  # "`" is the code before "a"
    codes = np.frombuffer(text.encode(), np.uint8).astype(np.int64) - 96
    cell = ((codes[:-3] * LETTERS + codes[1:-2]) * LETTERS + codes[2:-1]) * LETTERS + codes[3:]
    weight = np.repeat([n for _, n in plain], [len(w) + 3 for w, _ in plain])
    real = (codes[3:] > 0) | (codes[2:-1] > 0)  # a letter, or the first boundary after one
    np.add.at(counts, cell[real], weight[real[:len(weight)]] if len(weight) == len(real) else weight[:len(real)][real])


class Channel:
    """Viterbi decoder of character lattices under a character 4-gram model."""

    def __init__(self, counts: np.ndarray):
        c4 = counts.astype(np.float64).reshape((LETTERS,) * 4)
        p = (c4.sum((0, 1, 2)) + 0.5) / (c4.sum() + 0.5 * LETTERS)
        for level, strength in ((2, 5.0), (1, 5.0), (0, 5.0)):  # each order leans on the one below it
            c = c4.sum(tuple(range(level)))
            p = (c + strength * p) / (c.sum(-1, keepdims=True) + strength)
        self.log_table = np.log(p).astype(np.float32)  # sent to the tasks as an array

    @cached_property
    def logp(self) -> list[float]:
        return self.log_table.reshape(-1).tolist()

    @cached_property
    def cube(self) -> np.ndarray:
        return self.log_table.astype(np.float64)

    def _choices(self, token: str) -> list[list[tuple[str, float]]]:
        lattice, before = [], ""
        for at, ch in enumerate(token):
            if "a" <= ch <= "z":
                some = [(ch, 0.0)]
            elif ch in LEET:
                some = [(x, STAND_IN) for x in LEET[ch]]
            elif ch in SEPARATORS + " ":
                some = [("", DROPPED), (" ", WORD_END)]
            else:
                some = [("", DROPPED)]
            if ch in ANY_LETTER:
                some = some + [(chr(x), WILD) for x in range(97, 123)]
            if ch == before and ch not in SEPARATORS + " ":
                run = token[at - 2:at + 1] == ch * 3 or token[at - 1:at + 2] == ch * 3
                some = some + [("", DRAWN_OUT if run else DOUBLED)]
            lattice.append(some)
            before = ch
        return lattice

    def restore(self, token: str) -> str:
        """The most probable clean reading (words parted by blanks)."""
        lattice = self._choices(token)
        if sum(len(some) > 26 for some in lattice) >= MANY_WILD:
            return self._restore_wild(lattice)
        logp, square = self.logp, LETTERS ** 3
        paths: dict[int, tuple[float, str]] = {0: (0.0, "")}  # last three letters -> best score and reading
        for some in lattice:
            new: dict[int, tuple[float, str]] = {}
            for state, (score, reading) in paths.items():
                for emitted, cost in some:
                    if emitted == "":
                        to, total, text = state, score + cost, reading
                    elif emitted == " ":
                        to, total, text = 0, score + cost + logp[state * LETTERS], reading + " "
                    else:
                        code = ord(emitted) - 96
                        to, text = (state * LETTERS + code) % square, reading + emitted
                        total = score + cost + logp[state * LETTERS + code]
                    if to not in new or total > new[to][0]:
                        new[to] = (total, text)
            paths = new
        best = max(paths.items(), key=lambda x: (x[1][0] + logp[x[0] * LETTERS], x[1][1]))
        return best[1][1]

    def _step(self, score: np.ndarray, some: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all states (a, b, c) behind a lattice position, and how each was reached.

        Reached: the letter that left the state (0-26), 27 for an emission of nothing, 28 + state for a word's end,
        which leads to state 0 from any state.
        """
        n, square = LETTERS, LETTERS ** 3
        new, how = np.full(square, -np.inf), np.full(square, 27, dtype=np.int16)
        ends = [cost for emitted, cost in some if emitted == " "]
        for emitted, cost in some:
            if emitted == "":
                better = score + cost > new
                new[better], how[better] = (score + cost)[better], 27
        letters = [(ord(e) - 96, cost) for e, cost in some if e not in ("", " ")]
        if letters:
            codes = [c for c, _ in letters]
            moved = score.reshape(n, n, n, 1) + self.cube[:, :, :, codes] + np.array([cost for _, cost in letters])
            from_ = moved.argmax(0)  # the letter that goes out of the state
            top = np.take_along_axis(moved, from_[None], 0)[0]
            grid, ways = new.reshape(n, n, n), how.reshape(n, n, n)
            for k, c in enumerate(codes):
                better = top[:, :, k] > grid[:, :, c]
                grid[:, :, c][better], ways[:, :, c][better] = top[:, :, k][better], from_[:, :, k][better]
        if ends:
            closed = score + self.cube[:, :, :, 0].reshape(-1) + max(ends)
            at = int(closed.argmax())
            if closed[at] > new[0]:
                new[0], how[0] = closed[at], 28 + at
        return new, how

    def _restore_wild(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The reading on arrays of all states: scores are kept at checkpoints, a block's ways are made again going back."""
        score = np.full(LETTERS ** 3, -np.inf)
        score[0] = 0.0
        kept = [score]
        for i, some in enumerate(lattice):
            score, _ = self._step(score, some)
            if (i + 1) % CHECKPOINT == 0:
                kept.append(score)
        state = int((score + self.cube[:, :, :, 0].reshape(-1)).argmax())
        out: list[str] = []
        for first in range((len(lattice) - 1) // CHECKPOINT * CHECKPOINT, -1, -CHECKPOINT):
            score, ways = kept[first // CHECKPOINT], []
            for some in lattice[first:first + CHECKPOINT]:
                score, how = self._step(score, some)
                ways.append(how)
            for how in reversed(ways):
                way = int(how[state])
                if way >= 28:
                    out.append(" ")
                    state = way - 28
                elif way < 27:
                    out.append(chr(96 + state % LETTERS))
                    state = (way * LETTERS ** 2) + state // LETTERS
        return "".join(reversed(out))


class Restorer:
    """Texts -> sets of restored words; remembers the readings of up to ``memory`` tokens."""

    def __init__(self, channel: Channel, memory: int = 100_000):
        self.channel, self.memory, self.readings = channel, memory, {}

    def words(self, text: str | None) -> tuple[set[str], int]:
        """(plain and restored words, number of restored tokens)."""
        if not text:
            return set(), 0
        lower = text.lower()  # plain words keep their accents; only what is decoded loses them
        out, tokens = set(_PLAIN.findall(lower)), disguised(lower)
        for token in tokens:
            reading = self.readings.get(token)
            if reading is None:
                if len(self.readings) >= self.memory:
                    self.readings.clear()
                reading = self.readings[token] = self.channel.restore(fold(token))
            out.update(reading.split())
        return out, len(tokens)


def train_channel(docs: DataFrame) -> Channel:
    """Character model of the plain words of all documents (one pass; 27^4 sums at most come back)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(LETTERS ** ORDER, np.int64)
        for batch in batches:
            for a in range(0, len(batch), 500):
                words: Counter = Counter()
                for text in batch["text"].iloc[a:a + 500]:
                    if text:
                        words.update(_PLAIN.findall(fold(text)))
                count_ngrams(words, counts)
        cells = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": cells.astype(np.int32), "n": counts[cells]})

    sums = (docs.select("text").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    counts = np.zeros(LETTERS ** ORDER, np.int64)
    table = sums.toPandas()
    counts[table["cell"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return Channel(counts)


def fit_logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, l1: float = L1,
                 rounds: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) of an L1 logistic regression on presence features given as (row, column) pairs."""
    n, w, share = len(y), np.zeros(n_features), (y.sum() + 0.5) / (len(y) + 1.0)
    bias = math.log(share / (1 - share))
    if not n_features or not n:
        return w, bias
    v = np.ones(n_features)
    for _ in range(15):  # largest curvature
        v = np.bincount(cols, np.bincount(rows, v[cols], n)[rows], n_features)
        norm = np.linalg.norm(v)
        v /= norm or 1.0
    step = 4.0 * n / (norm + n)
    u, bu, t = w.copy(), bias, 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(bu + np.bincount(rows, u[cols], n))))
        new = u - step * np.bincount(cols, (p - y)[rows], n_features) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = bu - step * float((p - y).mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, bu = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return w, bias


def train_scorer(docs: DataFrame, labels: DataFrame, trains: Column, channel: Channel,
                 sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> tuple[dict[str, float], float]:
    """(word -> weight, bias), fitted on at most ``sample_rows`` labelled rows for which ``trains`` holds."""
    spark = docs.sparkSession
    shared = send_state(spark, channel)
    marked = (labels.where(trains & F.col("toxic").isNotNull()).groupBy("doc_id")
              .agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most sample_rows ids: the texts stay put

    def restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(from_state(Channel, shared.value))
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"),
                                "words": [sorted(word_features(restorer.words(t)[0])) for t in batch["text"]]})

    sample = rows.mapInPandas(restored, "toxic int, words array<string>").persist()
    try:
        total, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        share = (toxic + 0.5) / (total + 1.0)
        counts = (sample.select("toxic", F.explode("words").alias("word")).groupBy("word")
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
                  .where(F.col("n") >= MIN_FEATURE_ROWS))
        # odds and divergence, not the share itself: they treat both classes alike, so any share of toxic rows will do
        t, clean = F.col("t"), F.col("n") - F.col("t")
        log_odds = F.log((t + 0.5) / (clean + 0.5)) - math.log(share / (1 - share))
        gain = sum(F.when(x > 0, x * F.log(x / (F.col("n") * of))).otherwise(0.0)
                   for x, of in ((t, share), (clean, 1 - share)))
        chosen = {r["word"]: k for k, r in enumerate(
            counts.where(F.abs(log_odds) >= math.log(MIN_ODDS_RATIO)).orderBy(gain.desc(), "word")
            .limit(max_features).collect())}
        if not chosen or not 0 < toxic < total:
            low = min(share, UNLEARNT)
            return {}, math.log(low / (1 - low))
        names = spark.createDataFrame(list(chosen.items()), "word string, k int")
        pairs = (sample.withColumn("i", F.monotonically_increasing_id()).select("i", "toxic", F.explode("words").alias("word"))
                 .join(F.broadcast(names), "word").select("i", "toxic", "k").toPandas().sort_values(["i", "k"]))
    finally:
        sample.unpersist()
    # numbers only come back; rows without a chosen feature are known by how many they are
    row, ids = pd.factorize(pairs["i"].to_numpy())
    y = np.zeros(total)
    y[row] = pairs["toxic"].to_numpy()
    y[len(ids):len(ids) + toxic - int(y.sum())] = 1.0
    weights, bias = fit_logistic(row.astype(np.int64), pairs["k"].to_numpy(np.int64), y, len(chosen))
    return {w: float(weights[k]) for w, k in chosen.items() if weights[k]}, bias


class Scorer:
    """The fitted regression on sets of words; looks only at the word starts that have a weight."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.words = {f: w for f, w in weights.items() if not f.endswith("-")}
        self.starts: dict[int, dict[str, list[float]]] = {k: {} for k in STARTS}
        for feature, weight in weights.items():
            start = feature.rstrip("-")
            if feature != start:  # one, two or three words
                self.starts[len(start)].setdefault(start, [0.0] * 3)[len(feature) - len(start) - 1] = weight

    def score(self, words: set[str]) -> float:
        parts = [self.bias, *(self.words[w] for w in words & self.words.keys())]
        for k, wanted in self.starts.items():
            seen = Counter(s for w in words if (s := w[:k]) in wanted and len(w) > k) if wanted else {}
            for start, n in seen.items():
                parts.extend(wanted[start][:n])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, math.fsum(parts)))))


def score_toxicity(docs: DataFrame, labels: DataFrame, trains: Column,
                   predict_from: float = PREDICT_FROM) -> DataFrame:
    """``docs`` with n_restored (disguised tokens read), score (6 decimals) and predicted.

    ``trains`` is a condition on ``labels``; other labels are not read.
    """
    channel = train_channel(docs)
    weights, bias = train_scorer(docs, labels, trains, channel)
    shared = send_state(docs.sparkSession, channel)

    @F.pandas_udf("n_restored int, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        restorer, scorer = Restorer(from_state(Channel, shared.value)), Scorer(weights, bias)
        for texts in batches:
            rows = []
            for text in texts:
                words, n = restorer.words(text)
                rows.append((n, round(scorer.score(words), 6)))
            yield pd.DataFrame(rows, columns=["n_restored", "score"])

    return (docs.withColumn("__s", score(F.col("text")))
            .withColumns({"n_restored": F.col("__s.n_restored"), "score": F.col("__s.score")})
            .withColumn("predicted", (F.col("score") >= predict_from).cast("int")).drop("__s"))
