"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). The rules
are not combined by all-must-pass: expectation-maximisation estimates each
rule's accuracies (how often it casts each vote on good and on bad documents)
and the share of good documents from the votes alone, and a document is kept when its posterior probability of being
good reaches ``THRESHOLD``. Documents that fail the base rules (under 20 words,
or over 30 % of the words in repeated 8-word windows) go in any case.

Everything is inside the row with SQL expressions, except the fit: it needs
only how often each combination of votes occurs (at most 3^rules rows, one
aggregate over all documents). The EM rounds are folded over that table by a
SQL ``aggregate`` expression.

Cases: null and empty texts have no words, get zero counts and fail the base
rules; repeated rows are judged alike, one result each; an empty table gives an
empty result; result columns replace columns of the same name. Ties: a posterior
of exactly ``THRESHOLD`` is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from navlens.llm.common import let, words, written

THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
EM_ROUNDS = 30
#: Probability of good in the first guess for rows without a bad vote (its complement for the others).
FIRST_GUESS = 0.999
#: Added to every count that a probability is estimated from: no vote is proof.
PSEUDO = 0.5
#: Least log odds that a vote adds in its own direction: a rule is taken to be no worse than chance, and no more than
#: that. What a vote weighs comes from the fit.
LEAST_ODDS = 0.1
#: Share of good documents expected before any vote is seen, and the weight of that expectation in rows per row: keeps
#: the fit from drifting to a solution where a small group of documents that share odd votes are the good ones.
GOOD_SHARE, SHARE_WEIGHT = 0.8, 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_shouts"]


def window_hashes(ws: Column, k: int = WINDOW) -> Column:
    """64-bit hash of every k-word window (k a power of two): hashes of runs, doubled in length by each pass.

    No pass indexes or slices per element, which in Spark would copy the array for every window.
    """
    def doubled(h: Column, run: int) -> Column:
        if run == k:
            return F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))
        return let(F.zip_with(h, F.slice(h, run + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)),
                   lambda x: doubled(x, 2 * run))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))


def repeated_window_words(ws: Column, k: int = WINDOW) -> Column:
    """Words inside k-word windows that occur twice or more in the row's words, the first occurrence included.

    Windows are compared by 64-bit hash. Where all hashes differ no window repeats; only other rows sort them.
    """
    def cover(starts: Column) -> Column:  # ascending, distinct
        steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)),
                           lambda a, b: F.least(F.lit(k), F.coalesce(b - a, F.lit(k))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = let(placed, lambda t: F.filter(
            F.zip_with(t, F.slice(t, 2, F.size(t)),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
            lambda p: p.isNotNull()))
        return let(F.sort_array(F.array_distinct(F.flatten(pairs))), cover)

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    return F.when(F.size(ws) <= k, F.lit(0)).otherwise(let(window_hashes(ws, k), of_hashes))


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts (long) and those the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeated_window_words(ws).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def of_marks(marks: Column) -> Column:  # only capitals, symbols and "!" are left: a short string
        return F.struct((F.length(marks) - F.length(_without(marks, r"[#*$%&|<>]+"))).cast("long").alias("n_symbols"),
                        (F.length(marks) - F.length(_without(marks, "[A-Z]+"))).cast("long").alias("n_upper"),
                        (F.length(marks) - F.length(_without(marks, "!+"))).cast("long").alias("n_shouts"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (docs.withColumn("__w", let(words(F.col("text")), of_words)).withColumn("__l", let(lines, of_lines))
           .withColumn("__m", let(_without(text, r"[^A-Z#*$%&|<>!]+"), of_marks)))
    return out.withColumns({
        "n_words": F.col("__w.n_words"), "word_chars": F.col("__w.word_chars"), "n_symbols": F.col("__m.n_symbols"),
        "n_dup_lines": F.col("__l.n_dup_lines"), "n_repeat_words": F.col("__w.n_repeat_words"),
        "n_lines": F.col("__l.n_lines"), "n_upper": F.col("__m.n_upper"), "n_shouts": F.col("__m.n_shouts"),
    }).drop("__w", "__l", "__m")


# Rule -> ANSI SQL of its vote (1 good, -1 bad, 0 abstains), in whole numbers.
VOTES: dict[str, str] = {
    "symbols": "CASE WHEN n_symbols = 0 THEN 1 WHEN 10 * n_symbols > n_words THEN -1 ELSE 0 END",
    "word_length": "CASE WHEN 10 * word_chars > 75 * n_words OR 10 * word_chars < 30 * n_words THEN -1 ELSE 0 END",
    "shouting": "CASE WHEN 10 * n_upper > 4 * word_chars THEN -1 ELSE 0 END",
    "exclamations": "CASE WHEN 5 * n_shouts > n_words THEN -1 ELSE 0 END",
    "lines": "CASE WHEN n_lines >= 5 AND 10 * n_dup_lines > 4 * n_lines THEN -1 ELSE 0 END",
    "windows": "CASE WHEN 100 * n_repeat_words > 30 * n_words THEN -1 WHEN n_repeat_words = 0 THEN 1 ELSE 0 END",
    "length": "CASE WHEN n_words < 40 THEN -1 ELSE 1 END",
}
BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)"


def _posterior(vote_list: Column, model: Column) -> Column:
    """Probability of good: prior odds times, for each vote cast, how much likelier it is on good than on bad rows."""
    weight = F.aggregate(F.zip_with(vote_list, model["odds"], lambda v, o: F.get(o, v + 1)),
                         F.log(model["prior"] / (F.lit(1.0) - model["prior"])), lambda s, x: s + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-weight))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def fit_rules(voted: DataFrame, rounds: int = EM_ROUNDS) -> DataFrame:
    """One row ``model`` (prior; odds: for each rule the log odds of good that each vote -1, 0, 1 adds).

    EM over the vote combinations of all rows. The first guess takes rows without a bad vote as good. Each round
    estimates how often a rule casts a vote on good and on bad rows, and from that each combination's posterior.
    Rules are taken to be better than chance (``LEAST_ODDS``); an abstention adds nothing.
    """
    k = len(VOTES)
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))  # at most 3^k rows
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))

    def estimate(rows: Column) -> Column:  # rows: votes, n, good = expected good rows among the n
        def odds(sums: Column) -> Column:
            def of_vote(j: Column, v: int) -> Column:
                hit = F.filter(rows, lambda r: F.get(r["votes"], j) == v)
                return let(F.struct(_sum(F.transform(hit, lambda r: r["good"])).alias("good"),
                                    _sum(F.transform(hit, lambda r: r["n"] - r["good"])).alias("bad")),
                           lambda c: F.log(((c["good"] + F.lit(PSEUDO)) / (sums["good"] + F.lit(2 * PSEUDO)))
                                           / ((c["bad"] + F.lit(PSEUDO)) / (sums["bad"] + F.lit(2 * PSEUDO)))))
            return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.array(
                F.least(of_vote(j, -1), F.lit(-LEAST_ODDS)), F.lit(0.0), F.greatest(of_vote(j, 1), F.lit(LEAST_ODDS))))

        sums = F.struct(_sum(F.transform(rows, lambda r: r["good"])).alias("good"),
                        _sum(F.transform(rows, lambda r: r["n"] - r["good"])).alias("bad"))
        return let(sums, lambda t: F.struct(
            ((t["good"] + F.lit(PSEUDO) + F.lit(GOOD_SHARE * SHARE_WEIGHT) * (t["good"] + t["bad"]))
             / (F.lit(1 + SHARE_WEIGHT) * (t["good"] + t["bad"]) + F.lit(2 * PSEUDO))).alias("prior"),
            odds(t).alias("odds")))

    def scored(p: Column, share: Callable[[Column], Column]) -> Column:
        return F.transform(p, lambda r: F.struct(r["votes"].alias("votes"), r["n"].alias("n"),
                                                 (r["n"] * share(r["votes"])).alias("good")))

    def guess(vote_list: Column) -> Column:
        return F.when(F.array_contains(vote_list, -1), F.lit(1.0 - FIRST_GUESS)).otherwise(F.lit(FIRST_GUESS))

    first = let(scored(F.col("p"), guess), estimate)
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first,
                         lambda m, _: let(scored(F.col("p"), lambda v: _posterior(v, m)), estimate))
    return one.select(fitted.alias("model"))


def with_votes(docs: DataFrame) -> DataFrame:
    return with_features(docs).withColumn("votes", F.array(*[F.expr(v) for v in VOTES.values()]))


def _verdict(voted: DataFrame, threshold: float, rounds: int) -> dict[str, Column]:
    """quality, base_failed and kept as columns over the table that ``voted`` was made from.

    The fitted model (1 + 3 * number of rules doubles) becomes literals.
    """
    model = fit_rules(voted.select("votes"), rounds).first()["model"]
    fixed = F.struct(F.lit(model["prior"]).alias("prior"),
                     F.array(*[F.array(*map(F.lit, o)) for o in model["odds"]]).alias("odds"))
    quality, failed = F.round(_posterior(F.col("votes"), fixed), 6), F.expr(BASE_FAILED)
    return {"quality": quality, "base_failed": failed, "kept": ~failed & (quality >= threshold)}


def judge_quality(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = EM_ROUNDS) -> DataFrame:
    """doc_id, the counts, votes, quality (posterior, 6 decimals), base_failed and kept of every row.

    The counts are written once, without the texts; both the fit and the verdicts read that table.
    """
    voted = written(with_votes(docs).select("doc_id", *BASE, *MORE, "votes"), "quality-votes")
    return voted.withColumns(_verdict(voted, threshold, rounds))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = EM_ROUNDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The votes are cast twice, for the fit and for the verdicts: that costs less than to shuffle the texts to a join.
    The counts go through a generator, below which Spark pushes no filter: they are computed once per row, not once
    per place where the verdict reads them.
    """
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), "text")
    voted = with_votes(row).select("__row", F.inline(F.array(F.struct("n_words", "n_repeat_words", "votes"))))
    return voted.where(_verdict(with_votes(docs.select("text")), threshold, rounds)["kept"]).select("__row.*")
