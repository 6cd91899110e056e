"""Navigation-path operators of the release catalogue.

A session's path is its listed hits in time order (NULL time first, ties by
list position), keeping only non-empty URLs. Three similar rules differ and
are kept apart on purpose:

* reverse navigation (A20): a URL already seen earlier in the path — adjacent
  repeats count; per session this is ``#urls - #distinct urls``;
* loops (A22): ``u[i] = u[i+2] != u[i+1]`` (A, B, A), overlapping;
* backtracks (A29, in :mod:`navlens.operators.wandering`): ``u[i] = u[i-2]``
  with NULL URLs turned into ``''`` and the middle free to be equal.

Counts that ignore order (A19, A20) are two partial aggregates and need no
window at all; the order-dependent ones use :func:`with_neighbors`, which is
balanced even for one huge bot session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navlens.functions.scalars import nonempty, pct_of, py_round
from navlens.operators.release import ReleaseFacts
from navlens.operators.sequence import with_neighbors

TOP_TRANSITIONS = 10
TOP_LOOPS = 5


def url_path_rows(facts: ReleaseFacts) -> DataFrame:
    """``(release_ord, visit_id, pos, datetime_hit, url)`` with non-empty URLs."""
    return facts.path_rows.filter(nonempty("url")).select(
        "release_ord", "visit_id", "pos", "datetime_hit", "url")


def path_order():
    return [F.col("datetime_hit").asc_nulls_first(), F.col("pos").asc()]


def _url_counts_per_visit(facts: ReleaseFacts) -> DataFrame:
    per_url = url_path_rows(facts).groupBy("release_ord", "visit_id", "url") \
        .agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy("release_ord", "visit_id").agg(
        F.sum("n").alias("n_urls"), F.count(F.lit(1)).alias("n_distinct"),
        F.count_if(F.col("n") > 1).alias("n_revisited"))


def url_revisits(facts: ReleaseFacts) -> DataFrame:
    """Sessions revisiting a URL: count, share, average revisits and revisited URLs.

    Revisits of a session = sum over its URLs of (occurrences - 1).
    """
    per_visit = _url_counts_per_visit(facts) \
        .withColumn("revisits", F.col("n_urls") - F.col("n_distinct")) \
        .filter(F.col("revisits") > 0)
    agg = per_visit.groupBy("release_ord").agg(
        F.count(F.lit(1)).alias("sessions_with_url_revisits"),
        F.sum("revisits").alias("_rev"), F.sum("n_revisited").alias("_uniq"))
    base = facts.totals.join(agg, "release_ord", "left")
    n = F.coalesce(F.col("sessions_with_url_revisits"), F.lit(0).cast("bigint"))
    return base.select(
        "release_ord", "version", n.alias("sessions_with_url_revisits"),
        pct_of(n, F.col("total_visits")).alias("percentage"),
        F.when(n > 0, py_round(F.col("_rev") / n, 1)).otherwise(F.lit(0.0)).alias("avg_revisits_per_session"),
        F.when(n > 0, py_round(F.col("_uniq") / n, 1)).otherwise(F.lit(0.0)).alias("avg_unique_urls_revisited"))


def reverse_navigation(facts: ReleaseFacts) -> DataFrame:
    """Sessions (with >= 2 URLs) that return to an already seen URL; total returns."""
    per_visit = _url_counts_per_visit(facts).filter(F.col("n_urls") >= 2) \
        .withColumn("reverse", F.col("n_urls") - F.col("n_distinct"))
    agg = per_visit.groupBy("release_ord").agg(
        F.count_if(F.col("reverse") > 0).alias("visits_with_reverse_nav"),
        F.sum("reverse").alias("total_reverse_transitions"))
    base = facts.totals.join(agg, "release_ord", "left")
    z = F.lit(0).cast("bigint")
    n = F.coalesce(F.col("visits_with_reverse_nav"), z)
    return base.select("release_ord", "version", n.alias("visits_with_reverse_nav"),
                       pct_of(n, F.col("total_visits")).alias("percentage"),
                       F.coalesce(F.col("total_reverse_transitions"), z).alias("total_reverse_transitions"))


def _with_next(facts: ReleaseFacts) -> DataFrame:
    """Path rows with the next two URLs; one DataFrame per facts object, so
    transitions, loops and loop counts share the same plan subtree (and AQE
    reuses its exchanges) instead of building three neighbour passes."""
    cached = facts.__dict__.get("_path_next")
    if cached is None:
        # a session's rows are at most the ids it lists: the narrow bridge tells which sessions are hot
        cached = with_neighbors(url_path_rows(facts), ["release_ord", "visit_id"], path_order(), None, "url",
                                leads=(1, 2), sizes=None if facts.is_written else facts.bridge)
        facts.__dict__["_path_next"] = cached
    return cached


def common_transitions(facts: ReleaseFacts, top_n: int = TOP_TRANSITIONS) -> DataFrame:
    """Most frequent consecutive URL pairs (self-pairs included), top ``top_n``."""
    pairs = _with_next(facts).filter(F.col("next1").isNotNull())
    g = pairs.groupBy("release_ord", F.col("url").alias("from_url"), F.col("next1").alias("to_url")) \
        .agg(F.count(F.lit(1)).alias("transition_count"))
    w = Window.partitionBy("release_ord").orderBy(
        F.col("transition_count").desc(), F.col("from_url"), F.col("to_url"))
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
             .join(facts.periods.select("release_ord", "version"), "release_ord")
             .select("release_ord", "version", "rank", "from_url", "to_url", "transition_count"))


def loop_patterns(facts: ReleaseFacts, top_n: int = TOP_LOOPS, as_array: bool = False) -> DataFrame:
    """Most frequent A -> B -> A triples (A != B), top ``top_n``; ``sequence`` as text or as an array of URLs."""
    join = F.array("url_a", "url_b", "url_a") if as_array else F.concat_ws(" -> ", "url_a", "url_b", "url_a")
    t = _with_next(facts).filter(
        (F.col("next2") == F.col("url")) & (F.col("next1") != F.col("url")))
    g = t.groupBy("release_ord", F.col("url").alias("url_a"), F.col("next1").alias("url_b")) \
        .agg(F.count(F.lit(1)).alias("occurrences"))
    w = Window.partitionBy("release_ord").orderBy(F.col("occurrences").desc(), "url_a", "url_b")
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
             .join(facts.periods.select("release_ord", "version"), "release_ord")
             .select("release_ord", "version", "rank",
                     join.alias("sequence"),
                     "occurrences"))


def loop_pattern_counts(facts: ReleaseFacts) -> DataFrame:
    """``(release_ord, n_loop_patterns)``: distinct A -> B -> A triples per release."""
    t = _with_next(facts).filter(
        (F.col("next2") == F.col("url")) & (F.col("next1") != F.col("url")))
    n = t.select("release_ord", "url", "next1").distinct().groupBy("release_ord") \
        .agg(F.count(F.lit(1)).alias("n_loop_patterns"))
    return facts.periods.select("release_ord").join(n, "release_ord", "left") \
        .withColumn("n_loop_patterns", F.coalesce("n_loop_patterns", F.lit(0).cast("bigint")))


def revisit_flags(facts: ReleaseFacts) -> DataFrame:
    """Row-level form of reverse navigation: is this URL already seen in the path?

    The first occurrence per (session, URL) is a grouped ``min`` of the
    ordering key (partial aggregation, skew-safe); every later row is a revisit.
    """
    rows = url_path_rows(facts)
    key = F.struct(F.coalesce(F.col("datetime_hit"), F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'"))
                   .alias("t"), F.col("pos").alias("p"))
    first = rows.groupBy("release_ord", "visit_id", "url").agg(F.min(key).alias("_first"))
    out = rows.withColumn("_key", key).join(first, ["release_ord", "visit_id", "url"])
    return (out.join(facts.periods.select("release_ord", "version"), "release_ord")
               .select("release_ord", "version", "visit_id", "pos", "url",
                       (F.col("_key") != F.col("_first")).alias("seen_before")))
