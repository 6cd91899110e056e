"""Comparison of two releases / two site versions, with alert rules and verdicts
(C4 - C8, A39, A40, C7).

Inputs are the per-release aggregates (one row per release), so everything
here is arithmetic over a handful of rows: the old / new pivot is a single
conditional aggregate, and rule tables are unpivoted with ``inline``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navlens.functions.scalars import pct_change, pct_of, py_round, trunc_int, zero_if_null
from navlens.operators import paths as PA
from navlens.operators import release as R
from navlens.operators import wandering as WD

OLD, NEW = 1, 2  # release_ord of the baseline and of the compared release

# Alert rules of the release comparison (metric, limit, message).
CONCERN_RULES = [
    ("reverse_nav_change_pct", 5, "Significant increase in reverse navigation"),
    ("loop_patterns_change", 0, "More loop patterns detected"),
    ("url_revisits_change_pct", 5, "Increase in URL revisit patterns"),
    ("avg_duration_change", 30, "Sessions taking longer (possible confusion)"),
]
CONCERN_HIGH, CONCERN_MEDIUM = 3, 1
LOOP_LIST_CAP = 5

# Verdict thresholds of the version comparison.
WANDERING_VERDICT_DELTA = 2.0
BACKTRACK_VERDICT_DELTA = 5.0
VOTE_WANDERING, VOTE_BACKTRACK_RATE, VOTE_BACKTRACK_MEAN = 1.0, 2.0, 0.1


def _old_new(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``<col>_old`` / ``<col>_new`` from the per-release rows."""
    aggs = []
    for c in cols:
        aggs.append(F.max(F.when(F.col("release_ord") == OLD, F.col(c))).alias(f"{c}_old"))
        aggs.append(F.max(F.when(F.col("release_ord") == NEW, F.col(c))).alias(f"{c}_new"))
    return df.agg(*aggs)


def release_summary(facts: R.ReleaseFacts) -> DataFrame:
    """Per release: the figures the comparison reads, in few passes.

    One aggregate over the tagged visits gives totals, new users, averages and
    the high-interaction count; one over the per-session URL counts gives the
    sessions that repeat a URL (the numerator of both the reverse-navigation
    and the URL-revisit share: a repeated URL implies at least two URLs); the
    loop count needs the ordered path. Empty periods get zeros.
    """
    pv, dur = zero_if_null("page_views"), zero_if_null("visit_duration")
    v = facts.tagged.groupBy("release_ord").agg(
        F.count(F.lit(1)).alias("total_visits"), F.count_if(F.col("is_new_user")).alias("new_users"),
        trunc_int(F.avg(dur)).alias("avg_duration_sec"), py_round(F.avg(pv), 2).alias("avg_page_views"),
        F.count_if(pv >= R.HIGH_INTERACTION_PAGES).alias("_n_hi"))
    h = facts.release_hits.groupBy("release_ord").agg(F.count(F.lit(1)).alias("total_hits"))
    rep = PA._url_counts_per_visit(facts).groupBy("release_ord").agg(
        F.count_if(F.col("n_urls") > F.col("n_distinct")).alias("_n_rep"))
    lp = PA.loop_pattern_counts(facts)
    z = F.lit(0).cast("bigint")
    out = (facts.periods.join(v, "release_ord", "left").join(h, "release_ord", "left")
                .join(rep, "release_ord", "left").join(lp, "release_ord", "left"))
    tot = F.coalesce(F.col("total_visits"), z)
    new_users = F.coalesce(F.col("new_users"), z)
    rep_pct = pct_of(F.coalesce(F.col("_n_rep"), z), tot)
    return out.select(
        "release_ord", "version", "period_start", "period_end", tot.alias("total_visits"),
        F.coalesce(F.col("total_hits"), z).alias("total_hits"), new_users.alias("new_users"),
        (tot - new_users).alias("returning_users"),
        F.coalesce(F.col("avg_duration_sec"), F.lit(0)).alias("avg_duration_sec"),
        F.coalesce(F.col("avg_page_views"), F.lit(0.0)).alias("avg_page_views"),
        rep_pct.alias("reverse_nav_pct"),
        F.greatest(F.least(F.coalesce(F.col("n_loop_patterns"), z), F.lit(LOOP_LIST_CAP).cast("bigint")),
                   F.lit(1).cast("bigint")).alias("loop_list_len"),
        pct_of(F.coalesce(F.col("_n_hi"), z), tot).alias("high_interaction_pct"),
        rep_pct.alias("url_revisit_pct"))


def release_comparison(summary: DataFrame) -> DataFrame:
    """Old vs new: visit change (absolute, %), duration, page views, reverse
    navigation, loop-list length, high interaction and revisit share changes."""
    p = _old_new(summary, ["version", "total_visits", "avg_duration_sec", "avg_page_views",
                           "reverse_nav_pct", "loop_list_len", "high_interaction_pct",
                           "url_revisit_pct"])
    d = lambda c: F.col(f"{c}_new") - F.col(f"{c}_old")
    return p.select(
        F.col("version_old"), F.col("version_new"),
        d("total_visits").alias("total_change"),
        pct_change(F.col("total_visits_old"), F.col("total_visits_new")).alias("total_change_pct"),
        d("avg_duration_sec").alias("avg_duration_change"),
        d("avg_page_views").alias("avg_page_views_change"),
        d("reverse_nav_pct").alias("reverse_nav_change_pct"),
        d("loop_list_len").alias("loop_patterns_change"),
        d("high_interaction_pct").alias("high_interaction_change_pct"),
        d("url_revisit_pct").alias("url_revisits_change_pct"))


def release_concerns(comparison: DataFrame) -> DataFrame:
    """Alert rules over :func:`release_comparison`: messages, count and level."""
    msgs = F.filter(F.array(*[F.when(F.col(c) > lim, F.lit(msg)) for c, lim, msg in CONCERN_RULES]),
                    lambda x: x.isNotNull())
    n = F.size(msgs)
    return comparison.select(
        "version_old", "version_new", n.cast("int").alias("n_concerns"),
        F.array_join(msgs, "; ").alias("concerns"),
        F.when(n >= CONCERN_HIGH, "high").when(n >= CONCERN_MEDIUM, "medium").otherwise("low")
         .alias("concern_level"))


def release_change_table(summary: DataFrame) -> DataFrame:
    """Numbers of the analysis report: user mix per release and all changes."""
    p = _old_new(summary, ["version", "total_visits", "new_users", "returning_users",
                           "avg_duration_sec", "avg_page_views", "reverse_nav_pct", "loop_list_len",
                           "high_interaction_pct", "url_revisit_pct"])

    def share(part: str, side: str) -> Column:
        tot = F.col(f"total_visits_{side}")
        return F.when(tot > 0, F.col(f"{part}_{side}") / tot * 100).otherwise(F.lit(0.0))

    def chg(c: str) -> Column:
        return F.col(f"{c}_new") - F.col(f"{c}_old")

    return p.select(
        "version_old", "version_new",
        share("new_users", "old").alias("old_new_users_pct"),
        share("returning_users", "old").alias("old_returning_pct"),
        share("new_users", "new").alias("new_new_users_pct"),
        share("returning_users", "new").alias("new_returning_pct"),
        chg("total_visits").alias("visits_change"),
        pct_change(F.col("total_visits_old"), F.col("total_visits_new")).alias("visits_change_pct"),
        chg("avg_duration_sec").alias("duration_change"),
        F.when(F.col("avg_duration_sec_old") > 0,
               chg("avg_duration_sec") / F.col("avg_duration_sec_old") * 100)
         .otherwise(F.lit(0.0)).alias("duration_change_pct"),
        chg("avg_page_views").alias("pages_change"),
        F.when(F.col("avg_page_views_old") > 0, chg("avg_page_views") / F.col("avg_page_views_old") * 100)
         .otherwise(F.lit(0.0)).alias("pages_change_pct"),
        chg("reverse_nav_pct").alias("reverse_nav_change"),
        chg("loop_list_len").alias("loops_change"),
        chg("high_interaction_pct").alias("high_interaction_change"),
        chg("url_revisit_pct").alias("revisits_change"))


def payload_validation(summary: DataFrame, distributions: DataFrame, devices: DataFrame,
                       project_name: str) -> DataFrame:
    """Data-quality rules of a two-release payload: one row per (release, rule).

    Payload-level rules carry ``release_ord = 0``.
    """
    n_rel = summary.agg(F.count(F.lit(1)).alias("n"))
    payload = n_rel.select(F.inline(F.array(
        F.struct(F.lit(0).alias("release_ord"), F.lit("exactly_two_releases").alias("rule"),
                 (F.col("n") == 2).alias("passed")),
        F.struct(F.lit(0).alias("release_ord"), F.lit("project_name_present").alias("rule"),
                 F.lit(bool(project_name and project_name.strip())).alias("passed")))))
    dist_ok = distributions.groupBy("release_ord").agg(
        F.bool_and(F.col("percentage").between(0, 100) & (F.col("count") >= 0)).alias("_dist_ok"))
    dev_ok = devices.groupBy("release_ord").agg(
        F.bool_and(F.col("device_category").between(1, 2)).alias("_dev_ok"))
    per = (summary.join(dist_ok, "release_ord", "left").join(dev_ok, "release_ord", "left")
                  .select("release_ord", F.inline(F.array(
                      F.struct(F.lit("visits_non_negative").alias("rule"),
                               (F.col("total_visits") >= 0).alias("passed")),
                      *[F.struct(F.lit(rule).alias("rule"), cond.alias("passed")) for rule, cond in [
                          ("hits_non_negative", F.col("total_hits") >= 0),
                          ("start_before_end", F.col("period_start") < F.col("period_end")),
                          ("bucket_pct_in_range", F.coalesce(F.col("_dist_ok"), F.lit(True))),
                          ("device_category_in_range", F.coalesce(F.col("_dev_ok"), F.lit(True)))]]))))
    return payload.unionByName(per)


# ---------------------------------------------------------------- A39, A40, C7

def _metric_rows(pivot: DataFrame, metrics: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("metric"),
                              F.col(f"{m}_old").cast("double").alias("value_old"),
                              F.col(f"{m}_new").cast("double").alias("value_new"))
                     for m in metrics])
    out = pivot.select(F.inline(rows))
    return out.select("metric", "value_old", "value_new",
                      (F.col("value_new") - F.col("value_old")).alias("delta"),
                      pct_change(F.col("value_old"), F.col("value_new")).alias("change_pct"))


def version_wandering(joined_v: DataFrame, threshold: int = WD.WANDERING_THRESHOLD) -> DataFrame:
    """Per version: sessions, wandering sessions, rate %, mean hits / pages (0 if none)."""
    s = WD.session_stats(joined_v, ["release_ord", "visit_id"])
    w = F.col("hits") >= threshold
    return s.groupBy("release_ord").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(w).alias("wandering_sessions"),
        (F.count_if(w) / F.count(F.lit(1)) * 100).alias("wandering_rate"),
        F.coalesce(F.avg(F.when(w, F.col("hits"))), F.lit(0.0)).alias("mean_hits"),
        F.coalesce(F.avg(F.when(w, F.col("unique_pages"))), F.lit(0.0)).alias("mean_unique_pages"))


def version_backtracks(joined_v: DataFrame) -> DataFrame:
    """Per version: sessions, sessions with backtracks, rate %, mean backtracks."""
    b = WD.backtracks(joined_v, ["release_ord", "visit_id"])
    return b.groupBy("release_ord").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("backtracks") > 0).alias("sessions_with_backtracks"),
        (F.count_if(F.col("backtracks") > 0) / F.count(F.lit(1)) * 100).alias("backtrack_rate"),
        F.avg("backtracks").alias("mean_backtracks"))


WANDERING_METRICS = ["sessions", "wandering_sessions", "wandering_rate", "mean_hits", "mean_unique_pages"]
BACKTRACK_METRICS = ["sessions", "sessions_with_backtracks", "backtrack_rate", "mean_backtracks"]


def compare_wandering(joined_v: DataFrame, threshold: int = WD.WANDERING_THRESHOLD) -> DataFrame:
    """Old vs new wandering figures: one row per metric with delta and % change."""
    return _metric_rows(_old_new(version_wandering(joined_v, threshold), WANDERING_METRICS),
                        WANDERING_METRICS)


def compare_backtracks(joined_v: DataFrame) -> DataFrame:
    return _metric_rows(_old_new(version_backtracks(joined_v), BACKTRACK_METRICS), BACKTRACK_METRICS)


def version_verdict(joined_v: DataFrame, threshold: int = WD.WANDERING_THRESHOLD) -> DataFrame:
    """Verdicts on wandering share, backtrack share and the overall vote."""
    per = version_wandering(joined_v, threshold).select("release_ord", "wandering_rate") \
        .join(version_backtracks(joined_v).select("release_ord", "backtrack_rate", "mean_backtracks"),
              "release_ord")
    j = _old_new(per, ["wandering_rate", "backtrack_rate", "mean_backtracks"])
    wc = F.col("wandering_rate_new") - F.col("wandering_rate_old")
    bc = F.col("backtrack_rate_new") - F.col("backtrack_rate_old")
    ac = F.col("mean_backtracks_new") - F.col("mean_backtracks_old")
    out = j.select(wc.alias("wandering_change"), bc.alias("backtracks_change"),
                   ac.alias("avg_backtracks_change"))

    def votes(conds):
        return sum((F.coalesce(c, F.lit(False))).cast("int") for c in conds)

    pos = votes([F.col("wandering_change") < -VOTE_WANDERING,
                 F.col("backtracks_change") < -VOTE_BACKTRACK_RATE,
                 F.col("avg_backtracks_change") < -VOTE_BACKTRACK_MEAN])
    neg = votes([F.col("wandering_change") > VOTE_WANDERING,
                 F.col("backtracks_change") > VOTE_BACKTRACK_RATE,
                 F.col("avg_backtracks_change") > VOTE_BACKTRACK_MEAN])
    return out.select(
        "*",
        F.when(F.col("wandering_change") < -WANDERING_VERDICT_DELTA, "better")
         .when(F.col("wandering_change") > WANDERING_VERDICT_DELTA, "worse").otherwise("stable")
         .alias("wandering_verdict"),
        F.when(F.col("backtracks_change") < -BACKTRACK_VERDICT_DELTA, "better")
         .when(F.col("backtracks_change") > BACKTRACK_VERDICT_DELTA, "worse").otherwise("stable")
         .alias("backtracks_verdict"),
        pos.alias("positive_votes"), neg.alias("negative_votes"),
        F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("mixed").alias("overall"))
