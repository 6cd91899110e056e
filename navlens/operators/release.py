"""Release metrics: the per-period catalogue (release info, visits, distributions,
segments, pages, funnel, session complexity).

A *release* is a named period ``[start, end]`` (both ends inclusive; periods
may overlap, so a visit may count in both). All releases are evaluated in one
plan: visits are tagged with ``release_ord`` by a join against the small
period table (a parameter, so its broadcast is bounded), and every metric is
one grouped aggregate keyed by ``release_ord`` — one scan and one shuffle per
metric family instead of one pass per release and per segment value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navlens.functions.scalars import (nonempty, nonempty_or_null, pct_of, py_round, trunc_int,
                                       url_leaf, zero_if_null)
from navlens.operators.linkage import visit_hit_rows, watch_id_bridge, with_canonical_ids
from navlens.operators.quantiles import exact_quantiles

# The two test releases (period bounds are inclusive).
DEFAULT_PERIODS = [
    ("v1", "2024-01-01 00:00:00", "2024-01-15 23:59:59"),
    ("v2", "2024-01-16 00:00:00", "2024-01-30 23:59:59"),
]

# Distribution buckets (min, max); None = open upper end.
PAGE_VIEW_BUCKETS = [(1, 1), (2, 5), (6, 10), (11, None)]
DURATION_BUCKETS = [(0, 30), (31, 120), (121, 300), (301, None)]

# Segment dimensions, their column and top-k cut (None = all).
SEGMENT_DIMENSIONS = {
    "device": ("device_category", None),
    "os": ("operating_system", 10),
    "browser": ("browser", 10),
    "orientation": ("screen_orientation_name", None),
    "search_engine": ("last_search_engine_root", 10),
    "city": ("region_city", 15),
}
DEVICE_LABELS = {1: "Desktop", 2: "Mobile/Tablet"}
# Fallback segment when a release has visits but no value of the dimension.
SEGMENT_FALLBACK = {"search_engine": "direct", "city": "Unknown"}

HIGH_INTERACTION_PAGES = 10
UNIQUE_URL_ESTIMATE_FACTOR = 0.8
UNIQUE_URL_ESTIMATE_CAP = 20
PAGE_DIVERSITY_CAP = 10
TITLE_MAX_CHARS = 100
TOP_PAGES = 20
FUNNEL_MAX_TARGETS = 5
FUNNEL_DEFAULT_STEPS = 3
MIN_TS = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"


def _ts(x) -> dt.datetime:
    if isinstance(x, dt.datetime):
        return x
    return dt.datetime.fromisoformat(str(x).replace("T", " "))


def _lit_ts(x) -> Column:
    return F.lit(_ts(x).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def period_table(spark: SparkSession, periods: Sequence[tuple] = DEFAULT_PERIODS) -> DataFrame:
    """``(release_ord, version, period_start, period_end)`` from parameters."""
    # built JVM-side from literals (no Python worker for a parameter table)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("release_ord"), F.lit(v).alias("version"),
                              _lit_ts(s).alias("period_start"), _lit_ts(e).alias("period_end"))
                     for i, (v, s, e) in enumerate(periods)])
    return spark.range(1).select(F.inline(rows))


def tag_visits(visits: DataFrame, periods) -> DataFrame:
    """Visits with ``release_ord`` / ``version`` of every period containing them.

    ``periods`` as a parameter list (the normal case) becomes an expression:
    each visit gets the array of periods it falls into, exploded — no join.
    The overall ``[min start, max end]`` range is an ordinary filter, so it
    reaches the Parquet scan (``PushedFilters``) and skips row groups.
    A period DataFrame falls back to a broadcast range join; it has one row
    per requested release, so the broadcast is bounded by the request.
    """
    if isinstance(periods, DataFrame):
        p = F.broadcast(periods.select("release_ord", "version", "period_start", "period_end"))
        cond = visits["date_time"].between(p["period_start"], p["period_end"])
        return visits.join(p, cond, "inner").drop("period_start", "period_end")
    periods = list(periods)
    dt_ = F.col("date_time")
    tags = F.array(*[F.when(dt_.between(_lit_ts(s), _lit_ts(e)),
                            F.struct(F.lit(i + 1).alias("release_ord"), F.lit(v).alias("version")))
                     for i, (v, s, e) in enumerate(periods)])
    lo = min(_ts(s) for _, s, _ in periods)
    hi = max(_ts(e) for _, _, e in periods)
    cols = visits.columns
    return (visits.filter(dt_.between(_lit_ts(lo), _lit_ts(hi)))
                  .select(*cols, F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("_t"))
                  .select(*cols, "_t.release_ord", "_t.version"))


@dataclass
class ReleaseFacts:
    """Lazily defined inputs of all release metrics (nothing runs until used).

    ``periods`` is a list of ``(version, start, end)`` parameters or an
    equivalent period DataFrame.
    """

    visits: DataFrame
    hits: DataFrame
    periods: object
    id_bridge: DataFrame | None = None   # stored (visit_id, pos, watch_id); else parsed from watch_ids
    is_written: bool = False             # tagged visits, release hits and path rows are tables

    def __post_init__(self):
        if isinstance(self.periods, DataFrame):
            self.period_list = None
        else:
            self.period_list = list(self.periods)
            self.periods = period_table(self.visits.sparkSession, self.period_list)

    @cached_property
    def tagged(self) -> DataFrame:
        return tag_visits(self.visits, self.period_list if self.period_list else self.periods)

    @cached_property
    def bridge(self) -> DataFrame:
        """``(visit_id, pos, watch_id, release_ord)`` for tagged visits."""
        if self.id_bridge is not None:
            return self.id_bridge.select("visit_id", "pos", "watch_id") \
                       .join(self.tagged.select("visit_id", "release_ord"), "visit_id")
        return watch_id_bridge(self.tagged, keep=["release_ord"])

    @cached_property
    def release_hits(self) -> DataFrame:
        """Hits fetched for a release: ids listed by any of its visits, once each."""
        ids = with_canonical_ids(self.bridge.select("release_ord", "watch_id")).distinct()
        return ids.join(with_canonical_ids(self.hits), "watch_id", "inner")

    @cached_property
    def path_rows(self) -> DataFrame:
        """Every listed id of every tagged visit resolved to its hit (inner)."""
        return visit_hit_rows(self.bridge, self.hits)

    def materialized(self) -> "ReleaseFacts":
        """The same facts with tagged visits, release hits and path rows written
        once to the shared checkpoint folder (eager).

        For multi-output jobs such as the release document, where some twenty
        metric families would otherwise each re-derive these inputs; also cuts
        lineage, so a lost executor resumes from the written tables.
        """
        from navlens.session import scratch_path
        spark = self.visits.sparkSession
        out = ReleaseFacts(self.visits, self.hits, self.period_list if self.period_list else self.periods,
                           self.id_bridge, is_written=True)
        for name in ("tagged", "release_hits", "path_rows"):
            path = scratch_path(spark, f"facts-{name}")
            getattr(self, name).write.mode("overwrite").parquet(path)
            out.__dict__[name] = spark.read.parquet(path)
        return out

    @cached_property
    def totals(self) -> DataFrame:
        """``(release_ord, total_visits)`` for every period, 0 when empty."""
        n = self.tagged.groupBy("release_ord").agg(F.count(F.lit(1)).alias("total_visits"))
        return (self.periods.select("release_ord", "version").join(n, "release_ord", "left")
                    .withColumn("total_visits", F.coalesce("total_visits", F.lit(0).cast("bigint"))))


def _per_release(facts: ReleaseFacts, agg: DataFrame, zero_cols: dict[str, Column]) -> DataFrame:
    """Attach per-release aggregates to every period; empty periods get zeros."""
    out = facts.periods.select("release_ord", "version").join(agg, "release_ord", "left")
    for c, z in zero_cols.items():
        out = out.withColumn(c, F.coalesce(F.col(c), z))
    return out


# ---------------------------------------------------------------- A1 / C9

def release_info(facts: ReleaseFacts) -> DataFrame:
    """Visits, matched hits and distinct non-empty clients per release."""
    v = facts.tagged.groupBy("release_ord").agg(
        F.count(F.lit(1)).alias("total_visits"),
        F.countDistinct(nonempty_or_null("client_id")).alias("unique_clients"))
    h = facts.release_hits.groupBy("release_ord").agg(F.count(F.lit(1)).alias("total_hits"))
    zero = F.lit(0).cast("bigint")
    out = (facts.periods.join(v, "release_ord", "left").join(h, "release_ord", "left"))
    for c in ("total_visits", "total_hits", "unique_clients"):
        out = out.withColumn(c, F.coalesce(F.col(c), zero))
    return out.select("release_ord", "version", "period_start", "period_end",
                      "total_visits", "total_hits", "unique_clients")


# ---------------------------------------------------------------- A2, A3

def visit_metrics(facts: ReleaseFacts) -> DataFrame:
    """Totals, new / returning users, average and median page views and durations.

    Page views and durations count NULL as 0. Averages of page views are
    rounded half-to-even to 2 digits; duration averages and both medians are
    truncated to integers (median = mean of the two middle values).
    """
    pv, dur = zero_if_null("page_views"), zero_if_null("visit_duration")
    rows = facts.tagged.select("release_ord", "is_new_user", pv.alias("pv"), dur.alias("dur"))
    medians = exact_quantiles(rows, ["release_ord"], {"pv": [0.5], "dur": [0.5]})
    agg = rows.groupBy("release_ord").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("is_new_user")).alias("new_users"),
        py_round(F.avg("pv"), 2).alias("avg_page_views"),
        trunc_int(F.avg("dur")).alias("avg_duration_sec"),
        F.sum("dur").cast("bigint").alias("total_duration_sec")).join(medians, "release_ord").select(
            "*", trunc_int(F.col("q.pv_0")).alias("median_page_views"),
            trunc_int(F.col("q.dur_0")).alias("median_duration_sec"))
    z = F.lit(0).cast("bigint")
    out = _per_release(facts, agg, {
        "total_count": z, "new_users": z, "avg_page_views": F.lit(0.0),
        "median_page_views": F.lit(0), "avg_duration_sec": F.lit(0),
        "median_duration_sec": F.lit(0), "total_duration_sec": z})
    return out.select("release_ord", "version", "total_count", "new_users",
                      (F.col("total_count") - F.col("new_users")).alias("returning_users"),
                      "avg_page_views", "median_page_views", "avg_duration_sec",
                      "median_duration_sec", "total_duration_sec")


def pageview_metrics(facts: ReleaseFacts) -> DataFrame:
    """Matched hits and distinct non-empty URLs among them, per release."""
    agg = facts.release_hits.groupBy("release_ord").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.countDistinct(nonempty_or_null("url")).alias("unique_urls"))
    z = F.lit(0).cast("bigint")
    return _per_release(facts, agg, {"total_count": z, "unique_urls": z})


# ---------------------------------------------------------------- A7, A8

def distribution(facts: ReleaseFacts, column: str, buckets: Sequence[tuple]) -> DataFrame:
    """Count and share of visits per inclusive bucket of ``column`` (NULL = 0).

    Every bucket is emitted, empty ones with 0; values outside all buckets
    still count in the denominator (all visits of the release).
    """
    x = zero_if_null(column)
    conds = [(x >= lo) if hi is None else x.between(lo, hi) for lo, hi in buckets]
    agg = facts.tagged.groupBy("release_ord").agg(
        *[F.count_if(c).alias(f"_b{i}") for i, c in enumerate(conds)])
    z = F.lit(0).cast("bigint")
    base = facts.totals.join(agg, "release_ord", "left")
    rows = F.array(*[F.struct(F.lit(i + 1).alias("bucket"), F.lit(lo).alias("range_min"),
                              F.lit(hi).cast("int").alias("range_max"),
                              F.coalesce(F.col(f"_b{i}"), z).alias("count"))
                     for i, (lo, hi) in enumerate(buckets)])
    out = base.select("release_ord", "version", "total_visits", F.inline(rows))
    return out.select("release_ord", "version", "bucket", "range_min", "range_max", "count",
                      pct_of(F.col("count"), F.col("total_visits")).alias("percentage"))


def dist_page_views(facts: ReleaseFacts) -> DataFrame:
    return distribution(facts, "page_views", PAGE_VIEW_BUCKETS)


def dist_duration(facts: ReleaseFacts) -> DataFrame:
    return distribution(facts, "visit_duration", DURATION_BUCKETS)


# ---------------------------------------------------------------- A9 - A14

def _segment_value(dim: str) -> Column:
    col, _ = SEGMENT_DIMENSIONS[dim]
    if dim == "device":
        expr = None
        for k, label in DEVICE_LABELS.items():
            c = F.col(col) == k
            expr = F.when(c, F.lit(label)) if expr is None else expr.when(c, F.lit(label))
        return expr
    return nonempty_or_null(col)


def segments(facts: ReleaseFacts, dims: Sequence[str] = tuple(SEGMENT_DIMENSIONS)) -> DataFrame:
    """Visits, share, average page views / duration and single-page visits per
    segment value, for several dimensions in a single pass.

    The dimensions are melted into ``(dimension, segment_value)`` rows, so one
    shuffle on ``(release_ord, dimension, segment_value)`` with map-side
    partial aggregation serves all of them. Top-k per dimension (count desc,
    value asc) runs over the already aggregated, small table.
    """
    dims = list(dims)
    pv, dur = zero_if_null("page_views"), zero_if_null("visit_duration")
    melted = facts.tagged.select(
        "release_ord", pv.alias("_pv"), dur.alias("_dur"),
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), _segment_value(d).alias("segment_value"))
                            for d in dims])).alias("_seg"))
    melted = melted.select("release_ord", "_pv", "_dur", "_seg.dimension", "_seg.segment_value") \
                   .filter(F.col("segment_value").isNotNull())
    g = melted.groupBy("release_ord", "dimension", "segment_value").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("_pv").alias("_spv"),
        F.sum("_dur").alias("_sdur"), F.count_if(F.col("_pv") == 1).alias("single_page_visits"))
    order_key = F.when(F.col("dimension") == "device",
                       F.when(F.col("segment_value") == DEVICE_LABELS[1], 1).otherwise(2))
    w = Window.partitionBy("release_ord", "dimension").orderBy(
        order_key.asc_nulls_last(), F.col("visits").desc(), F.col("segment_value").asc())
    ranked = None
    for k in sorted({SEGMENT_DIMENSIONS[d][1] for d in dims}, key=lambda x: (x is None, x)):
        # a literal limit is applied before the shuffle as well; dimensions without one keep all their values
        part = g.filter(F.col("dimension").isin([d for d in dims if SEGMENT_DIMENSIONS[d][1] == k]))
        part = part.withColumn("rank", F.row_number().over(w))
        part = part if k is None else part.filter(F.col("rank") <= k)
        ranked = part if ranked is None else ranked.unionByName(part)
    out = ranked.join(facts.totals, "release_ord").select(
        "release_ord", "version", "dimension", "rank", "segment_value", "visits",
        pct_of(F.col("visits"), F.col("total_visits")).alias("percentage"),
        py_round(F.col("_spv") / F.col("visits"), 1).alias("avg_page_views"),
        trunc_int(F.col("_sdur") / F.col("visits")).alias("avg_duration_sec"),
        "single_page_visits")
    fallbacks = [d for d in dims if d in SEGMENT_FALLBACK]
    if fallbacks:
        present = g.select("release_ord", "dimension").distinct()
        fb = (facts.totals.filter(F.col("total_visits") > 0)
                   .select("release_ord", "version", "total_visits",
                           F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"),
                                                        F.lit(SEGMENT_FALLBACK[d]).alias("segment_value"))
                                               for d in fallbacks])).alias("_fb"))
                   .select("release_ord", "version", "_fb.dimension", "_fb.segment_value",
                           "total_visits")
                   .join(present, ["release_ord", "dimension"], "left_anti"))
        out = out.unionByName(fb.select(
            "release_ord", "version", "dimension", F.lit(1).alias("rank"), "segment_value",
            F.col("total_visits").alias("visits"), F.lit(100.0).alias("percentage"),
            F.lit(0.0).alias("avg_page_views"), F.lit(0).alias("avg_duration_sec"),
            F.lit(0).cast("bigint").alias("single_page_visits")))
    return out


def segment(facts: ReleaseFacts, dim: str) -> DataFrame:
    out = segments(facts, [dim]).drop("dimension")
    if dim == "device":
        code = None
        for k, label in DEVICE_LABELS.items():
            c = F.col("segment_value") == label
            code = F.when(c, F.lit(k)) if code is None else code.when(c, F.lit(k))
        out = out.withColumn("device_category", code)
    return out


# ---------------------------------------------------------------- A15, A16, J14

def _url_stats(facts: ReleaseFacts) -> DataFrame:
    """Per (release, url): hits, distinct clients, first non-empty title."""
    h = facts.release_hits.filter(nonempty("url"))
    first_title = F.min(F.when(nonempty("title"), F.struct(
        F.coalesce(F.col("datetime_hit"), F.expr(MIN_TS)).alias("t"),
        F.col("watch_id").alias("w"), F.col("title").alias("title"))))["title"]
    return h.groupBy("release_ord", "url").agg(
        F.count(F.lit(1)).alias("total_hits"),
        F.countDistinct(nonempty_or_null("client_id")).alias("unique_visitors"),
        first_title.alias("_title"))


def page_metrics(facts: ReleaseFacts, target_urls: Sequence[str] | None = None,
                 top_n: int = TOP_PAGES) -> DataFrame:
    """Per page: entry / exit visits, hits, distinct visitors, single-page
    entries, title and the (release-wide) subsequent-page diversity.

    Pages are the top ``top_n`` URLs by hits (count desc, URL asc) or, when
    given, exactly ``target_urls`` in their order — kept even without hits
    (left join from the bounded target list).
    """
    # one row per (release, non-empty url): its row count per release is the
    # release's number of distinct URLs, no second distinct pass needed
    stats = _url_stats(facts)
    n_urls = stats.groupBy("release_ord").agg(F.count(F.lit(1)).alias("_n_urls"))
    if target_urls:
        # the target list is a parameter: expand it per release, no join needed
        pages = facts.periods.select("release_ord", F.explode(F.array(*[
            F.struct(F.lit(i + 1).alias("rank"), F.lit(u).alias("url"))
            for i, u in enumerate(target_urls)])).alias("_t")).select("release_ord", "_t.*")
        pages = pages.join(stats, ["release_ord", "url"], "left")
    else:
        w = Window.partitionBy("release_ord").orderBy(F.col("total_hits").desc(), F.col("url").asc())
        pages = stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    pv = zero_if_null("page_views")
    # entry and exit counts in one pass: melt (start_url, end_url) into (role, url)
    ends = facts.tagged.select("release_ord", (pv == 1).alias("_single"), F.explode(F.array(
        F.struct(F.lit(True).alias("_entry"), F.col("start_url").alias("url")),
        F.struct(F.lit(False).alias("_entry"), F.col("end_url").alias("url")))).alias("_e")) \
        .select("release_ord", "_single", "_e._entry", "_e.url").filter(F.col("url").isNotNull())
    ee = ends.groupBy("release_ord", "url").agg(
        F.count_if(F.col("_entry")).alias("visits_as_entry"),
        F.count_if(F.col("_entry") & F.col("_single")).alias("visits_with_single_page"),
        F.count_if(~F.col("_entry")).alias("visits_as_exit"))
    z = F.lit(0).cast("bigint")
    out = (pages.join(ee, ["release_ord", "url"], "left")
                .join(n_urls, "release_ord", "left")
                .join(facts.periods.select("release_ord", "version"), "release_ord"))
    present = F.when(F.col("total_hits").isNotNull(), 1).otherwise(0)
    diversity = F.least(F.lit(PAGE_DIVERSITY_CAP).cast("bigint"),
                        F.coalesce(F.col("_n_urls"), z) - present)
    title = F.coalesce(F.col("_title"), url_leaf("url"))
    return out.select(
        "release_ord", "version", "rank", "url",
        F.substring(title, 1, TITLE_MAX_CHARS).alias("title"),
        F.coalesce("visits_as_entry", z).alias("visits_as_entry"),
        F.coalesce("visits_as_exit", z).alias("visits_as_exit"),
        F.coalesce("total_hits", z).alias("total_hits"),
        F.coalesce("unique_visitors", z).alias("unique_visitors"),
        F.coalesce("visits_with_single_page", z).alias("visits_with_single_page"),
        F.greatest(diversity, z).alias("subsequent_page_diversity"))


# ---------------------------------------------------------------- A17

def funnel_entry_exit(facts: ReleaseFacts, target_urls: Sequence[str] | None = None,
                      default_steps: int = FUNNEL_DEFAULT_STEPS) -> DataFrame:
    """Independent entry / exit steps.

    Steps are the first 5 targets when at least two are given, else the
    release's top-3 start URLs (count desc, URL asc). A visit *entered* a step
    when it started on the URL or its exit URL contains it; *completed* when it
    exited on it, and for the last step completed = entered. The step table
    holds at most 5 rows per release, so it is broadcast to the visits.
    """
    if target_urls and len(target_urls) >= 2:
        urls = list(target_urls)[:FUNNEL_MAX_TARGETS]
        steps = facts.periods.select("release_ord", F.explode(F.array(*[
            F.struct(F.lit(i + 1).alias("step"), F.lit(u).alias("url"),
                     F.lit(i + 1 == len(urls)).alias("is_last"))
            for i, u in enumerate(urls)])).alias("_s")).select("release_ord", "_s.*")
    else:
        starts = facts.tagged.filter(nonempty("start_url")).groupBy("release_ord", "start_url") \
            .agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("release_ord").orderBy(F.col("_n").desc(), F.col("start_url").asc())
        ranked = starts.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= default_steps)
        n_steps = Window.partitionBy("release_ord")
        steps = ranked.select("release_ord", "step", F.col("start_url").alias("url"),
                              (F.col("step") == F.max("step").over(n_steps)).alias("is_last"))
    v = facts.tagged.select("release_ord", "start_url", "end_url")
    j = v.join(F.broadcast(steps), "release_ord")
    entered = (F.col("start_url") == F.col("url")) | \
        F.coalesce(F.col("end_url"), F.lit("")).contains(F.col("url"))
    agg = j.groupBy("release_ord", "step", "url", "is_last").agg(
        F.count_if(entered).alias("visits_entered"),
        F.count_if(F.col("end_url") == F.col("url")).alias("visits_completed"))
    # steps with no visit at all still appear (all visits of the release may be elsewhere)
    out = steps.join(agg.drop("is_last"), ["release_ord", "step", "url"], "left") \
               .join(facts.periods.select("release_ord", "version"), "release_ord")
    z = F.lit(0).cast("bigint")
    ent = F.coalesce("visits_entered", z)
    return out.select("release_ord", "version", "step", "url", ent.alias("visits_entered"),
                      F.when(F.col("is_last"), ent)
                       .otherwise(F.coalesce("visits_completed", z)).alias("visits_completed"))


# ---------------------------------------------------------------- A18

def high_interaction(facts: ReleaseFacts, min_pages: int = HIGH_INTERACTION_PAGES) -> DataFrame:
    """Sessions with at least ``min_pages`` page views: count, share, averages
    and the unique-URL estimate ``round(min(avg_pages * 0.8, 20), 1)``."""
    pv, dur = zero_if_null("page_views"), zero_if_null("visit_duration")
    hi = pv >= min_pages
    agg = facts.tagged.groupBy("release_ord").agg(
        F.count_if(hi).alias("sessions_high_interaction"),
        F.sum(F.when(hi, pv)).alias("_spv"), F.sum(F.when(hi, dur)).alias("_sdur"))
    base = facts.totals.join(agg, "release_ord", "left")
    n = F.coalesce(F.col("sessions_high_interaction"), F.lit(0).cast("bigint"))
    avg_pages = F.when(n > 0, py_round(F.col("_spv") / n, 1)).otherwise(F.lit(0.0))
    return base.select(
        "release_ord", "version", n.alias("sessions_high_interaction"),
        pct_of(n, F.col("total_visits")).alias("percentage"),
        avg_pages.alias("avg_pages"),
        F.when(n > 0, trunc_int(F.col("_sdur") / n)).otherwise(F.lit(0)).alias("avg_duration_sec"),
        F.when(n > 0, py_round(F.least(avg_pages * UNIQUE_URL_ESTIMATE_FACTOR,
                                       F.lit(float(UNIQUE_URL_ESTIMATE_CAP))), 1))
         .otherwise(F.lit(0.0)).alias("avg_unique_urls"))
