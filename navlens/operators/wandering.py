"""Offline path analysis over the visit-hit fact table: wandering sessions and
backtracks (A23 - A34), as grouped aggregates and skew-safe sequences.

The fact table (``joined``) is one row per (visit, listed id) matched to its
hit: see :func:`navlens.operators.linkage.joined_table`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navlens.operators.quantiles import quantile_row
from navlens.operators.sequence import with_neighbors

WANDERING_THRESHOLD = 8
# Report parameters of the path analysis.
WANDERING_RATE_FLAG = 0.1           # share of wandering sessions considered high
PAGES_PER_HIT_FLAG = 0.5            # mean unique pages / mean hits below = repeats
WANDERING_QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.95]
BACKTRACK_QUANTILES = [0.5, 0.75, 0.9, 0.95, 0.99]
BACKTRACK_LEVEL_HIGH = 2.0
BACKTRACK_LEVEL_MODERATE = 0.5
BACKTRACK_PROBLEM_MIN = 5           # sessions with more backtracks than this
# right-closed bins (lo, hi]; None = infinity. The first lower bound of the
# wandering segments is the threshold itself, so hits == threshold fall out.
WANDERING_SEGMENT_UPPER = [15, 25, 50, None]
WANDERING_LEVELS = [("0-8", 0, 8), ("9-15", 8, 15), ("16+", 15, None)]
BACKTRACK_SEGMENTS = [("0", -1, 0), ("1-2", 0, 2), ("3-5", 2, 5), ("6+", 5, None)]
HIST_UNIQUE_PAGES_BINS = 15
HIST_BACKTRACK_BINS = 20


def _qname(q: float) -> str:
    return "p" + ("%g" % (q * 100)).replace(".", "_")


# ---------------------------------------------------------------- A23, A24, T3

def session_stats(joined: DataFrame, keys: Sequence[str] = ("visit_id",)) -> DataFrame:
    """Per session: distinct URLs, hits (non-NULL ids) and first visit time."""
    return joined.filter(F.col("visit_id").isNotNull()).groupBy(*keys).agg(
        F.countDistinct("url").alias("unique_pages"),
        F.count("watch_id").alias("hits"),
        F.min("date_time").alias("date_time_visit"))


def wandering_sessions(joined: DataFrame, threshold: int = WANDERING_THRESHOLD,
                       sort: bool = True) -> DataFrame:
    """Sessions with at least ``threshold`` hits, most hits first."""
    out = session_stats(joined).filter(F.col("hits") >= threshold)
    return out.orderBy(F.col("hits").desc(), F.col("visit_id")) if sort else out


def wandering_excl_funnel(joined: DataFrame, funnel_patterns: Sequence[str],
                          threshold: int = WANDERING_THRESHOLD) -> DataFrame:
    """Wandering sessions that never hit any funnel URL pattern (regex, OR-ed)."""
    pattern = "|".join(funnel_patterns)
    reached = joined.filter(F.coalesce(F.col("url").rlike(pattern), F.lit(False))) \
        .select("visit_id").distinct()
    return wandering_sessions(joined, threshold, sort=False) \
        .join(reached, "visit_id", "left_anti") \
        .orderBy(F.col("hits").desc(), F.col("visit_id"))


def top_wandering(joined: DataFrame, n: int = 5, threshold: int = WANDERING_THRESHOLD) -> DataFrame:
    """The ``n`` wandering sessions with most hits (ties by visit id)."""
    return wandering_sessions(joined, threshold).limit(n)


# ---------------------------------------------------------------- A25 - A28

def wandering_summary(joined: DataFrame, threshold: int = WANDERING_THRESHOLD) -> DataFrame:
    """Totals, share, means, max and the two report flags, in one row."""
    s = session_stats(joined)
    w = F.col("hits") >= threshold
    agg = s.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(w).alias("wandering_sessions"),
        F.avg(F.when(w, F.col("hits"))).alias("mean_hits"),
        F.avg(F.when(w, F.col("unique_pages"))).alias("mean_unique_pages"),
        F.max(F.when(w, F.col("hits"))).alias("max_hits"))
    rate = F.col("wandering_sessions") / F.col("total_sessions")
    return agg.select(
        "total_sessions", "wandering_sessions",
        F.when(F.col("total_sessions") > 0, rate * 100).alias("wandering_pct"),
        "mean_hits", "mean_unique_pages", "max_hits",
        F.coalesce(rate > WANDERING_RATE_FLAG, F.lit(False)).alias("high_wandering_rate"),
        F.coalesce(F.col("mean_unique_pages") / F.col("mean_hits") < PAGES_PER_HIT_FLAG,
                   F.lit(False)).alias("repeat_visits_flag"))


def _quantiles(rows: DataFrame, col: str, qs: Sequence[float], approx: bool = False) -> DataFrame:
    """One row of linear-interpolated quantiles, exact by rank bracketing, or with ``approx`` the mergeable sketch of
    ``percentile_approx`` (nearest rank)."""
    if approx:
        return rows.agg(*[F.percentile_approx(F.col(col), q).cast("double").alias(_qname(q)) for q in qs])
    one = rows.sparkSession.range(1).select(quantile_row(rows, {col: qs}).alias("q"))
    return one.select(*[F.col(f"q.{col}_{i}").alias(_qname(q)) for i, q in enumerate(qs)])


def wandering_quantiles(joined: DataFrame, threshold: int = WANDERING_THRESHOLD,
                        approx: bool = False) -> DataFrame:
    """Quantiles of hits over wandering sessions (one row); exact by default."""
    return _quantiles(wandering_sessions(joined, threshold, sort=False), "hits", WANDERING_QUANTILES, approx)


def _bins(value: Column, bins: Sequence[tuple]) -> Column:
    """Label of the right-closed bin ``(lo, hi]`` containing ``value`` (NULL if none)."""
    expr = None
    for label, lo, hi in bins:
        c = (value > lo) if hi is None else ((value > lo) & (value <= hi))
        expr = F.when(c, F.lit(label)) if expr is None else expr.when(c, F.lit(label))
    return expr


def _binned_counts(df: DataFrame, value: str, bins: Sequence[tuple], denominator: str | None) -> DataFrame:
    """Count per bin, every bin emitted; optional share of the chosen total."""
    lab = _bins(F.col(value), bins)
    agg = df.agg(F.count(F.lit(1)).alias("_total"),
                 *[F.count_if(lab == F.lit(b[0])).alias(f"_c{i}") for i, b in enumerate(bins)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("bin"), F.lit(b[0]).alias("segment"),
                              F.lit(b[1]).cast("double").alias("lower"),
                              F.lit(b[2]).cast("double").alias("upper"),
                              F.col(f"_c{i}").alias("sessions"))
                     for i, b in enumerate(bins)])
    out = agg.select("_total", F.inline(rows))
    cols = ["bin", "segment", "lower", "upper", "sessions"]
    if denominator:
        out = out.withColumn("percentage", F.when(F.col("_total") > 0,
                                                  F.col("sessions") / F.col("_total") * 100))
        cols.append("percentage")
    return out.select(*cols)


def wandering_segments(joined: DataFrame, threshold: int = WANDERING_THRESHOLD) -> DataFrame:
    """Activity segments (threshold,15], (15,25], (25,50], (50,inf) of wandering
    sessions, with share of all wandering sessions."""
    edges = [threshold] + WANDERING_SEGMENT_UPPER
    bins = [(f"({edges[i]},{'inf' if edges[i + 1] is None else edges[i + 1]}]", edges[i], edges[i + 1])
            for i in range(len(edges) - 1)]
    return _binned_counts(wandering_sessions(joined, threshold, sort=False), "hits", bins, "wandering")


def wandering_levels(joined: DataFrame, threshold: int = WANDERING_THRESHOLD) -> DataFrame:
    """Chart data: wandering sessions per level (0,thr], (thr,15], (15,inf)."""
    (l0, _, _), (l1, _, mid), (l2, _, _) = WANDERING_LEVELS
    bins = [(l0, 0, threshold), (l1, threshold, mid), (l2, mid, None)]
    return _binned_counts(wandering_sessions(joined, threshold, sort=False), "hits", bins, None)


# ---------------------------------------------------------------- A29 - A34

def backtracks(joined: DataFrame, keys: Sequence[str] = ("visit_id",)) -> DataFrame:
    """Per session: how many hits return to the URL two steps back.

    Rows are ordered by hit time (NULL last) then id; NULL URL counts as
    ``''``. Position ``i`` counts when ``u[i] = u[i-2]`` (the middle may be
    equal too). Sessions without any backtrack appear with 0.
    """
    keys = list(keys)
    rows = joined.filter(F.col("visit_id").isNotNull()).select(
        *keys, "watch_id", "datetime_hit", F.coalesce(F.col("url"), F.lit("")).alias("u"))
    order = [F.col("datetime_hit").asc_nulls_last(), F.col("watch_id").asc()]
    seq = with_neighbors(rows, keys, order, None, "u", lags=(2,))
    return seq.groupBy(*keys).agg(
        F.count_if(F.col("prev2") == F.col("u")).alias("backtracks"))


def backtrack_summary(joined: DataFrame) -> DataFrame:
    """Sessions, share with backtracks, mean / median / max, outlier flag
    (max above the 90th percentile), level and sessions above 5 (one row)."""
    b = backtracks(joined)
    agg = b.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(F.col("backtracks") > 0).alias("sessions_with_backtracks"),
        F.avg("backtracks").alias("mean_backtracks"),
        F.max("backtracks").alias("max_backtracks"),
        F.count_if(F.col("backtracks") > BACKTRACK_PROBLEM_MIN).alias("problematic_sessions"))
    agg = agg.withColumn("_q", quantile_row(b, {"backtracks": [0.5, 0.9]})).select(
        "*", F.col("_q.backtracks_0").alias("median_backtracks"), F.col("_q.backtracks_1").alias("p90"))
    mean = F.col("mean_backtracks")
    return agg.select(
        "total_sessions", "sessions_with_backtracks",
        (F.col("total_sessions") - F.col("sessions_with_backtracks")).alias("sessions_without_backtracks"),
        F.when(F.col("total_sessions") > 0,
               F.col("sessions_with_backtracks") / F.col("total_sessions") * 100).alias("pct_with_backtracks"),
        "mean_backtracks", "median_backtracks", "max_backtracks",
        F.coalesce(F.col("max_backtracks") > F.col("p90"), F.lit(False)).alias("has_outliers"),
        F.when(mean > BACKTRACK_LEVEL_HIGH, "high").when(mean > BACKTRACK_LEVEL_MODERATE, "moderate")
         .otherwise("low").alias("level"),
        "problematic_sessions")


def backtrack_quantiles(joined: DataFrame, approx: bool = False) -> DataFrame:
    return _quantiles(backtracks(joined), "backtracks", BACKTRACK_QUANTILES, approx)


def backtrack_segments(joined: DataFrame) -> DataFrame:
    """Sessions per bin (-1,0], (0,2], (2,5], (5,inf) with share of all sessions."""
    return _binned_counts(backtracks(joined), "backtracks", BACKTRACK_SEGMENTS, "all")


def equal_width_histogram(df: DataFrame, value: str, n_bins: int) -> DataFrame:
    """``n_bins`` equal-width bins over ``[min, max]``, last bin closed.

    ``bin = least(floor((x - lo) * n / (hi - lo)), n - 1)``; when ``min = max``
    the range is widened by 0.5 each side (all values land in bin ``n // 2``).
    Every bin is emitted. The data is first reduced to one row per distinct
    value (partial aggregation); its range is a one-row aggregate used as a
    scalar subquery, and the bins are a second partial aggregate, folded into
    one row of ``n_bins`` counts and unpivoted with ``inline``.
    """
    g = df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("_n")) \
          .filter(F.col("x").isNotNull())
    lo0, hi0 = g.agg(F.min("x")).scalar(), g.agg(F.max("x")).scalar()
    g = g.withColumn("_lo0", lo0).withColumn("_hi0", hi0)
    same = F.col("_lo0") == F.col("_hi0")
    g = g.withColumn("_lo", F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0"))) \
         .withColumn("_hi", F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")))
    idx = F.least(F.floor((F.col("x") - F.col("_lo")) * n_bins / (F.col("_hi") - F.col("_lo"))),
                  F.lit(n_bins - 1).cast("bigint"))
    g = g.withColumn("_bin", idx)
    a = g.agg(F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"),
              *[F.sum(F.when(F.col("_bin") == i, F.col("_n"))).alias(f"_c{i}") for i in range(n_bins)])
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("bin"),
                              (F.col("_lo") + i * width).alias("lower"),
                              (F.col("_lo") + (i + 1) * width).alias("upper"),
                              F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("bigint").alias("count"))
                     for i in range(n_bins)])
    return a.filter(F.col("_lo").isNotNull()).select(F.inline(rows))


def hist_unique_pages(joined: DataFrame, threshold: int = WANDERING_THRESHOLD) -> DataFrame:
    return equal_width_histogram(wandering_sessions(joined, threshold, sort=False),
                                 "unique_pages", HIST_UNIQUE_PAGES_BINS)


def hist_backtracks(joined: DataFrame) -> DataFrame:
    return equal_width_histogram(backtracks(joined), "backtracks", HIST_BACKTRACK_BINS)


# ---------------------------------------------------------------- C10: the reports as tables

def _as_rows(df: DataFrame, metrics: Sequence[str], prefix: str = "") -> DataFrame:
    """Unpivot one-row figures into ``(metric, value)`` rows (values as double)."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(prefix + m).alias("metric"),
                                                 F.col(m).cast("double").alias("value")) for m in metrics])))


def _bin_rows(bins: DataFrame, with_pct: bool) -> DataFrame:
    cols = [F.struct(F.concat(F.lit("segment "), F.col("segment"), F.lit(" sessions")).alias("metric"),
                     F.col("sessions").cast("double").alias("value"))]
    if with_pct:
        cols.append(F.struct(F.concat(F.lit("segment "), F.col("segment"), F.lit(" pct")).alias("metric"),
                             F.col("percentage").cast("double").alias("value")))
    return bins.select(F.inline(F.array(*cols)))


def wandering_report(joined: DataFrame, threshold: int = WANDERING_THRESHOLD) -> DataFrame:
    """Every figure of the wandering text report as ``(metric, value)`` rows:
    totals, share, threshold, means, max, the two flags (1/0), the hit
    quantiles and the activity segments with their shares."""
    summ = wandering_summary(joined, threshold).withColumn("threshold", F.lit(threshold))
    return (_as_rows(summ, ["total_sessions", "wandering_sessions", "wandering_pct", "threshold", "mean_hits",
                            "mean_unique_pages", "max_hits", "high_wandering_rate", "repeat_visits_flag"])
            .unionByName(_as_rows(wandering_quantiles(joined, threshold),
                                  [_qname(q) for q in WANDERING_QUANTILES], "hits "))
            .unionByName(_bin_rows(wandering_segments(joined, threshold), True)))


def backtrack_report(joined: DataFrame) -> DataFrame:
    """Every figure of the backtrack text report as ``(metric, value)`` rows:
    totals, shares, mean / median / max, outlier flag, level (one-hot),
    sessions above 5, quantiles and segments."""
    summ = backtrack_summary(joined)
    for lvl in ("high", "moderate", "low"):
        summ = summ.withColumn(f"level_{lvl}", F.col("level") == lvl)
    return (_as_rows(summ, ["total_sessions", "sessions_with_backtracks", "sessions_without_backtracks",
                            "pct_with_backtracks", "mean_backtracks", "median_backtracks", "max_backtracks",
                            "has_outliers", "level_high", "level_moderate", "level_low", "problematic_sessions"])
            .unionByName(_as_rows(backtrack_quantiles(joined), [_qname(q) for q in BACKTRACK_QUANTILES],
                                  "backtracks "))
            .unionByName(_bin_rows(backtrack_segments(joined), True)))
