"""Bounce rates per key page (A35), regex funnel conversion (A36) and the
trailing 28-day bounce baseline extension (E2).

Patterns are parameters (a handful of regexes), so each one becomes a column
expression of a single aggregate — one scan, map-side partial aggregation and
no join against a pattern table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navlens.operators.linkage import explode_visits

BASELINE_DAYS = 28


def _matches(col: str, pattern: str) -> Column:
    """Regex search (``re.search`` / Java ``find``); NULL text never matches."""
    return F.coalesce(F.col(col).rlike(pattern), F.lit(False))


def page_bounce_rates(visits: DataFrame, key_pages: Sequence[str], weight: str = "visit") -> DataFrame:
    """Per pattern: sessions whose entry URL matches and the share with one page view.

    ``weight='visit'`` counts each session once (the documented intent);
    ``weight='hit'`` evaluates over visits exploded by listed hit id, as the
    notebook did, so long sessions weigh more. No match -> NULL rate.
    """
    src = explode_visits(visits) if weight == "hit" else visits
    bounce = F.coalesce(F.col("page_views") == 1, F.lit(False))
    aggs = []
    for i, p in enumerate(key_pages):
        m = _matches("start_url", p)
        aggs += [F.count_if(m).alias(f"_n{i}"), F.count_if(m & bounce).alias(f"_b{i}")]
    a = src.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("page"), F.col(f"_n{i}").alias("sessions"),
                              F.col(f"_b{i}").alias("_bounces"))
                     for i, p in enumerate(key_pages)])
    out = a.select(F.inline(rows))
    return out.select("page", "sessions",
                      F.when(F.col("sessions") > 0, F.col("_bounces") / F.col("sessions")).alias("bounce_rate"))


def funnel_regex(joined: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Sequential regex funnel.

    Per session ``first_reached`` is the lowest step whose pattern matches any
    of its URLs (NULL URL = no match). Per step ``i``: sessions first reaching
    it, sessions reaching it or a later one, and that count over all sessions.
    One shuffle on ``visit_id`` (partial ``min``), then one global aggregate.
    """
    first = None
    for i, p in enumerate(steps):
        c = _matches("url", p)
        first = F.when(c, F.lit(i)) if first is None else first.when(c, F.lit(i))
    per_visit = joined.filter(F.col("visit_id").isNotNull()) \
        .groupBy("visit_id").agg(F.min(first).alias("first_reached"))
    fr = F.col("first_reached")
    a = per_visit.agg(F.count(F.lit(1)).alias("_total"),
                      *[F.count_if(fr == i).alias(f"_r{i}") for i in range(len(steps))],
                      *[F.count_if(fr >= i).alias(f"_c{i}") for i in range(len(steps))])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(p).alias("pattern"),
                              F.col(f"_r{i}").alias("reached"),
                              F.col(f"_c{i}").alias("cumulative_reached"))
                     for i, p in enumerate(steps)])
    return a.select("_total", F.inline(rows)).select(
        "step", "pattern", "reached", "cumulative_reached",
        F.when(F.col("_total") > 0, F.col("cumulative_reached") / F.col("_total")).alias("percent"))


def bounce_baseline(visits: DataFrame, days: int = BASELINE_DAYS) -> DataFrame:
    """Extension E2: daily bounce rate per entry page against its trailing baseline.

    ``baseline_rate`` = bounces / sessions over the ``days`` days before the
    day (days without sessions simply contribute nothing). Windows run over
    the daily aggregate partitioned by page, never over raw visits.
    """
    day = F.datediff(F.to_date("date_time"), F.lit("1970-01-01").cast("date"))
    daily = (visits.filter(F.col("start_url").isNotNull() & (F.col("start_url") != ""))
                   .groupBy("start_url", day.alias("day_num"))
                   .agg(F.count(F.lit(1)).alias("sessions"),
                        F.count_if(F.coalesce(F.col("page_views") == 1, F.lit(False))).alias("bounces")))
    w = Window.partitionBy("start_url").orderBy("day_num").rangeBetween(-days, -1)
    out = daily.select(
        "start_url", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_num")).alias("day"),
        "sessions", "bounces", (F.col("bounces") / F.col("sessions")).alias("bounce_rate"),
        F.sum("sessions").over(w).alias("_bs"), F.sum("bounces").over(w).alias("_bb"))
    return out.select("start_url", "day", "sessions", "bounces", "bounce_rate",
                      (F.col("_bb") / F.col("_bs")).alias("baseline_rate"),
                      (F.col("bounce_rate") - F.col("_bb") / F.col("_bs")).alias("delta"))
