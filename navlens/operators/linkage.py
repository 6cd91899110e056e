"""Visit <-> hit linkage: the id bridge, semi / outer joins, nesting, diagnostics.

A visit stores the ids of its hits as text. :func:`watch_id_bridge` turns it
into a bridge table ``(visit_id, pos, watch_id)`` with ``posexplode``; every
join between the two tables goes through it as an equi-join on ``watch_id``,
which Spark runs as a shuffle (sort-merge) or broadcast hash join chosen from
sizes at run time (AQE). No id list is ever collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navlens.functions.ids import normalize_id, parse_id_list, split_id_list

VISIT_COLS = ["visit_id", "watch_ids", "date_time", "is_new_user", "start_url", "end_url",
              "page_views", "visit_duration", "region_city", "client_id",
              "last_search_engine_root", "device_category", "operating_system", "browser",
              "screen_orientation_name", "mobile_phone", "mobile_phone_model", "screen_format"]
HIT_COLS = ["watch_id", "client_id", "url", "datetime_hit", "title"]


def watch_id_bridge(visits: DataFrame, bracketed: bool = False,
                    keep: Sequence[str] = (), outer: bool = False) -> DataFrame:
    """``(visit_id, pos, watch_id, *keep)``: one row per listed id, ``pos`` from 1.

    ``bracketed=True`` accepts the ``[..]`` / quoted encodings as well.
    Duplicates inside a list are kept (each occurrence is a row). Ids are in
    their canonical text. ``outer`` keeps visits without ids, with NULL for
    ``pos`` and ``watch_id``.
    """
    ids = parse_id_list("watch_ids") if bracketed else split_id_list("watch_ids")
    explode = F.posexplode_outer if outer else F.posexplode
    return (visits.select("visit_id", *keep, explode(F.transform(ids, normalize_id)).alias("pos0", "watch_id"))
                  .select("visit_id", (F.col("pos0") + 1).cast("bigint").alias("pos"), "watch_id", *keep))


def explode_visits(visits: DataFrame, bracketed: bool = True, outer: bool = False) -> DataFrame:
    """Visits exploded to one row per listed id (``watch_id``, ``pos``), all columns kept."""
    others = [c for c in visits.columns if c not in ("visit_id", "watch_ids")]
    return watch_id_bridge(visits, bracketed=bracketed, keep=others, outer=outer)


def with_canonical_ids(rows: DataFrame) -> DataFrame:
    """``watch_id`` in its canonical text, so that every encoding of an id joins."""
    return rows.withColumn("watch_id", normalize_id("watch_id"))


def hits_matching_visits(hits: DataFrame, bridge: DataFrame) -> DataFrame:
    """Hits whose id is listed by some visit; one row per hit (left semi)."""
    return with_canonical_ids(hits).join(with_canonical_ids(bridge.select("watch_id")), "watch_id", "left_semi")


def visits_filtered_by_hits(exploded: DataFrame, hits: DataFrame) -> DataFrame:
    """Exploded visit rows whose id exists in hits (left semi)."""
    return with_canonical_ids(exploded).join(with_canonical_ids(hits.select("watch_id")), "watch_id", "left_semi")


def join_visits_hits(exploded: DataFrame, hits: DataFrame, how: str = "right",
                     on: Sequence[str] = ("watch_id",)) -> DataFrame:
    """Equi-join exploded visits with hits; clashing columns get ``_visit`` / ``_hit``.

    ``how='left'`` on ``watch_id`` is the 2024 notebook form, ``how='left'``
    on ``(watch_id, client_id)`` the 2022 form, ``how='right'`` the library
    form used by the path reports.
    """
    on = list(on)
    exploded, hits = with_canonical_ids(exploded), with_canonical_ids(hits)
    clash = (set(exploded.columns) & set(hits.columns)) - set(on)
    v = exploded.select(*[F.col(c).alias(f"{c}_visit") if c in clash else F.col(c)
                          for c in exploded.columns])
    h = hits.select(*[F.col(c).alias(f"{c}_hit") if c in clash else F.col(c)
                      for c in hits.columns])
    return v.join(h, on, how)


def explode_with_bridge(visits: DataFrame, bridge: DataFrame) -> DataFrame:
    """Same rows as :func:`explode_visits`, from a stored ``(visit_id, pos, watch_id)``
    bridge instead of parsing each visit's id text."""
    others = [c for c in visits.columns if c not in ("visit_id", "watch_ids")]
    return bridge.select("visit_id", "pos", "watch_id").join(visits.select("visit_id", *others), "visit_id")


def joined_table(visits: DataFrame, hits: DataFrame, bridge: DataFrame | None = None) -> DataFrame:
    """The visit-hit fact table of the path reports.

    The reference chain is explode -> hits semi visits -> visits semi hits ->
    right join on ``watch_id``. After both semi reductions every hit row has a
    visit partner, so the right join equals one inner join of the exploded
    visits with hits; that single join is what we plan (two fewer shuffles).
    With a stored id ``bridge`` the id text is not parsed at all.
    """
    ex = explode_visits(visits) if bridge is None else explode_with_bridge(visits, bridge)
    return join_visits_hits(ex, hits, how="inner")


def visit_hit_rows(bridge: DataFrame, hits: DataFrame) -> DataFrame:
    """Bridge rows resolved to their hit (inner; list order ``pos`` and duplicates kept)."""
    return with_canonical_ids(bridge).join(
        with_canonical_ids(hits).select("watch_id", "url", "datetime_hit", "title",
                                        F.col("client_id").alias("hit_client_id")), "watch_id", "inner")


def visits_with_hits(visits: DataFrame, hits: DataFrame) -> DataFrame:
    """Nest join: each visit with the array of its hits in list order.

    Visits without (matching) ids keep an empty array; an id that a list
    repeats gives its hit once, at its first place. One join plus one
    grouped ``collect_list`` instead of one hits query per visit. The array of
    one visit holds at most the ids listed in that visit's own ``watch_ids``
    text, i.e. it is bounded by the size of one input row, not by the data.
    """
    bridge = watch_id_bridge(visits).groupBy("visit_id", "watch_id").agg(F.min("pos").alias("pos"))
    rows = visit_hit_rows(bridge, hits)
    nested = rows.groupBy("visit_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "watch_id", "url", "datetime_hit",
                                             "title"))).alias("hits"))
    return (visits.join(nested, "visit_id", "left")
                  .withColumn("hits", F.coalesce("hits", F.array().cast(nested.schema["hits"].dataType))))


def join_diagnostics(exploded: DataFrame, hits: DataFrame) -> DataFrame:
    """One row of key-set and join diagnostics.

    Rows after explode, distinct ids each side, common / only-visits /
    only-hits ids, rows the right join would produce and how many carry a URL.
    Both sides are first reduced to one row per id (partial aggregation), then
    one full outer join on ``watch_id`` and a single global aggregate give all
    figures — the right join itself is never materialised.
    """
    v = with_canonical_ids(exploded).groupBy("watch_id").agg(F.count(F.lit(1)).alias("n_v"))
    h = with_canonical_ids(hits).groupBy("watch_id").agg(F.count(F.lit(1)).alias("n_h"), F.count("url").alias("n_url"))
    k = v.join(h, "watch_id", "full_outer")
    fan = F.coalesce(F.col("n_v"), F.lit(1))  # right join: unmatched hit rows survive once
    out = k.agg(
        F.coalesce(F.sum("n_v"), F.lit(0)).alias("exploded_rows"),
        F.count("n_v").alias("distinct_visit_ids"),
        F.count("n_h").alias("distinct_hit_ids"),
        F.count_if(F.col("n_v").isNotNull() & F.col("n_h").isNotNull()).alias("common_ids"),
        F.count_if(F.col("n_h").isNull()).alias("only_visit_ids"),
        F.count_if(F.col("n_v").isNull()).alias("only_hit_ids"),
        F.coalesce(F.sum(F.col("n_h") * fan), F.lit(0)).alias("merged_rows"),
        F.coalesce(F.sum(F.col("n_url") * fan), F.lit(0)).alias("rows_with_url"))
    return out.withColumn(
        "pct_url_filled",
        F.when(F.col("merged_rows") > 0, F.col("rows_with_url") / F.col("merged_rows") * 100))


def filter_diagnostics(exploded: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows before / after the semi filter of visits by hits, removed, % removed."""
    keys = with_canonical_ids(hits.select("watch_id")).distinct().withColumn("_hit", F.lit(True))
    out = with_canonical_ids(exploded).join(keys, "watch_id", "left").agg(
        F.count(F.lit(1)).alias("rows_before"), F.count("_hit").alias("rows_after"))
    return out.select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.when(F.col("rows_before") > 0,
               (F.col("rows_before") - F.col("rows_after")) / F.col("rows_before") * 100)
         .alias("pct_removed"))


def ids_common(exploded: DataFrame, hits: DataFrame) -> DataFrame:
    """Ids on both sides, each once, NULL among them: one shuffle of partial aggregates, nothing is sorted."""
    v = with_canonical_ids(exploded.select("watch_id")).withColumn("_visit", F.lit(True))
    h = with_canonical_ids(hits.select("watch_id")).withColumn("_visit", F.lit(False))
    sides = v.unionByName(h).groupBy("watch_id").agg(F.bool_or("_visit").alias("_v"), F.bool_and("_visit").alias("_only_v"))
    return sides.where("_v and not _only_v").select("watch_id")


def ids_only_visits(exploded: DataFrame, hits: DataFrame) -> DataFrame:
    return with_canonical_ids(exploded.select("watch_id")).subtract(with_canonical_ids(hits.select("watch_id")))


def ids_only_hits(exploded: DataFrame, hits: DataFrame) -> DataFrame:
    return with_canonical_ids(hits.select("watch_id")).subtract(with_canonical_ids(exploded.select("watch_id")))


def ids_distinct(exploded: DataFrame) -> DataFrame:
    return with_canonical_ids(exploded.select("watch_id")).distinct()

