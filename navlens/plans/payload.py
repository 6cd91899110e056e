"""The release-metrics document (C1): one nested row per release, the empty
release (C2), list placeholders (C3), the envelope around two releases (S7), and
the way back: a document as (path, value) rows.

Every list inside the document is a top-k or fixed-size table (at most 20
rows per release), collected per release with ``collect_list`` over already
aggregated rows; the document is assembled by joins on ``release_ord`` and
serialised with ``to_json`` (the JSON sink is ``df.write.json``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navlens.operators import paths as PA
from navlens.operators import release as R


def _list(df: DataFrame, order: str, fields: Sequence[str], name: str) -> DataFrame:
    """Per release: ``array<struct>`` of ``fields`` in ``order`` (bounded tables only)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(f) for f in fields])))
    return df.groupBy("release_ord").agg(F.transform(items, lambda s: s.dropFields("_o")).alias(name))


SEGMENT_FIELDS = ["segment_value", "visits", "percentage", "avg_page_views", "avg_duration_sec",
                  "single_page_visits"]


def _segment(value: str, visits: Column, pct: float, **more: Column) -> dict[str, Column]:
    return more | {"segment_value": F.lit(value), "visits": visits, "percentage": F.lit(pct), "avg_page_views": F.lit(0),
                   "avg_duration_sec": F.lit(0), "single_page_visits": F.lit(0)}


def _page(count: Column, hits: Column, visitors: Column, single: Column) -> dict[str, Column]:
    return {"url": F.lit("/"), "title": F.lit("Home"), "visits_as_entry": count, "visits_as_exit": count,
            "total_hits": hits, "unique_visitors": visitors, "visits_with_single_page": single,
            "subsequent_page_diversity": F.lit(0)}


def _placeholders() -> dict[str, tuple[dict[str, Column], dict[str, Column]]]:
    """List -> its one element (in a release with visits but without rows for it, in a release without visits)."""
    zero, total = F.lit(0), F.col("total_visits")
    unknown = _segment("Unknown", zero, 0.0)
    desktop = _segment("Desktop", zero, 0.0, device_category=F.lit(1))
    loop = {"sequence": F.array(F.lit("/")), "occurrences": zero}

    def bucket(low: int, high: int) -> dict[str, Column]:
        return {"range_min": F.lit(low), "range_max": F.lit(high), "count": zero, "percentage": F.lit(0.0)}

    def step(to: str) -> dict[str, Column]:
        return {"from_url": F.lit("/"), "to_url": F.lit(to), "transition_count": zero}

    def funnel(n: Column) -> dict[str, Column]:
        return {"step": F.lit(1), "url": F.lit("/"), "visits_entered": n, "visits_completed": n}

    return {
        "by_page_views": (bucket(1, 1), bucket(1, 1)), "by_duration_sec": (bucket(0, 30), bucket(0, 30)),
        "by_category": (desktop, desktop),
        **{c: (unknown, unknown) for c in ("by_os", "by_browser", "by_screen_orientation")},
        "by_search_engine": (_segment("direct", total, 100.0), unknown),
        "top_cities": (_segment("Unknown", total, 100.0), unknown),
        "page_metrics": (_page(total, F.col("total_hits"), F.col("n_client_values"), F.col("n_single_page")),
                         _page(zero, zero, zero, zero)),
        "common_transitions": (step("/page"), step("/")), "loop_patterns": (loop, loop),
        "application_funnel": (funnel(total), funnel(zero))}


def _visit_counts(facts: R.ReleaseFacts) -> DataFrame:
    """What the page placeholder states of a release: distinct client ids (a missing one is a value) and one-page visits."""
    client = F.struct("client_id")
    return facts.tagged.groupBy("release_ord").agg(
        F.countDistinct(client).alias("n_client_values"),
        F.count_if(F.coalesce("page_views", F.lit(0)) == 1).alias("n_single_page"))


def _with_placeholders(base: DataFrame) -> DataFrame:
    """Every list with at least one element; a release without visits has the placeholders only."""
    for name, (some, none) in _placeholders().items():
        kind = base.schema[name].dataType

        def element(fields: dict[str, Column]) -> Column:
            return F.array(F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in kind.elementType]))
        base = base.withColumn(name, F.when(F.col("total_visits") == 0, element(none))
                               .when(F.size(name) == 0, element(some)).otherwise(F.col(name)))
    return base


def release_payload(facts: R.ReleaseFacts, target_urls: Sequence[str] | None = None,
                    with_placeholders: bool = False) -> DataFrame:
    """``(release_ord, version, document struct)`` for every release."""
    info = R.release_info(facts)
    vm = R.visit_metrics(facts)
    pvm = R.pageview_metrics(facts)
    segs = R.segments(facts)
    dev = R.segment(facts, "device")
    lists = [
        _list(R.dist_page_views(facts), "bucket", ["range_min", "range_max", "count", "percentage"], "by_page_views"),
        _list(R.dist_duration(facts), "bucket", ["range_min", "range_max", "count", "percentage"], "by_duration_sec"),
        _list(dev, "rank", ["device_category"] + SEGMENT_FIELDS, "by_category"),
        *[_list(segs.filter(F.col("dimension") == d), "rank", SEGMENT_FIELDS, name)
          for d, name in [("os", "by_os"), ("browser", "by_browser"),
                          ("orientation", "by_screen_orientation"),
                          ("search_engine", "by_search_engine"), ("city", "top_cities")]],
        _list(R.page_metrics(facts, target_urls), "rank",
              ["url", "title", "visits_as_entry", "visits_as_exit", "total_hits", "unique_visitors",
               "visits_with_single_page", "subsequent_page_diversity"], "page_metrics"),
        _list(PA.common_transitions(facts), "rank", ["from_url", "to_url", "transition_count"],
              "common_transitions"),
        _list(PA.loop_patterns(facts, as_array=True), "rank",
              ["sequence", "occurrences"], "loop_patterns"),
        _list(R.funnel_entry_exit(facts, target_urls), "step",
              ["step", "url", "visits_entered", "visits_completed"], "application_funnel"),
    ]
    rn = PA.reverse_navigation(facts).drop("version")
    hi = R.high_interaction(facts).drop("version")
    ur = PA.url_revisits(facts).drop("version")
    base = info.join(vm.drop("version"), "release_ord").join(
        pvm.drop("version").withColumnRenamed("total_count", "pv_total"), "release_ord")
    for t in lists:
        base = base.join(t, "release_ord", "left")
        name = t.columns[-1]
        # a release without rows for a list gets an empty list, not NULL
        base = base.withColumn(name, F.coalesce(F.col(name), F.array().cast(t.schema[name].dataType)))
    base = base.join(rn.withColumnRenamed("percentage", "rn_pct"), "release_ord") \
               .join(hi.withColumnRenamed("percentage", "hi_pct")
                       .withColumnRenamed("avg_duration_sec", "hi_avg_duration_sec"), "release_ord") \
               .join(ur.withColumnRenamed("percentage", "ur_pct"), "release_ord")
    if with_placeholders:
        base = _with_placeholders(base.join(_visit_counts(facts), "release_ord", "left"))

    doc = F.struct(
        F.struct("version", F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end"))
                 .alias("data_period"), "total_visits", "total_hits", "unique_clients").alias("release_info"),
        F.struct(F.struct("total_count", "new_users", "returning_users", "avg_page_views", "median_page_views",
                          "avg_duration_sec", "median_duration_sec", "total_duration_sec").alias("visits"),
                 F.struct(F.col("pv_total").alias("total_count"), "unique_urls").alias("page_views"))
         .alias("aggregate_metrics"),
        F.struct("by_page_views", "by_duration_sec").alias("session_distribution"),
        F.struct("by_category", "by_os", "by_browser", "by_screen_orientation").alias("device_breakdown"),
        F.struct("by_search_engine").alias("traffic_sources"),
        F.struct("top_cities").alias("geographic_distribution"),
        F.col("page_metrics"),
        F.struct(F.struct("visits_with_reverse_nav", F.col("rn_pct").alias("percentage"),
                          "total_reverse_transitions").alias("reverse_navigation"),
                 "common_transitions", "loop_patterns").alias("navigation_patterns"),
        F.struct("application_funnel").alias("funnel_metrics"),
        F.struct(F.struct(F.col("sessions_high_interaction").alias("sessions_with_10plus_pages"),
                          F.col("hi_pct").alias("percentage"), "avg_pages",
                          F.col("hi_avg_duration_sec").alias("avg_duration_sec"), "avg_unique_urls")
                 .alias("high_interaction_sessions"),
                 F.struct("sessions_with_url_revisits", F.col("ur_pct").alias("percentage"),
                          "avg_revisits_per_session", "avg_unique_urls_revisited").alias("url_revisit_patterns"))
         .alias("session_complexity_metrics"))
    return base.select("release_ord", "version", doc.alias("release"))


def release_payload_json(facts: R.ReleaseFacts, target_urls: Sequence[str] | None = None,
                         with_placeholders: bool = False) -> DataFrame:
    """The document of each release as JSON text (what the payload POST body carries)."""
    p = release_payload(facts, target_urls, with_placeholders)
    return p.select("release_ord", "version", F.to_json("release", {"ignoreNullFields": "false"}).alias("payload"))


def payload_document(facts: R.ReleaseFacts, project_name: str, generated_at: str, data_source: str = "postgres_analytics",
                     target_urls: Sequence[str] | None = None) -> DataFrame:
    """One row: the whole payload, metadata around exactly two releases, every list with its placeholder if empty."""
    n = len(facts.period_list) if facts.period_list is not None else facts.periods.count()
    if n != 2:
        raise ValueError(f"a payload holds exactly 2 releases, not {n}")
    releases = release_payload(facts, target_urls, with_placeholders=True).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("release_ord", "release"))).alias("r"))
    metadata = F.struct(F.lit(project_name).alias("project_name"),
                        F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"), F.lit(data_source).alias("data_source"))
    return releases.select(F.struct(metadata.alias("metadata"), F.transform("r", lambda x: x["release"]).alias("releases"))
                           .alias("payload"))


def as_json(documents: DataFrame, column: str) -> DataFrame:
    """``documents`` with a nested column as JSON text, absent values written as null."""
    return documents.withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))


def flatten_document(documents: DataFrame, column: str, schema: T.DataType, keep: Sequence[str] = ()) -> DataFrame:
    """JSON documents as rows ``(*keep, path, number, text)``, one a leaf: ``a.b[0].c``, numbers as double.

    The schema says what stands where; an empty list is one row with the text ``[]``, a null leaf has two NULLs.
    """
    def leaves(kind: T.DataType, value: Column, path: Column) -> Column:
        if isinstance(kind, T.StructType):
            return F.concat(*[leaves(f.dataType, value[f.name], F.concat(path, F.lit("." + f.name))) for f in kind])
        if isinstance(kind, T.ArrayType):
            items = F.flatten(F.transform(value, lambda x, i: leaves(
                kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            return F.when(F.size(value) > 0, items).otherwise(leaf(path, None, F.lit("[]")))
        return leaf(path, value, None) if isinstance(kind, T.NumericType) else leaf(path, None, value)

    def leaf(path: Column, number: Column | None, text: Column | None) -> Column:
        none = F.lit(None)
        return F.array(F.struct(F.ltrim(path, F.lit(".")).alias("path"),
                                (none if number is None else number).cast("double").alias("number"),
                                (none if text is None else text).cast("string").alias("text")))

    parsed = documents.select(*keep, F.from_json(column, schema).alias("_doc"))
    return parsed.select(*keep, F.explode(leaves(schema, F.col("_doc"), F.lit(""))).alias("_l")).select(*keep, "_l.*")
