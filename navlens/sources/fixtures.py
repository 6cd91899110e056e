"""Derive the clickstream tables ``visits`` and ``hits`` from raw ``events``.

The test data has events, not sessions; this is the batch form of the
sessionisation extension (E1). Sessions are cut per user at a 12-hour
inactivity gap, and a fixed set of deliberate irregularities is injected so
every rule of the operators is exercised (ids listed but missing from hits,
hits listed by no visit, NULL id lists, NULL URL / title / city / search
engine, a device category outside 1..2, more OS / browsers / URLs than the
top-k cut-offs). The DuckDB text of the same derivation lives in
``navlens.plans.oracle``; both return identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navlens.operators.sequence import HOT_ROWS, plain_session_numbers, session_numbers, split_hot_keys

# Fixed values of the fixture definition.
SESSION_GAP_SECONDS = 12 * 3600
URL_BASE = "https://site.example/"
NULL_URL_EVERY = 97        # event_id % 97 = 0  -> hit with NULL url
MISSING_HIT_EVERY = 53     # event_id % 53 = 0  -> id listed, hit row absent
UNLISTED_HIT_EVERY = 59    # event_id % 59 = 0  -> hit row present, id not listed
NULL_CITY_EVERY = 11       # visit_id % 11 = 0  -> NULL region_city
SEARCH_ENGINES = {0: "google", 1: "yandex", 2: "bing"}   # visit_id % 4; 3 -> NULL
N_OS, N_BROWSERS, N_NATIONS = 12, 13, 25


def _event_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", "user_id", "event_type",
        F.col("event_id").cast("string").alias("watch_id"),
        F.col("user_id").cast("string").alias("client_id"),
        F.when(F.col("event_id") % NULL_URL_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(URL_BASE), F.col("event_type"), F.lit("/"),
                             (F.col("user_id") % 5).cast("string"))).alias("url"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("event_type"), F.lit(" page"))).alias("title"))


def hits_from_events(events: DataFrame) -> DataFrame:
    """One hit per event (minus the ``% 53`` holes). Needs no sessionisation."""
    ev = _event_rows(events)
    return ev.filter(F.col("event_id") % MISSING_HIT_EVERY != 0).select(
        "watch_id", "client_id", "url", F.col("ts").alias("datetime_hit"), "title")


def visits_from_events(events: DataFrame, nation: DataFrame,
                       chunk_seconds: int | None = None) -> DataFrame:
    """One row per session: grouped aggregate over sessionised events.

    ``start_url`` / ``end_url`` are the URLs of the first / last event by
    ``(ts, event_id)`` taken with ``min``/``max`` of a struct, which is a
    partial (map-side) aggregate; no per-session window is needed.
    """
    return visits_from_sessions(sessionize(events, chunk_seconds), nation)


def sessionize(events: DataFrame, chunk_seconds: int | None = None) -> DataFrame:
    """Event rows (with watch id, client, URL, title) numbered by session: ``sn``."""
    return session_numbers(_event_rows(events), "user_id", "ts", "event_id",
                           SESSION_GAP_SECONDS, chunk_seconds=chunk_seconds)


def _with_places(ev: DataFrame) -> DataFrame:
    """Sessionised events, partitioned by user, with their ``visit_id`` and, if listed, their ``pos`` in its id list.

    The windows need no shuffle of their own; a user's rows must fit a task (see :func:`split_hot_keys`).
    """
    w = Window.partitionBy("user_id", "sn").orderBy("ts", "event_id")
    listed = F.col("event_id") % UNLISTED_HIT_EVERY != 0
    return ev.select("*", F.min("event_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("visit_id"),
                     F.when(listed, F.count(F.when(listed, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("pos"))


def visits_from_sessions(ev: DataFrame, nation: DataFrame) -> DataFrame:
    """The visit rows from sessionised events (see :func:`visits_from_events`)."""
    order = F.struct("ts", "event_id", "url")
    v0 = ev.groupBy("user_id", "sn").agg(
        F.min("event_id").alias("visit_id"),
        F.expr(f"listagg(watch_id, ',') WITHIN GROUP (ORDER BY ts, event_id) "
               f"FILTER (WHERE event_id % {UNLISTED_HIT_EVERY} <> 0)").alias("watch_ids"),
        F.min("ts").alias("date_time"),
        (F.min("sn") == 1).alias("is_new_user"),
        F.min(order)["url"].alias("start_url"),
        F.max(order)["url"].alias("end_url"),
        F.count(F.lit(1)).cast("int").alias("page_views"),
        F.expr("cast(timestampdiff(SECOND, min(ts), max(ts)) as int)").alias("visit_duration"),
        F.max("client_id").alias("client_id"))
    vid = F.col("visit_id")
    mobile = (vid % 10 != 9) & (vid % 2 == 1)   # device category 2
    engine = F.lit(None).cast("string")
    for rem, name in reversed(list(SEARCH_ENGINES.items())):
        engine = F.when(vid % 4 == rem, F.lit(name)).otherwise(engine)
    # nation is a 25-row dimension; Spark's size-based broadcast picks it up.
    nat = nation.select(F.col("n_nationkey").cast("bigint").alias("_nk"), "n_name")
    return (v0.join(nat, (vid % N_NATIONS) == F.col("_nk"), "left")
              .select(
                  "visit_id", "watch_ids", "date_time", "is_new_user", "start_url", "end_url",
                  "page_views", "visit_duration",
                  F.when(vid % NULL_CITY_EVERY == 0, F.lit(None).cast("string"))
                   .otherwise(F.col("n_name")).alias("region_city"),
                  "client_id",
                  engine.alias("last_search_engine_root"),
                  F.when(vid % 10 == 9, 3).otherwise(1 + vid % 2).cast("int").alias("device_category"),
                  F.concat(F.lit("os_"), (vid % N_OS).cast("string")).alias("operating_system"),
                  F.concat(F.lit("browser_"), (vid % N_BROWSERS).cast("string")).alias("browser"),
                  F.when(vid % 3 == 0, "portrait").otherwise("landscape").alias("screen_orientation_name"),
                  F.when(mobile, F.concat(F.lit("phone_"), (vid % 3).cast("string"))).otherwise("").alias("mobile_phone"),
                  F.when(mobile, F.concat(F.lit("model_"), (vid % 7).cast("string"))).otherwise("")
                   .alias("mobile_phone_model"),
                  F.when(vid % 17 == 0, F.lit(None).cast("string")).when(vid % 2 == 1, "9:16").otherwise("16:9")
                   .alias("screen_format")))


def bridge_from_sessions(ev: DataFrame, path_chunk_seconds: int | None = None) -> DataFrame:
    """``(visit_id, pos, watch_id)``: every session's listed ids in list order,
    without building (or parsing) the id text.

    The id text of a visit is one value holding all its ids; the bridge keeps
    the same relation one row per id, so a session of any length is spread
    over many tasks. Positions are skew-safe ordinals over ``(ts, event_id)``.
    """
    from navlens.operators.sequence import ordinal_in_key, time_chunk
    vid = ev.groupBy("user_id", "sn").agg(F.min("event_id").alias("visit_id"))
    listed = ev.filter(F.col("event_id") % UNLISTED_HIT_EVERY != 0) \
               .select("user_id", "sn", "event_id", "ts", "watch_id").join(vid, ["user_id", "sn"])
    listed = ordinal_in_key(listed, ["user_id", "sn"], [F.col("ts"), F.col("event_id")],
                            time_chunk("ts", path_chunk_seconds) if path_chunk_seconds else None, out="pos")
    return listed.select("visit_id", "pos", "watch_id")


def clickstream(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(visits, hits)`` derived from ``{sf_dir}/events.parquet``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return visits_from_events(events, nation), hits_from_events(events)


# ---------------------------------------------------------------- materialised fixture tables

_MATERIALISED: dict[tuple, tuple[DataFrame, DataFrame, DataFrame]] = {}


def _signature(spark, sf_dir: str) -> tuple:
    """Identity of the inputs: application, folder, and the listing (path, size, time) of both tables' files.

    Listed through the file system that Spark reads by, so inputs on any store are told apart.
    """
    listed = []
    for name in ("events", "nation"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            listed.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.sparkContext.applicationId, sf_dir.rstrip("/"), tuple(sorted(listed))


def materialized_clickstream(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(visits, hits)`` written once per input into the shared checkpoint folder.

    The derivation (sessionisation: several shuffles) runs once: sessionised
    events are written first, with their visit and place in its list, and visits,
    the id bridge and hits are derived from that table. Every later query reads Parquet tables, which also cuts
    lineage, so a lost executor never recomputes the sessionisation. Visits
    are range-sorted by ``date_time`` so Parquet row-group statistics skip data
    outside a period filter. On a cluster the folder is the shared
    ``spark.checkpoint.dir``.
    """
    visits, hits, _ = materialized_tables(spark, sf_dir)
    return visits, hits


def materialized_bridge(spark, sf_dir: str) -> DataFrame:
    """The ``(visit_id, pos, watch_id)`` bridge of the derived visits (written once)."""
    return materialized_tables(spark, sf_dir)[2]


def derive_tables(spark, sf_dir: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(visits, hits, bridge)``, written; users of more than ``hot_rows`` events take the skew-safe way."""
    from navlens.session import scratch_path
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sp, op, vp, hp, bp = (scratch_path(spark, n) for n in ("sessions", "hot-sessions", "visits", "hits", "bridge"))
    plain, hot = split_hot_keys(_event_rows(events), ["user_id"], [F.col("ts"), F.col("event_id")], hot_rows)
    _with_places(plain_session_numbers(plain, "user_id", "ts", "event_id", SESSION_GAP_SECONDS)) \
        .write.mode("overwrite").parquet(sp)
    ev = spark.read.parquet(sp)
    # a NULL user's sessions are visits without bridge rows, as in bridge_from_sessions
    bridge = ev.filter("pos is not null and user_id is not null").select("visit_id", "pos", "watch_id")
    ev = ev.drop("visit_id", "pos")
    if hot is not None:
        session_numbers(hot.drop("_nl_ck"), "user_id", "ts", "event_id", SESSION_GAP_SECONDS, hot_rows=hot_rows) \
            .write.mode("overwrite").parquet(op)
        hot_ev = spark.read.parquet(op)
        ev, bridge = ev.unionByName(hot_ev), bridge.unionByName(bridge_from_sessions(hot_ev))
    visits_from_sessions(ev, nation).repartitionByRange("date_time").sortWithinPartitions("date_time") \
        .write.mode("overwrite").parquet(vp)
    bridge.write.mode("overwrite").parquet(bp)
    hits_from_events(events).write.mode("overwrite").parquet(hp)
    # DataFrames are immutable plans over the written files: reuse them
    return spark.read.parquet(vp), spark.read.parquet(hp), spark.read.parquet(bp)


def materialized_tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = _signature(spark, sf_dir)
    if key not in _MATERIALISED:
        _MATERIALISED[key] = derive_tables(spark, sf_dir)
    return _MATERIALISED[key]


_JOINED: dict[tuple, DataFrame] = {}


def materialized_joined(spark, sf_dir: str) -> DataFrame:
    """The visit-hit fact table of the path reports, written once per input.

    It is the input of every offline path report (wandering, backtracks,
    funnels, version comparisons); the reference caches it the same way.
    """
    from navlens.operators.linkage import joined_table
    from navlens.session import scratch_path
    key = _signature(spark, sf_dir)
    if key not in _JOINED:
        visits, hits, bridge = materialized_tables(spark, sf_dir)
        path = scratch_path(spark, "joined")
        joined_table(visits, hits, bridge=bridge).write.mode("overwrite").parquet(path)
        _JOINED[key] = spark.read.parquet(path)
    return _JOINED[key]
