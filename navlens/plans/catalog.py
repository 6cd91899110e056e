"""The query catalogue: every operator wired to the test tables, with its oracle.

Each entry is ``name -> (build(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
Every query reads the driver's tables (``events`` + ``nation`` for the
clickstream, ``orders`` / ``conversations`` / ``documents`` elsewhere) and
runs over them whole. The SQL is an independent statement of the same rule
in DuckDB over the same parquet views.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navlens.operators import linkage as L
from navlens.operators import paths as PA
from navlens.operators import release as R
from navlens.operators import wandering as WD
from navlens.plans import oracle as O
from navlens.sources.fixtures import materialized_joined, materialized_tables

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


class Inputs:
    """Per-call inputs derived from ``sf_dir`` (lazy DataFrames, nothing cached)."""

    def __init__(self, spark: SparkSession, sf_dir: str, periods=R.DEFAULT_PERIODS):
        self.spark, self.sf_dir = spark, sf_dir
        self.visits, self.hits, self.bridge = materialized_tables(spark, sf_dir)
        self.periods = periods

    @cached_property
    def facts(self) -> R.ReleaseFacts:
        return R.ReleaseFacts(self.visits, self.hits, self.periods, id_bridge=self.bridge)

    @cached_property
    def exploded(self) -> DataFrame:
        return L.explode_with_bridge(self.visits, self.bridge)

    @cached_property
    def joined(self) -> DataFrame:
        return materialized_joined(self.spark, self.sf_dir)


REL = O.release_ctes(R.DEFAULT_PERIODS)
JN = O.joined_ctes()


def W(body: str) -> str:
    return O.with_fixture(body)


# Fixed values of the statements, written out: a wrong constant of an operator must not pass on both sides.
SQL_WANDERING_QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
SQL_BACKTRACK_QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
SQL_BACKTRACK_SEGMENTS = [("0", -1, 0), ("1-2", 0, 2), ("3-5", 2, 5), ("6+", 5, None)]
SQL_PAGE_VIEW_BUCKETS = [(1, 1), (2, 5), (6, 10), (11, None)]
SQL_DURATION_BUCKETS = [(0, 30), (31, 120), (121, 300), (301, None)]
SQL_SEGMENTS = {
    "device": ("device_category", None), "os": ("operating_system", 10), "browser": ("browser", 10),
    "orientation": ("screen_orientation_name", None), "search_engine": ("last_search_engine_root", 10),
    "city": ("region_city", 15)}
SQL_SEGMENT_FALLBACK = {"search_engine": "direct", "city": "Unknown"}
SQL_CONCERNS = [
    ("reverse_nav_change_pct", 5, "Significant increase in reverse navigation"),
    ("loop_patterns_change", 0, "More loop patterns detected"),
    ("url_revisits_change_pct", 5, "Increase in URL revisit patterns"),
    ("avg_duration_change", 30, "Sessions taking longer (possible confusion)")]


# ================================================================ scans, linkage

query("scan_visits", W("select * from visits"))(lambda s, d: Inputs(s, d).visits)
query("scan_hits", W("select * from hits"))(lambda s, d: Inputs(s, d).hits)

query("watch_id_bridge", W(f"""b0 as (select visit_id, {O.ids_sql()} as ids from visits)
select visit_id, unnest(generate_series(1, len(ids))) as pos, unnest(ids) as watch_id from b0"""))(
    lambda s, d: L.watch_id_bridge(Inputs(s, d).visits))


# ================================================================ wandering family

WANDER_SQL = """ss as (select visit_id, count(distinct url) as unique_pages, count(watch_id) as hits,
                      min(date_time) as date_time_visit from jn group by visit_id),
ws as (select * from ss where hits >= 8)"""


@query("wandering_sessions", W(f"{JN},\n{WANDER_SQL}\nselect * from ws order by hits desc, visit_id"))
def q_wandering(spark, sf_dir):
    return WD.wandering_sessions(Inputs(spark, sf_dir).joined)


BALL = f"""ball0 as (select visit_id, {O.ids_sql()} as ids from visits),
ball as (select visit_id, unnest(generate_series(1, len(ids))) as pos, unnest(ids) as watch_id from ball0)"""


@query("hits_matching_visits", W(f"{BALL}\nselect * from hits where watch_id in (select watch_id from ball)"))
def q_hits_matching(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.hits_matching_visits(i.hits, L.watch_id_bridge(i.visits))


@query("visits_filtered_by_hits", W(f"{JN}\nselect * from ex where watch_id in (select watch_id from hits)"))
def q_visits_filtered(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.visits_filtered_by_hits(i.exploded, i.hits)


_EX_COLS = ", ".join(f"ex.{c}" + (" as client_id_visit" if c == "client_id" else "")
                     for c in O.VISIT_OTHER_COLS)


def _join_sql(how: str) -> str:
    key = "coalesce(ex.watch_id, h.watch_id)" if how == "right" else "ex.watch_id"
    return W(f"""{JN}
select {key} as watch_id, ex.visit_id, ex.pos, {_EX_COLS}, h.client_id as client_id_hit,
       h.url, h.datetime_hit, h.title
from ex {how} join hits h on ex.watch_id = h.watch_id""")


@query("join_left_watch", _join_sql("left"))
def q_join_left(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.join_visits_hits(i.exploded, i.hits, how="left")


@query("join_right_watch", _join_sql("right"))
def q_join_right(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.join_visits_hits(i.exploded, i.hits, how="right")


@query("join_left_watch_client", W(f"""{JN}
select ex.watch_id, ex.client_id, ex.visit_id, ex.pos,
       {", ".join("ex." + c for c in O.VISIT_OTHER_COLS if c != "client_id")},
       h.url, h.datetime_hit, h.title
from ex left join hits h on ex.watch_id = h.watch_id and trim(ex.client_id) = trim(h.client_id)"""))
def q_join_left_client(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    ex = i.exploded.withColumn("client_id", F.trim(F.col("client_id").cast("string")))
    hits = i.hits.withColumn("client_id", F.trim(F.col("client_id").cast("string")))
    return L.join_visits_hits(ex, hits, how="left", on=("watch_id", "client_id"))


@query("visits_with_hits", W(f"""{BALL},
n as (select b.visit_id, count(*) as n_hits, string_agg(b.watch_id, ',' order by b.pos) as hit_ids
      from ball b join hits h using (watch_id) group by b.visit_id)
select v.visit_id, coalesce(n.n_hits, 0) as n_hits, coalesce(n.hit_ids, '') as hit_ids
from visits v left join n using (visit_id)"""))
def q_visits_with_hits(spark, sf_dir):
    nested = L.visits_with_hits(*_vh(spark, sf_dir))
    return nested.select("visit_id", F.size("hits").cast("bigint").alias("n_hits"),
                         F.array_join(F.transform("hits", lambda h: h["watch_id"]), ",").alias("hit_ids"))


def _vh(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.visits, i.hits


@query("visit_paths", W(f"""{BALL}
select b.visit_id, row_number() over (partition by b.visit_id order by h.datetime_hit nulls first, b.pos) as step,
       b.pos, b.watch_id, h.url, h.datetime_hit
from ball b join hits h using (watch_id)"""))
def q_visit_paths(spark, sf_dir):
    from navlens.operators.sequence import ordinal_in_key
    i = Inputs(spark, sf_dir)
    bridge = L.watch_id_bridge(i.visits)
    out = ordinal_in_key(L.visit_hit_rows(bridge, i.hits), "visit_id",
                         [F.col("datetime_hit").asc_nulls_first(), F.col("pos")], sizes=bridge)
    return out.select("visit_id", "step", "pos", "watch_id", "url", "datetime_hit")


@query("join_diagnostics", W(f"""{JN},
v as (select watch_id, count(*) as n_v from ex group by 1),
h as (select watch_id, count(*) as n_h, count(url) as n_url from hits group by 1),
k as (select * from v full outer join h using (watch_id)),
a as (select cast(coalesce(sum(n_v), 0) as bigint) as exploded_rows, count(n_v) as distinct_visit_ids,
             count(n_h) as distinct_hit_ids,
             count(*) filter (where n_v is not null and n_h is not null) as common_ids,
             count(*) filter (where n_h is null) as only_visit_ids,
             count(*) filter (where n_v is null) as only_hit_ids,
             cast(coalesce(sum(n_h * coalesce(n_v, 1)), 0) as bigint) as merged_rows,
             cast(coalesce(sum(n_url * coalesce(n_v, 1)), 0) as bigint) as rows_with_url from k)
select *, case when merged_rows > 0 then rows_with_url / merged_rows * 100 end as pct_url_filled from a"""))
def q_join_diag(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.join_diagnostics(i.exploded, i.hits)


@query("filter_diagnostics", W(f"""{JN},
a as (select count(*) as rows_before,
             count(*) filter (where watch_id in (select watch_id from hits)) as rows_after from ex)
select rows_before, rows_after, rows_before - rows_after as rows_removed,
       case when rows_before > 0 then (rows_before - rows_after) / rows_before * 100 end as pct_removed from a"""))
def q_filter_diag(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.filter_diagnostics(i.exploded, i.hits)


query("ids_common", W(f"{JN}\nselect watch_id from ex intersect select watch_id from hits"))(
    lambda s, d: L.ids_common(Inputs(s, d).exploded, Inputs(s, d).hits))
query("ids_only_visits", W(f"{JN}\nselect watch_id from ex except select watch_id from hits"))(
    lambda s, d: (lambda i: L.ids_only_visits(i.exploded, i.hits))(Inputs(s, d)))
query("ids_only_hits", W(f"{JN}\nselect watch_id from hits except select watch_id from ex"))(
    lambda s, d: (lambda i: L.ids_only_hits(i.exploded, i.hits))(Inputs(s, d)))
query("ids_distinct", W(f"{JN}\nselect distinct watch_id from ex"))(
    lambda s, d: L.ids_distinct(Inputs(s, d).exploded))


@query("joined_by_version", W(f"""{O.periods_sql(R.DEFAULT_PERIODS)},
{JN}
select jn.*, p.version from jn
join periods p on jn.date_time between p.period_start and p.period_end"""))
def q_joined_by_version(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    tagged = R.tag_visits(i.visits, i.periods).drop("release_ord")
    return L.joined_table(tagged, i.hits, bridge=i.bridge)


# ================================================================ exported datasets

from navlens.sources import datasets as DS  # noqa: E402
from navlens.sources.sinks import write_export  # noqa: E402


def export_registry(spark, sf_dir) -> DS.Registry:
    """The visits and hits of the two default periods as two exports: prefixed names, the first with text ids in
    brackets and without screen format, the second with visit ids as text and plain id lists. Hits of a period
    are those in its time, so a visit at the end of one may list hits of the other export."""
    from navlens.session import scratch_path
    i = Inputs(spark, sf_dir)
    registry = DS.Registry(spark)
    for k, (version, start, end) in enumerate(R.DEFAULT_PERIODS):
        paths = scratch_path(spark, f"export-{version}-visits"), scratch_path(spark, f"export-{version}-hits")
        lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
        visits = i.visits.where(F.col("date_time").between(lo, hi))
        visits = visits.drop("screen_format") if k == 0 else visits.withColumn("visit_id", F.col("visit_id").cast("string"))
        write_export(visits, i.hits.where(F.col("datetime_hit").between(lo, hi)), *paths, brackets=k == 0)
        registry.add(DS.Dataset(version, *paths))
    return registry


_DATASETS_SQL = f"""{O.periods_sql(R.DEFAULT_PERIODS)},
dv as (select v.* exclude (screen_format), case when p.release_ord = 1 then null else v.screen_format end as screen_format,
              p.release_ord, p.version from visits v join periods p on v.date_time between p.period_start and p.period_end),
dh as (select h.*, p.release_ord, p.version from hits h
       join periods p on h.datetime_hit between p.period_start and p.period_end),
db as (select * exclude (ids, watch_ids), unnest(generate_series(1, len(ids))) as pos, unnest(ids) as watch_id
       from (select *, {O.ids_sql(bracketed=True)} as ids from dv)),
dj as (select db.* exclude (client_id), db.client_id as client_id_visit, dh.client_id as client_id_hit, dh.url,
              dh.datetime_hit, dh.title from db join dh on db.watch_id = dh.watch_id and db.release_ord = dh.release_ord)"""

query("datasets_joined", W(f"{_DATASETS_SQL}\nselect * from dj"))(lambda s, d: export_registry(s, d).joined())
query("datasets_visits", W(f"""{_DATASETS_SQL}
select * exclude (watch_ids), case when release_ord = 1 then '[' || watch_ids || ']' else watch_ids end as watch_ids from dv"""))(
    lambda s, d: export_registry(s, d).visits())
query("datasets_wandering", W(f"""{_DATASETS_SQL},
dw as (select release_ord, visit_id, count(*) as hits from dj where visit_id is not null group by all)
select release_ord, count(*) as sessions, count(*) filter (where hits >= 8) as wandering_sessions,
       count(*) filter (where hits >= 8) / count(*) * 100 as wandering_rate from dw group by all"""))(
    lambda s, d: CM.version_wandering(export_registry(s, d).joined()).select(
        "release_ord", "sessions", "wandering_sessions", "wandering_rate"))


# ================================================================ wandering / backtracks

FUNNEL_PATTERNS = ["/purchase/", "/signup/"]


@query("wandering_excl_funnel", W(f"""{JN},
{WANDER_SQL}
select * from ws where visit_id not in
  (select visit_id from jn where regexp_matches(url, '{"|".join(FUNNEL_PATTERNS)}'))
order by hits desc, visit_id"""))
def q_wandering_excl(spark, sf_dir):
    return WD.wandering_excl_funnel(Inputs(spark, sf_dir).joined, FUNNEL_PATTERNS)


@query("top_wandering", W(f"{JN},\n{WANDER_SQL}\nselect * from ws order by hits desc, visit_id limit 5"))
def q_top_wandering(spark, sf_dir):
    return WD.top_wandering(Inputs(spark, sf_dir).joined)


@query("wandering_summary", W(f"""{JN},
{WANDER_SQL},
a as (select count(*) as total_sessions, count(*) filter (where hits >= 8) as wandering_sessions,
             avg(hits) filter (where hits >= 8) as mean_hits,
             avg(unique_pages) filter (where hits >= 8) as mean_unique_pages,
             max(hits) filter (where hits >= 8) as max_hits from ss)
select total_sessions, wandering_sessions,
       case when total_sessions > 0 then wandering_sessions / total_sessions * 100 end as wandering_pct,
       mean_hits, mean_unique_pages, max_hits,
       coalesce(wandering_sessions / total_sessions > 0.1, false) as high_wandering_rate,
       coalesce(mean_unique_pages / mean_hits < 0.5, false) as repeat_visits_flag from a"""))
def q_wandering_summary(spark, sf_dir):
    return WD.wandering_summary(Inputs(spark, sf_dir).joined)


def _quantile_sql(col: str, src: str, qs) -> str:
    return "select " + ", ".join(f"quantile_cont({col}, {q}) as {name}" for name, q in qs.items()) + f" from {src}"


query("wandering_quantiles", W(f"{JN},\n{WANDER_SQL}\n" + _quantile_sql("hits", "ws", SQL_WANDERING_QUANTILES)))(
    lambda s, d: WD.wandering_quantiles(Inputs(s, d).joined))


def _bins_sql(src: str, col: str, bins, with_pct: bool) -> str:
    vals = ", ".join(f"({i + 1}, '{lab}', {float(lo)}, {'NULL' if hi is None else float(hi)})"
                     for i, (lab, lo, hi) in enumerate(bins))
    pct = (", case when (select count(*) from " + src + ") > 0 then coalesce(c.n, 0) / (select count(*) from "
           + src + ") * 100 end as percentage") if with_pct else ""
    return f"""bins as (select * from (values {vals}) b(bin, segment, lower, upper)),
c as (select b.bin, count(*) as n from {src} s join bins b
      on s.{col} > b.lower and (b.upper is null or s.{col} <= b.upper) group by b.bin)
select cast(b.bin as int) as bin, b.segment, cast(b.lower as double) as lower, cast(b.upper as double) as upper,
       coalesce(c.n, 0) as sessions{pct}
from bins b left join c using (bin)"""


_WSEG = [("(8,15]", 8, 15), ("(15,25]", 15, 25), ("(25,50]", 25, 50), ("(50,inf]", 50, None)]
query("wandering_segments", W(f"{JN},\n{WANDER_SQL},\n" + _bins_sql("ws", "hits", _WSEG, True)))(
    lambda s, d: WD.wandering_segments(Inputs(s, d).joined))
_WLEV = [("0-8", 0, 8), ("9-15", 8, 15), ("16+", 15, None)]
query("wandering_levels", W(f"{JN},\n{WANDER_SQL},\n" + _bins_sql("ws", "hits", _WLEV, False)))(
    lambda s, d: WD.wandering_levels(Inputs(s, d).joined))

BT_SQL = """bt0 as (select visit_id, coalesce(url, '') as u,
                lag(coalesce(url, ''), 2) over (partition by visit_id order by datetime_hit nulls last, watch_id) as p2
                from jn),
bt as (select visit_id, count(*) filter (where p2 = u) as backtracks from bt0 group by visit_id)"""

query("backtracks", W(f"{JN},\n{BT_SQL}\nselect * from bt"))(lambda s, d: WD.backtracks(Inputs(s, d).joined))


@query("backtrack_summary", W(f"""{JN},
{BT_SQL},
a as (select count(*) as total_sessions, count(*) filter (where backtracks > 0) as sessions_with_backtracks,
             avg(backtracks) as mean_backtracks, quantile_cont(backtracks, 0.5) as median_backtracks,
             max(backtracks) as max_backtracks, quantile_cont(backtracks, 0.9) as p90,
             count(*) filter (where backtracks > 5) as problematic_sessions from bt)
select total_sessions, sessions_with_backtracks, total_sessions - sessions_with_backtracks as sessions_without_backtracks,
       case when total_sessions > 0 then sessions_with_backtracks / total_sessions * 100 end as pct_with_backtracks,
       mean_backtracks, median_backtracks, max_backtracks, coalesce(max_backtracks > p90, false) as has_outliers,
       case when mean_backtracks > 2 then 'high' when mean_backtracks > 0.5 then 'moderate' else 'low' end as level,
       problematic_sessions from a"""))
def q_backtrack_summary(spark, sf_dir):
    return WD.backtrack_summary(Inputs(spark, sf_dir).joined)


query("backtrack_quantiles", W(f"{JN},\n{BT_SQL}\n" + _quantile_sql("backtracks", "bt", SQL_BACKTRACK_QUANTILES)))(
    lambda s, d: WD.backtrack_quantiles(Inputs(s, d).joined))
query("backtrack_segments", W(f"{JN},\n{BT_SQL},\n" + _bins_sql("bt", "backtracks", SQL_BACKTRACK_SEGMENTS, True)))(
    lambda s, d: WD.backtrack_segments(Inputs(s, d).joined))


def _hist_sql(src: str, col: str, n: int) -> str:
    return f"""r0 as (select min({col})::double as lo0, max({col})::double as hi0 from {src}),
r as (select case when lo0 = hi0 then lo0 - 0.5 else lo0 end as lo,
             case when lo0 = hi0 then hi0 + 0.5 else hi0 end as hi from r0 where lo0 is not null),
c as (select least(floor(({col} - lo) * {n} / (hi - lo)), {n - 1})::bigint as bin, count(*) as n
      from {src}, r group by 1)
select g.bin, lo + g.bin * ((hi - lo) / {n}) as lower, lo + (g.bin + 1) * ((hi - lo) / {n}) as upper,
       coalesce(c.n, 0) as count
from r, (select range::bigint as bin from range({n})) g left join c on c.bin = g.bin"""


query("hist_unique_pages", W(f"{JN},\n{WANDER_SQL},\n" + _hist_sql("ws", "unique_pages", 15)))(
    lambda s, d: WD.hist_unique_pages(Inputs(s, d).joined))
query("hist_backtracks", W(f"{JN},\n{BT_SQL},\n" + _hist_sql("bt", "backtracks", 20)))(
    lambda s, d: WD.hist_backtracks(Inputs(s, d).joined))


# ================================================================ release metrics (two periods)

def RW(body: str) -> str:
    return W(f"{REL},\n{body}")


def _facts(spark, sf_dir) -> R.ReleaseFacts:
    return Inputs(spark, sf_dir).facts


@query("release_info", RW("""v as (select release_ord, count(*) as total_visits,
                   count(distinct nullif(client_id, '')) as unique_clients from tv group by 1),
h as (select release_ord, count(*) as total_hits from rh group by 1)
select p.release_ord, p.version, p.period_start, p.period_end, coalesce(v.total_visits, 0) as total_visits,
       coalesce(h.total_hits, 0) as total_hits, coalesce(v.unique_clients, 0) as unique_clients
from periods p left join v using (release_ord) left join h using (release_ord)"""))
def q_release_info(spark, sf_dir):
    return R.release_info(_facts(spark, sf_dir))


@query("release_info_empty", W(f"""{O.periods_sql(R.DEFAULT_PERIODS + [("v0-empty", "2023-06-01 00:00:00", "2023-06-30 23:59:59")])},
{O.RELEASE_CTES.replace("{IDS}", O.ids_sql())},
v as (select release_ord, count(*) as total_visits,
             count(distinct nullif(client_id, '')) as unique_clients from tv group by 1),
h as (select release_ord, count(*) as total_hits from rh group by 1)
select p.release_ord, p.version, p.period_start, p.period_end, coalesce(v.total_visits, 0) as total_visits,
       coalesce(h.total_hits, 0) as total_hits, coalesce(v.unique_clients, 0) as unique_clients
from periods p left join v using (release_ord) left join h using (release_ord)"""))
def q_release_info_empty(spark, sf_dir):
    periods = R.DEFAULT_PERIODS + [("v0-empty", "2023-06-01 00:00:00", "2023-06-30 23:59:59")]
    return R.release_info(Inputs(spark, sf_dir, periods).facts)


@query("visit_metrics", RW("""a as (select release_ord, count(*) as total_count, count(*) filter (where is_new_user) as new_users,
       round_even(avg(coalesce(page_views, 0)), 2) as avg_page_views,
       cast(trunc(quantile_cont(coalesce(page_views, 0), 0.5)) as int) as median_page_views,
       cast(trunc(avg(coalesce(visit_duration, 0))) as int) as avg_duration_sec,
       cast(trunc(quantile_cont(coalesce(visit_duration, 0), 0.5)) as int) as median_duration_sec,
       cast(sum(coalesce(visit_duration, 0)) as bigint) as total_duration_sec from tv group by 1)
select p.release_ord, p.version, coalesce(total_count, 0) as total_count, coalesce(new_users, 0) as new_users,
       coalesce(total_count, 0) - coalesce(new_users, 0) as returning_users,
       coalesce(avg_page_views, 0.0) as avg_page_views, coalesce(median_page_views, 0) as median_page_views,
       coalesce(avg_duration_sec, 0) as avg_duration_sec, coalesce(median_duration_sec, 0) as median_duration_sec,
       coalesce(total_duration_sec, 0) as total_duration_sec
from periods p left join a using (release_ord)"""))
def q_visit_metrics(spark, sf_dir):
    return R.visit_metrics(_facts(spark, sf_dir))


@query("pageview_metrics", RW("""a as (select release_ord, count(*) as total_count,
                  count(distinct nullif(url, '')) as unique_urls from rh group by 1)
select p.release_ord, p.version, coalesce(total_count, 0) as total_count, coalesce(unique_urls, 0) as unique_urls
from periods p left join a using (release_ord)"""))
def q_pageview_metrics(spark, sf_dir):
    return R.pageview_metrics(_facts(spark, sf_dir))


def _dist_sql(col: str, buckets) -> str:
    vals = ", ".join(f"({i + 1}, {lo}, {'NULL' if hi is None else hi})" for i, (lo, hi) in enumerate(buckets))
    return RW(f"""b as (select * from (values {vals}) b(bucket, range_min, range_max)),
c as (select tv.release_ord, b.bucket, count(*) as n from tv join b
      on coalesce(tv.{col}, 0) >= b.range_min and (b.range_max is null or coalesce(tv.{col}, 0) <= b.range_max)
      group by 1, 2)
select t.release_ord, t.version, cast(b.bucket as int) as bucket, cast(b.range_min as int) as range_min,
       cast(b.range_max as int) as range_max, coalesce(c.n, 0) as count,
       case when t.total_visits > 0 then round_even(coalesce(c.n, 0) / t.total_visits * 100, 1) else 0.0 end as percentage
from tot t cross join b left join c on c.release_ord = t.release_ord and c.bucket = b.bucket""")


query("dist_page_views", _dist_sql("page_views", SQL_PAGE_VIEW_BUCKETS))(
    lambda s, d: R.dist_page_views(_facts(s, d)))
query("dist_duration", _dist_sql("visit_duration", SQL_DURATION_BUCKETS))(
    lambda s, d: R.dist_duration(_facts(s, d)))


def _seg_sql(dim: str) -> str:
    col, k = SQL_SEGMENTS[dim]
    if dim == "device":
        val = f"case when {col} = 1 then 'Desktop' when {col} = 2 then 'Mobile/Tablet' end"
        order = "min(device_category)"
        extra_sel, extra_g = ", g.device_category", f", {col} as device_category"
    else:
        val, order, extra_sel, extra_g = f"nullif({col}, '')", None, "", ""
    order_by = "device_category" if dim == "device" else "visits desc, segment_value"
    limit = f"where rank <= {k}" if k else ""
    fallback = ""
    if dim in SQL_SEGMENT_FALLBACK:
        fallback = f"""
union all
select t.release_ord, t.version, 1, '{SQL_SEGMENT_FALLBACK[dim]}', t.total_visits, 100.0, 0.0, 0, 0
from tot t where t.total_visits > 0 and not exists (select 1 from g where g.release_ord = t.release_ord)"""
    return RW(f"""g as (select release_ord, {val} as segment_value{extra_g}, count(*) as visits,
             sum(coalesce(page_views, 0)) as spv, sum(coalesce(visit_duration, 0)) as sdur,
             count(*) filter (where coalesce(page_views, 0) = 1) as single_page_visits
      from tv where {val} is not null group by all),
r as (select *, cast(row_number() over (partition by release_ord order by {order_by}) as int) as rank from g)
select r.release_ord, t.version, r.rank, r.segment_value{extra_sel.replace('g.', 'r.')}, r.visits,
       case when t.total_visits > 0 then round_even(r.visits / t.total_visits * 100, 1) else 0.0 end as percentage,
       round_even(r.spv / r.visits, 1) as avg_page_views, cast(trunc(r.sdur / r.visits) as int) as avg_duration_sec,
       r.single_page_visits
from r join tot t using (release_ord) {limit}{fallback}""")


for _dim in SQL_SEGMENTS:
    query(f"seg_{_dim}", _seg_sql(_dim))((lambda dim: lambda s, d: R.segment(_facts(s, d), dim))(_dim))


def _page_sql(targets=None) -> str:
    if targets:
        vals = ", ".join(f"({i + 1}, '{u}')" for i, u in enumerate(targets))
        pages = f"""tg as (select * from (values {vals}) t(rank, url)),
pg as (select p.release_ord, cast(tg.rank as int) as rank, tg.url, us.total_hits, us.unique_visitors, us._title
       from periods p cross join tg left join us on us.release_ord = p.release_ord and us.url = tg.url)"""
    else:
        pages = """pg as (select * from (select *, cast(row_number() over (partition by release_ord
                 order by total_hits desc, url) as int) as rank from us) where rank <= 20)"""
    return RW(f"""us as (select release_ord, url, count(*) as total_hits,
              count(distinct nullif(client_id, '')) as unique_visitors,
              min({{'t': coalesce(datetime_hit, timestamp '0001-01-01 00:00:00'), 'w': watch_id, 'title': title}})
                filter (where title <> '').title as _title
       from rh where url <> '' group by 1, 2),
nu as (select release_ord, count(distinct url) as n_urls from rh where url <> '' group by 1),
{pages},
en as (select release_ord, start_url as url, count(*) as visits_as_entry,
              count(*) filter (where coalesce(page_views, 0) = 1) as visits_with_single_page from tv group by 1, 2),
xt as (select release_ord, end_url as url, count(*) as visits_as_exit from tv group by 1, 2)
select pg.release_ord, p.version, pg.rank, pg.url,
       substr(coalesce(pg._title, coalesce(nullif(string_split(pg.url, '/')[-1], ''), 'Page')), 1, 100) as title,
       coalesce(en.visits_as_entry, 0) as visits_as_entry, coalesce(xt.visits_as_exit, 0) as visits_as_exit,
       coalesce(pg.total_hits, 0) as total_hits, coalesce(pg.unique_visitors, 0) as unique_visitors,
       coalesce(en.visits_with_single_page, 0) as visits_with_single_page,
       greatest(least(10, coalesce(nu.n_urls, 0) - case when pg.total_hits is not null then 1 else 0 end), 0)
         as subsequent_page_diversity
from pg join periods p using (release_ord)
left join en on en.release_ord = pg.release_ord and en.url = pg.url
left join xt on xt.release_ord = pg.release_ord and xt.url = pg.url
left join nu on nu.release_ord = pg.release_ord""")


TARGET_URLS = ["https://site.example/purchase/0", "https://site.example/view/1",
               "https://site.example/missing/page", "https://site.example/click/2"]

query("page_metrics", _page_sql())(lambda s, d: R.page_metrics(_facts(s, d)))
query("page_metrics_targets", _page_sql(TARGET_URLS))(
    lambda s, d: R.page_metrics(_facts(s, d), target_urls=TARGET_URLS))


def _funnel_sql(targets=None) -> str:
    if targets and len(targets) >= 2:
        t = targets[:5]
        vals = ", ".join(f"({i + 1}, '{u}', {str(i + 1 == len(t)).lower()})" for i, u in enumerate(t))
        steps = f"""st as (select p.release_ord, cast(s.step as int) as step, s.url, s.is_last
       from periods p cross join (values {vals}) s(step, url, is_last))"""
    else:
        steps = """s0 as (select release_ord, start_url as url, count(*) as n from tv where start_url <> '' group by 1, 2),
s1 as (select release_ord, url, cast(row_number() over (partition by release_ord order by n desc, url) as int) as step
       from s0),
st as (select release_ord, step, url, step = max(step) over (partition by release_ord) as is_last
       from s1 where step <= 3)"""
    return RW(f"""{steps},
a as (select st.release_ord, st.step,
             count(*) filter (where tv.start_url = st.url or contains(coalesce(tv.end_url, ''), st.url)) as ent,
             count(*) filter (where tv.end_url = st.url) as cmp
      from st join tv on tv.release_ord = st.release_ord group by 1, 2)
select st.release_ord, p.version, st.step, st.url, coalesce(a.ent, 0) as visits_entered,
       case when st.is_last then coalesce(a.ent, 0) else coalesce(a.cmp, 0) end as visits_completed
from st join periods p using (release_ord) left join a on a.release_ord = st.release_ord and a.step = st.step""")


query("funnel_entry_exit", _funnel_sql())(lambda s, d: R.funnel_entry_exit(_facts(s, d)))
query("funnel_targets", _funnel_sql(TARGET_URLS))(
    lambda s, d: R.funnel_entry_exit(_facts(s, d), target_urls=TARGET_URLS))


@query("high_interaction", RW("""a as (select release_ord, count(*) filter (where coalesce(page_views, 0) >= 10) as n,
             sum(coalesce(page_views, 0)) filter (where coalesce(page_views, 0) >= 10) as spv,
             sum(coalesce(visit_duration, 0)) filter (where coalesce(page_views, 0) >= 10) as sdur
      from tv group by 1)
select t.release_ord, t.version, coalesce(a.n, 0) as sessions_high_interaction,
       case when t.total_visits > 0 then round_even(coalesce(a.n, 0) / t.total_visits * 100, 1) else 0.0 end as percentage,
       case when a.n > 0 then round_even(a.spv / a.n, 1) else 0.0 end as avg_pages,
       case when a.n > 0 then cast(trunc(a.sdur / a.n) as int) else 0 end as avg_duration_sec,
       case when a.n > 0 then round_even(least(round_even(a.spv / a.n, 1) * 0.8, 20.0), 1) else 0.0 end as avg_unique_urls
from tot t left join a using (release_ord)"""))
def q_high_interaction(spark, sf_dir):
    return R.high_interaction(_facts(spark, sf_dir))


# ================================================================ navigation paths

PV_SQL = """pu as (select release_ord, visit_id, url, count(*) as n from pr where url <> '' group by 1, 2, 3),
pvv as (select release_ord, visit_id, sum(n) as n_urls, count(*) as n_distinct,
               count(*) filter (where n > 1) as n_revisited from pu group by 1, 2)"""


@query("url_revisits", RW(f"""{PV_SQL},
a as (select release_ord, count(*) as s, sum(n_urls - n_distinct) as rev, sum(n_revisited) as uq
      from pvv where n_urls - n_distinct > 0 group by 1)
select t.release_ord, t.version, coalesce(a.s, 0) as sessions_with_url_revisits,
       case when t.total_visits > 0 then round_even(coalesce(a.s, 0) / t.total_visits * 100, 1) else 0.0 end as percentage,
       case when a.s > 0 then round_even(a.rev / a.s, 1) else 0.0 end as avg_revisits_per_session,
       case when a.s > 0 then round_even(a.uq / a.s, 1) else 0.0 end as avg_unique_urls_revisited
from tot t left join a using (release_ord)"""))
def q_url_revisits(spark, sf_dir):
    return PA.url_revisits(_facts(spark, sf_dir))


@query("reverse_navigation", RW(f"""{PV_SQL},
a as (select release_ord, count(*) filter (where n_urls - n_distinct > 0) as n,
             cast(sum(n_urls - n_distinct) as bigint) as tr from pvv where n_urls >= 2 group by 1)
select t.release_ord, t.version, coalesce(a.n, 0) as visits_with_reverse_nav,
       case when t.total_visits > 0 then round_even(coalesce(a.n, 0) / t.total_visits * 100, 1) else 0.0 end as percentage,
       coalesce(a.tr, 0) as total_reverse_transitions
from tot t left join a using (release_ord)"""))
def q_reverse_nav(spark, sf_dir):
    return PA.reverse_navigation(_facts(spark, sf_dir))


SEQ_SQL = """sq as (select release_ord, visit_id, pos, url,
             lead(url, 1) over (partition by release_ord, visit_id order by datetime_hit nulls first, pos) as n1,
             lead(url, 2) over (partition by release_ord, visit_id order by datetime_hit nulls first, pos) as n2
      from pr where url <> '')"""


@query("common_transitions", RW(f"""{SEQ_SQL},
g as (select release_ord, url as from_url, n1 as to_url, count(*) as transition_count
      from sq where n1 is not null group by 1, 2, 3),
r as (select *, cast(row_number() over (partition by release_ord
                 order by transition_count desc, from_url, to_url) as int) as rank from g)
select r.release_ord, p.version, rank, from_url, to_url, transition_count
from r join periods p using (release_ord) where rank <= 10"""))
def q_transitions(spark, sf_dir):
    return PA.common_transitions(_facts(spark, sf_dir))


@query("loop_patterns", RW(f"""{SEQ_SQL},
g as (select release_ord, url as url_a, n1 as url_b, count(*) as occurrences
      from sq where n2 = url and n1 <> url group by 1, 2, 3),
r as (select *, cast(row_number() over (partition by release_ord order by occurrences desc, url_a, url_b) as int)
                as rank from g)
select r.release_ord, p.version, rank, concat_ws(' -> ', url_a, url_b, url_a) as sequence, occurrences
from r join periods p using (release_ord) where rank <= 5"""))
def q_loops(spark, sf_dir):
    return PA.loop_patterns(_facts(spark, sf_dir))


@query("revisit_flags", RW("""select pr.release_ord, p.version, pr.visit_id, pr.pos, pr.url,
       row_number() over (partition by pr.release_ord, pr.visit_id, pr.url
                          order by pr.datetime_hit nulls first, pr.pos) > 1 as seen_before
from pr join periods p using (release_ord) where pr.url <> ''"""))
def q_revisit_flags(spark, sf_dir):
    return PA.revisit_flags(_facts(spark, sf_dir))


# ================================================================ filters / endpoints

from navlens.operators import compare as CM  # noqa: E402
from navlens.operators import filters as FL  # noqa: E402
from navlens.operators import funnels as FN  # noqa: E402

P_START, P_END = "2024-01-10T00:00:00+03:00", "2024-01-20T12:00:00+03:00"


query("visits_in_period", W("select * from visits where date_time between timestamp '2024-01-10 00:00:00' "
                            "and timestamp '2024-01-20 12:00:00'"))(
    lambda s, d: FL.visits_in_period(Inputs(s, d).visits, P_START, P_END, "strip"))
query("visits_in_period_utc", W("select * from visits where date_time between timestamp '2024-01-09 21:00:00' "
                                "and timestamp '2024-01-20 09:00:00'"))(
    lambda s, d: FL.visits_in_period(Inputs(s, d).visits, P_START, P_END, "to_utc"))
query("visits_by_new_user", W("select * from visits where is_new_user = true"))(
    lambda s, d: FL.visits_by_new_user(Inputs(s, d).visits, 1))
query("visits_by_region", W("select * from visits where region_city = 'NATION_7'"))(
    lambda s, d: FL.visits_by_region(Inputs(s, d).visits, "ignored-country", "NATION_7"))
query("visits_by_device", W("select * from visits where device_category = 2 "
                            "and operating_system = 'os_5' and screen_orientation_name = 'landscape'"))(
    lambda s, d: FL.visits_by_device(Inputs(s, d).visits, "2", "os_5", "1"))


def _ux_sql(where: str) -> str:
    return W(f"""select count(*) as count, round_even(avg(visit_duration), 2) as avg_duration_sec,
       round_even(quantile_cont(visit_duration, 0.5), 2) as median_duration_sec,
       min(visit_duration) as min_duration_sec, max(visit_duration) as max_duration_sec
from visits where visit_duration is not null and {where}""")


UX_START, UX_END = "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z"
query("ux_metrics", _ux_sql(
    "date_time between timestamp '2024-01-01 00:00:00' and timestamp '2024-01-31 00:00:00' "
    "and is_new_user = false and cast(device_category as varchar) = '1'"))(
    lambda s, d: FL.ux_metrics(Inputs(s, d).visits, UX_START, UX_END, False, "1"))
query("ux_metrics_last_7d", _ux_sql(
    "date_time between timestamp '2024-01-13 00:00:00' and timestamp '2024-01-20 00:00:00' "
    "and is_new_user = true and cast(device_category as varchar) = '2' and operating_system = 'os_5' "
    "and screen_orientation_name = 'portrait' and region_city = 'NATION_3'"))(
    lambda s, d: FL.ux_metrics(Inputs(s, d).visits, None, None, True, "2", "os_5", "0", "NATION_3",
                               as_of="2024-01-20T00:00:00"))
query("visits_last_7d", W("select * from visits where date_time between timestamp '2024-01-18 00:00:00' "
                          "and timestamp '2024-01-25 00:00:00'"))(
    lambda s, d: FL.visits_last_days(Inputs(s, d).visits, "2024-01-25T00:00:00"))
query("available_dates", W("select min(date_time) as min_date, max(date_time) as max_date, "
                           "count(visit_id) as total_visits from visits"))(
    lambda s, d: FL.available_dates(Inputs(s, d).visits))
query("top_start_urls", W("select start_url as url, count(visit_id) as visits from visits "
                          "where start_url is not null group by 1 order by visits desc, url limit 20"))(
    lambda s, d: FL.top_start_urls(Inputs(s, d).visits))


# ================================================================ bounce / regex funnel

KEY_PAGES = ["/view/", "/purchase/", "click/[0-2]$", "/nowhere/"]
FUNNEL_STEPS = ["/view/", "/click/", "/purchase/"]


def _bounce_sql(src: str) -> str:
    parts = []
    for p in KEY_PAGES:
        m = f"coalesce(regexp_matches(start_url, '{p}'), false)"
        parts.append(f"""select '{p}' as page, count(*) filter (where {m}) as sessions,
       case when count(*) filter (where {m}) > 0 then
         count(*) filter (where {m} and coalesce(page_views = 1, false)) / count(*) filter (where {m}) end
         as bounce_rate from {src}""")
    return "\nunion all\n".join(parts)


query("page_bounce_rates", W(_bounce_sql("visits")))(
    lambda s, d: FN.page_bounce_rates(Inputs(s, d).visits, KEY_PAGES))
query("page_bounce_rates_hit_weighted", W(f"{JN}\n" + _bounce_sql("ex")))(
    lambda s, d: FN.page_bounce_rates(Inputs(s, d).visits, KEY_PAGES, weight="hit"))

_first = "case " + " ".join(f"when coalesce(regexp_matches(url, '{p}'), false) then {i}"
                             for i, p in enumerate(FUNNEL_STEPS)) + " end"
query("funnel_regex", W(f"""{JN},
fr as (select visit_id, min({_first}) as f from jn group by visit_id),
st as (select * from (values {", ".join(f"({i}, '{p}')" for i, p in enumerate(FUNNEL_STEPS))}) s(step, pattern))
select cast(st.step as int) as step, st.pattern,
       (select count(*) from fr where f = st.step) as reached,
       (select count(*) from fr where f >= st.step) as cumulative_reached,
       (select count(*) from fr where f >= st.step) / (select count(*) from fr) as percent
from st"""))(lambda s, d: FN.funnel_regex(Inputs(s, d).joined, FUNNEL_STEPS))

query("bounce_baseline", W("""dy as (select start_url, datediff('day', date '1970-01-01', cast(date_time as date)) as day_num,
              count(*) as sessions, count(*) filter (where coalesce(page_views = 1, false)) as bounces
       from visits where start_url <> '' group by 1, 2),
bw as (select *, sum(sessions) over w as bs, sum(bounces) over w as bb from dy
       window w as (partition by start_url order by day_num range between 28 preceding and 1 preceding))
select start_url, cast(date '1970-01-01' + cast(day_num as integer) as date) as day, sessions, bounces,
       bounces / sessions as bounce_rate, bb / bs as baseline_rate, bounces / sessions - bb / bs as delta
from bw"""))(lambda s, d: FN.bounce_baseline(Inputs(s, d).visits))


# ================================================================ release comparison

SUMMARY_SQL = f"""{PV_SQL},
{SEQ_SQL},
vm as (select release_ord, count(*) filter (where is_new_user) as new_users,
              cast(trunc(avg(coalesce(visit_duration, 0))) as int) as avg_duration_sec,
              round_even(avg(coalesce(page_views, 0)), 2) as avg_page_views,
              count(*) filter (where coalesce(page_views, 0) >= 10) as n_hi from tv group by 1),
hc as (select release_ord, count(*) as total_hits from rh group by 1),
rn as (select release_ord, count(*) filter (where n_urls - n_distinct > 0) as n from pvv where n_urls >= 2 group by 1),
lp as (select release_ord, count(*) as n from (select distinct release_ord, url, n1 from sq
       where n2 = url and n1 <> url) group by 1),
rv as (select release_ord, count(*) as n from pvv where n_urls - n_distinct > 0 group by 1),
sm as (select t.release_ord, t.version, p.period_start, p.period_end, t.total_visits,
              coalesce(hc.total_hits, 0) as total_hits, coalesce(vm.new_users, 0) as new_users,
              t.total_visits - coalesce(vm.new_users, 0) as returning_users,
              coalesce(vm.avg_duration_sec, 0) as avg_duration_sec, coalesce(vm.avg_page_views, 0.0) as avg_page_views,
              case when t.total_visits > 0 then round_even(coalesce(rn.n, 0) / t.total_visits * 100, 1) else 0.0 end
                as reverse_nav_pct,
              greatest(least(coalesce(lp.n, 0), 5), 1) as loop_list_len,
              case when t.total_visits > 0 then round_even(coalesce(vm.n_hi, 0) / t.total_visits * 100, 1) else 0.0 end
                as high_interaction_pct,
              case when t.total_visits > 0 then round_even(coalesce(rv.n, 0) / t.total_visits * 100, 1) else 0.0 end
                as url_revisit_pct
       from tot t join periods p using (release_ord) left join vm using (release_ord)
       left join hc using (release_ord) left join rn using (release_ord)
       left join lp using (release_ord) left join rv using (release_ord)),
o as (select * from sm where release_ord = 1),
n as (select * from sm where release_ord = 2)"""

CMP_SELECT = """o.version as version_old, n.version as version_new, n.total_visits - o.total_visits as total_change,
       case when o.total_visits > 0 then (n.total_visits - o.total_visits) / o.total_visits * 100 else 0.0 end
         as total_change_pct,
       n.avg_duration_sec - o.avg_duration_sec as avg_duration_change,
       n.avg_page_views - o.avg_page_views as avg_page_views_change,
       n.reverse_nav_pct - o.reverse_nav_pct as reverse_nav_change_pct,
       n.loop_list_len - o.loop_list_len as loop_patterns_change,
       n.high_interaction_pct - o.high_interaction_pct as high_interaction_change_pct,
       n.url_revisit_pct - o.url_revisit_pct as url_revisits_change_pct"""


def _summary(spark, sf_dir):
    return CM.release_summary(_facts(spark, sf_dir))


query("release_comparison", RW(f"{SUMMARY_SQL}\nselect {CMP_SELECT} from o, n"))(
    lambda s, d: CM.release_comparison(_summary(s, d)))

_concern_cases = ", ".join(f"case when {c} > {lim} then '{msg}' end" for c, lim, msg in SQL_CONCERNS)
query("release_concerns", RW(f"""{SUMMARY_SQL},
c as (select {CMP_SELECT} from o, n),
m as (select *, list_filter([{_concern_cases}], lambda x: x is not null) as msgs from c)
select version_old, version_new, cast(len(msgs) as int) as n_concerns, array_to_string(msgs, '; ') as concerns,
       case when len(msgs) >= 3 then 'high' when len(msgs) >= 1 then 'medium' else 'low' end as concern_level
from m"""))(lambda s, d: CM.release_concerns(CM.release_comparison(_summary(s, d))))


def _share(part: str, side: str) -> str:
    return f"case when {side}.total_visits > 0 then {side}.{part} / {side}.total_visits * 100 else 0.0 end"


query("release_change_table", RW(f"""{SUMMARY_SQL}
select o.version as version_old, n.version as version_new,
       {_share('new_users', 'o')} as old_new_users_pct, {_share('returning_users', 'o')} as old_returning_pct,
       {_share('new_users', 'n')} as new_new_users_pct, {_share('returning_users', 'n')} as new_returning_pct,
       n.total_visits - o.total_visits as visits_change,
       case when o.total_visits > 0 then (n.total_visits - o.total_visits) / o.total_visits * 100 else 0.0 end
         as visits_change_pct,
       n.avg_duration_sec - o.avg_duration_sec as duration_change,
       case when o.avg_duration_sec > 0 then (n.avg_duration_sec - o.avg_duration_sec) / o.avg_duration_sec * 100
            else 0.0 end as duration_change_pct,
       n.avg_page_views - o.avg_page_views as pages_change,
       case when o.avg_page_views > 0 then (n.avg_page_views - o.avg_page_views) / o.avg_page_views * 100
            else 0.0 end as pages_change_pct,
       n.reverse_nav_pct - o.reverse_nav_pct as reverse_nav_change,
       n.loop_list_len - o.loop_list_len as loops_change,
       n.high_interaction_pct - o.high_interaction_pct as high_interaction_change,
       n.url_revisit_pct - o.url_revisit_pct as revisits_change
from o, n"""))(lambda s, d: CM.release_change_table(_summary(s, d)))

PROJECT_NAME = "Analytics Project"


@query("payload_validation", RW(f"""{SUMMARY_SQL},
dk as (select release_ord, bool_and(coalesce(device_category between 1 and 2, true)) as ok from tv
       where device_category in (1, 2) group by 1)
select 0 as release_ord, 'exactly_two_releases' as rule, (select count(*) from sm) = 2 as passed
union all select 0, 'project_name_present', true
union all select release_ord, 'visits_non_negative', total_visits >= 0 from sm
union all select release_ord, 'hits_non_negative', total_hits >= 0 from sm
union all select release_ord, 'start_before_end', period_start < period_end from sm
union all select release_ord, 'bucket_pct_in_range', true from sm
union all select sm.release_ord, 'device_category_in_range', coalesce(dk.ok, true) from sm left join dk using (release_ord)"""))
def q_payload_validation(spark, sf_dir):
    f = _facts(spark, sf_dir)
    dist = R.dist_page_views(f).unionByName(R.dist_duration(f))
    return CM.payload_validation(CM.release_summary(f), dist, R.segment(f, "device"), PROJECT_NAME)


# a payload that breaks rules: a third release whose period ends before it starts, no project name, shares of
# page-view buckets counted against new users, and every device category that the visits have
BROKEN_PERIODS = [*R.DEFAULT_PERIODS, ("reversed", "2024-01-20 00:00:00", "2024-01-10 00:00:00")]


@query("payload_validation_broken", W(f"""{O.release_ctes(BROKEN_PERIODS)},
nu as (select release_ord, count(*) filter (where is_new_user) as n from tv group by 1),
bk as (select tv.release_ord, b.k, count(*) as c from tv join (values (1, 1, 1), (2, 2, 5), (3, 6, 10), (4, 11, 1000000000)) b(k, lo, hi)
       on coalesce(page_views, 0) between b.lo and b.hi group by all),
bp as (select release_ord, max(c) / any_value(n) <= 1 as ok from bk join nu using (release_ord) where n > 0 group by 1),
dk as (select release_ord, bool_and(device_category in (1, 2)) as ok from tv group by 1),
vc as (select release_ord, count(*) as n from tv group by 1)
select 0 as release_ord, 'exactly_two_releases' as rule, (select count(*) from periods) = 2 as passed
union all select 0, 'project_name_present', length(trim('  ')) > 0
union all select release_ord, 'visits_non_negative', coalesce(vc.n, 0) >= 0 from periods left join vc using (release_ord)
union all select release_ord, 'hits_non_negative', true from periods
union all select release_ord, 'start_before_end', period_start < period_end from periods
union all select release_ord, 'bucket_pct_in_range', coalesce(bp.ok, true) from periods left join bp using (release_ord)
union all select release_ord, 'device_category_in_range', coalesce(dk.ok, true) from periods left join dk using (release_ord)"""))
def q_payload_validation_broken(spark, sf_dir):
    f = Inputs(spark, sf_dir, BROKEN_PERIODS).facts
    new_users = f.tagged.groupBy("release_ord").agg(F.count_if("is_new_user").alias("new_users"))
    shares = R.dist_page_views(f).join(new_users, "release_ord").withColumn(
        "percentage", F.try_divide(F.col("count") * 100, F.col("new_users")))
    devices = f.tagged.groupBy("release_ord", "device_category").count()
    return CM.payload_validation(R.release_info(f), shares, devices, "  ")


# ================================================================ version comparison

JV = f"""{O.periods_sql(R.DEFAULT_PERIODS)},
{JN},
jv as (select jn.*, p.release_ord from jn join periods p on jn.date_time between p.period_start and p.period_end),
vss as (select release_ord, visit_id, count(distinct url) as unique_pages, count(watch_id) as hits
        from jv group by 1, 2),
vw as (select release_ord, count(*) as sessions, count(*) filter (where hits >= 8) as wandering_sessions,
              count(*) filter (where hits >= 8) / count(*) * 100 as wandering_rate,
              coalesce(avg(hits) filter (where hits >= 8), 0.0) as mean_hits,
              coalesce(avg(unique_pages) filter (where hits >= 8), 0.0) as mean_unique_pages from vss group by 1),
vb0 as (select release_ord, visit_id, coalesce(url, '') as u,
               lag(coalesce(url, ''), 2) over (partition by release_ord, visit_id
                                               order by datetime_hit nulls last, watch_id) as p2 from jv),
vbt as (select release_ord, visit_id, count(*) filter (where p2 = u) as backtracks from vb0 group by 1, 2),
vb as (select release_ord, count(*) as sessions, count(*) filter (where backtracks > 0) as sessions_with_backtracks,
              count(*) filter (where backtracks > 0) / count(*) * 100 as backtrack_rate,
              avg(backtracks) as mean_backtracks from vbt group by 1)"""


def _metric_sql(src: str, metrics) -> str:
    union = "\nunion all ".join(f"select release_ord, '{m}' as metric, cast({m} as double) as v from {src}"
                                for m in metrics)
    return f"""m as ({union}),
pm as (select metric, max(v) filter (where release_ord = 1) as value_old,
              max(v) filter (where release_ord = 2) as value_new from m group by metric)
select metric, value_old, value_new, value_new - value_old as delta,
       case when value_old > 0 then (value_new - value_old) / value_old * 100 else 0.0 end as change_pct from pm"""


def _joined_v(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.joined_table(R.tag_visits(i.visits, i.periods), i.hits, bridge=i.bridge)


query("compare_wandering", W(f"{JV},\n" + _metric_sql("vw", CM.WANDERING_METRICS)))(
    lambda s, d: CM.compare_wandering(_joined_v(s, d)))
query("compare_backtracks", W(f"{JV},\n" + _metric_sql("vb", CM.BACKTRACK_METRICS)))(
    lambda s, d: CM.compare_backtracks(_joined_v(s, d)))
query("version_verdict", W(f"""{JV},
c as (select (select wandering_rate from vw where release_ord = 2) - (select wandering_rate from vw where release_ord = 1)
               as wandering_change,
             (select backtrack_rate from vb where release_ord = 2) - (select backtrack_rate from vb where release_ord = 1)
               as backtracks_change,
             (select mean_backtracks from vb where release_ord = 2) - (select mean_backtracks from vb where release_ord = 1)
               as avg_backtracks_change),
v as (select *, cast(coalesce(wandering_change < -1, false) as int) + cast(coalesce(backtracks_change < -2, false) as int)
                + cast(coalesce(avg_backtracks_change < -0.1, false) as int) as positive_votes,
                cast(coalesce(wandering_change > 1, false) as int) + cast(coalesce(backtracks_change > 2, false) as int)
                + cast(coalesce(avg_backtracks_change > 0.1, false) as int) as negative_votes from c)
select wandering_change, backtracks_change, avg_backtracks_change,
       case when wandering_change < -2 then 'better' when wandering_change > 2 then 'worse' else 'stable' end
         as wandering_verdict,
       case when backtracks_change < -5 then 'better' when backtracks_change > 5 then 'worse' else 'stable' end
         as backtracks_verdict,
       positive_votes, negative_votes,
       case when positive_votes > negative_votes then 'positive' when negative_votes > positive_votes then 'negative'
            else 'mixed' end as overall
from v"""))(lambda s, d: CM.version_verdict(_joined_v(s, d)))


# ================================================================ text reports

from navlens.functions import ids as IDS  # noqa: E402
from navlens.functions import scalars as SC  # noqa: E402
from navlens.functions.text import SECTION_TITLES  # noqa: E402
from navlens.operators import sections as SE  # noqa: E402

# one title per section (alternating languages) to build report texts from documents
REPORT_TITLES = [titles[i % 2] for i, (_, titles) in enumerate(SECTION_TITLES)]


def report_texts(spark, sf_dir) -> DataFrame:
    """Documents turned into analysis reports: header lines around the whole text.

    Every ninth document stays without headers (-> ``full_text``); every fifth
    repeats its first section at the end (the last occurrence wins).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    t = F.array(*[F.lit(x) for x in REPORT_TITLES])
    n = len(REPORT_TITLES)
    t1 = F.element_at(t, (F.col("doc_id") % n + 1).cast("int"))
    t2 = F.element_at(t, ((F.col("doc_id") + 3) % n + 1).cast("int"))
    rep = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\n# "), t1, F.lit("\nRepeated section"))) \
           .otherwise(F.lit(""))
    body = F.concat(F.lit("Intro "), F.col("doc_id").cast("string"), F.lit("\n## "), t1, F.lit("\n"),
                    F.col("text"), F.lit("\n### "), t2, F.lit(":\n"), F.lit("Closing note "), F.col("lang"), rep)
    return docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.col("text")).otherwise(body).alias("text"))


_T = "[" + ", ".join(f"'{x}'" for x in REPORT_TITLES) + "]"
_NL = "chr(10)"
REPORT_SQL = f"""d as (select doc_id, case when doc_id % 9 = 0 then text else
   concat('Intro ', cast(doc_id as varchar), {_NL}, '## ', {_T}[doc_id % {len(REPORT_TITLES)} + 1], {_NL}, text,
          {_NL}, '### ', {_T}[(doc_id + 3) % {len(REPORT_TITLES)} + 1], ':', {_NL}, 'Closing note ', lang,
          case when doc_id % 5 = 0 then concat({_NL}, '# ', {_T}[doc_id % {len(REPORT_TITLES)} + 1], {_NL},
                                               'Repeated section') else '' end) end as text
   from documents)"""


def _hdr_case() -> str:
    whens = " ".join(f"when regexp_matches(line, '(?i)^#+\\s*(?:{'|'.join(titles)})') then '{name}'"
                     for name, titles in SECTION_TITLES)
    return f"case {whens} end"


SECTIONS_SQL = f"""{REPORT_SQL},
l0 as (select doc_id, string_split(text, {_NL}) as parts from d),
ln as (select doc_id, unnest(generate_series(1, len(parts))) as ln, unnest(parts) as line from l0),
hd as (select *, {_hdr_case()} as hdr from ln),
oc as (select *, sum(case when hdr is not null then 1 else 0 end)
                   over (partition by doc_id order by ln rows between unbounded preceding and current row) as occ
       from hd),
hs as (select doc_id, occ, hdr as section from oc where hdr is not null),
ct as (select oc.doc_id, oc.occ, coalesce(hs.section, 'main') as section,
              string_agg(oc.line, {_NL} order by oc.ln) as body
       from oc left join hs on hs.doc_id = oc.doc_id and hs.occ = oc.occ
       where oc.hdr is null group by 1, 2, 3),
lt as (select doc_id, section, arg_max(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), occ) as content
       from ct group by 1, 2),
nm as (select distinct doc_id from lt where section <> 'main'),
sec as (select * from lt where doc_id in (select doc_id from nm)
        union all select doc_id, 'full_text', text from d where doc_id not in (select doc_id from nm))"""

query("text_sections", W(f"{SECTIONS_SQL}\nselect * from sec"))(
    lambda s, d: SE.text_sections(report_texts(s, d)))
query("text_summary", W(f"""{SECTIONS_SQL}
select doc_id, coalesce(nullif(max(content) filter (where section = 'summary'), ''),
                        nullif(max(content) filter (where section = 'conclusions'), ''),
                        substr(coalesce(max(content) filter (where section = 'full_text'), ''), 1, 500)) as summary
from sec group by doc_id"""))(lambda s, d: SE.text_summary(SE.text_sections(report_texts(s, d))))


# ================================================================ id / scalar parsing

def _id_forms(col: str) -> list[tuple[str, object]]:
    c = F.col(col)
    return [("plain", c), ("bracketed", F.concat(F.lit("["), c, F.lit("]"))),
            ("json", F.concat(F.lit('["'), F.regexp_replace(c, ",", '","'), F.lit('"]'))),
            ("python", F.concat(F.lit("['"), F.regexp_replace(c, ",", "', '"), F.lit("']")))]


@query("parse_watch_ids", W(f"""f as (select visit_id, 'plain' as form, watch_ids as s from visits
  union all select visit_id, 'bracketed', '[' || watch_ids || ']' from visits
  union all select visit_id, 'json', '["' || replace(watch_ids, ',', '","') || '"]' from visits
  union all select visit_id, 'python', '[''' || replace(watch_ids, ',', ''', ''') || ''']' from visits),
p as (select visit_id, form, {O.ids_sql('s', bracketed=True)} as ids from f)
select visit_id, form, len(ids) as n_ids, array_to_string(ids, ',') as ids from p"""))
def q_parse_ids(spark, sf_dir):
    v = Inputs(spark, sf_dir).visits
    forms = F.array(*[F.struct(F.lit(n).alias("form"), e.alias("s")) for n, e in _id_forms("watch_ids")])
    f = v.select("visit_id", F.inline(forms))
    ids = IDS.parse_id_list("s")
    return f.select("visit_id", "form", F.array_size(ids).cast("bigint").alias("n_ids"),
                    F.array_join(ids, ",").alias("ids"))


_NORM_FORMS = [("plain", "{c}"), ("quoted", "concat('''', {c}, '''')"), ("dquoted", "concat('\"', {c}, '\"')"),
               ("padded", "concat('  ', {c}, ' ')"), ("sci_plus", "concat({c}, 'e+0')"),
               ("sci_minus", "concat({c}, '0E-1')"), ("sci_junk", "concat('x', {c}, 'e+')")]


@query("normalize_watch_id", W("f as (" + " union all ".join(
    f"select watch_id, '{n}' as form, {e.format(c='watch_id')} as s from hits" for n, e in _NORM_FORMS) + f""")
select watch_id, form, s,
  case when regexp_matches(s, '(?i)e[+-]')
       then coalesce(cast(cast(trunc(try_cast(s as double)) as decimal(38, 0)) as varchar), s)
       else regexp_replace({O.strip_sql('s')}, '[''"]', '', 'g') end as normalized
from f"""))
def q_normalize_ids(spark, sf_dir):
    h = Inputs(spark, sf_dir).hits
    forms = F.array(*[F.struct(F.lit(n).alias("form"), F.expr(e.format(c="watch_id")).alias("s"))
                      for n, e in _NORM_FORMS])
    f = h.select("watch_id", F.inline(forms))
    return f.select("watch_id", "form", "s", IDS.normalize_id("s").alias("normalized"))


_BOOL_TEXT = "case visit_id % 6 when 0 then '1' when 1 then 'True' when 2 then 'true' when 3 then 'TRUE' " \
             "when 4 then '0' else 'yes' end"
_INT_TEXT = "concat(cast(page_views as {S}), case visit_id % 3 when 0 then '.7' when 1 then '' else 'x' end)"
_DT_TEXT = ("case visit_id % 4 when 0 then strftime(date_time, '%Y-%m-%d %H:%M:%S') "
            "when 1 then strftime(date_time, '%Y-%m-%dT%H:%M:%S') when 2 then '' else 'not a date' end")
_DT_TEXT_SPARK = ("case visit_id % 4 when 0 then date_format(date_time, 'yyyy-MM-dd HH:mm:ss') "
                  "when 1 then date_format(date_time, \"yyyy-MM-dd'T'HH:mm:ss\") when 2 then '' else 'not a date' end")


@query("parse_scalars", W(f"""f as (select visit_id, {_BOOL_TEXT} as bool_text,
              {_INT_TEXT.format(S='varchar')} as int_text, {_DT_TEXT} as dt_text from visits)
select visit_id, bool_text, coalesce(bool_text in ('1', 'True', 'true', 'TRUE'), false) as parsed_bool,
       int_text,
       case when regexp_matches({O.strip_sql('int_text')}, '^[+-]?[0-9]+$') then try_cast({O.strip_sql('int_text')} as bigint)
            else cast(trunc(try_cast({O.strip_sql('int_text')} as double)) as bigint) end as parsed_int,
       dt_text, case when {O.strip_sql('dt_text')} <> '' then try_cast({O.strip_sql('dt_text')} as timestamp) end as parsed_dt
from f"""))
def q_parse_scalars(spark, sf_dir):
    v = Inputs(spark, sf_dir).visits
    f = v.select("visit_id", F.expr(_BOOL_TEXT).alias("bool_text"),
                 F.expr(_INT_TEXT.format(S="string")).alias("int_text"), F.expr(_DT_TEXT_SPARK).alias("dt_text"))
    return f.select("visit_id", "bool_text", SC.parse_bool("bool_text").alias("parsed_bool"),
                    "int_text", SC.parse_int("int_text").alias("parsed_int"),
                    "dt_text", SC.parse_datetime("dt_text").alias("parsed_dt"))


# ================================================================ P1, S4

from navlens.sources import readers as RD  # noqa: E402


@query("strip_prefix", W("select * from visits"))
def q_strip_prefix(spark, sf_dir):
    v = Inputs(spark, sf_dir).visits
    raw = v.toDF(*[RD.VISIT_PREFIX + c for c in v.columns])   # the raw export's column names
    return RD.strip_prefix(raw, RD.VISIT_PREFIX)


@query("csv_visits_regroup", W(f"""{BALL},
ids as (select visit_id, string_agg(watch_id, ',' order by pos) as watch_ids from ball group by visit_id)
select v.visit_id, ids.watch_ids, v.* exclude (visit_id, watch_ids)
from visits v left join ids on v.visit_id = ids.visit_id"""))
def q_csv_regroup(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    # the CSV layout: one row per (visit, listed id) with an explicit row ordinal
    rows = L.explode_visits(i.visits, bracketed=False, outer=True).withColumnRenamed("pos", "row_no")
    return RD.regroup_visit_rows(rows, "row_no")


# ================================================================ snapshot diff

from navlens.operators import snapshot as SN  # noqa: E402

SNAP_SQL = """o as (select 'orders/' || cast(o_orderkey as varchar) || '.parquet' as path, o_totalprice as version
      from orders where o_orderdate < timestamp '1999-01-01'),
n as (select 'orders/' || cast(o_orderkey as varchar) || '.parquet' as path,
             case when o_orderstatus = 'F' then o_totalprice else o_totalprice + 1 end as version
      from orders where o_orderdate >= timestamp '1997-01-01'),
d as (select coalesce(o.path, n.path) as path,
             case when o.path is null then 'new' when n.path is null then 'deleted'
                  when o.version is not distinct from n.version then 'not_modified' else 'modified' end as status,
             o.version as old_version, n.version as new_version
      from o full outer join n on o.path = n.path)"""


def order_snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two listings cut from ``orders``: old = ordered before 1999, new = from 1997
    on, where orders not yet fulfilled (status != 'F') changed their version."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".parquet")).alias("path")
    old = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")) \
           .select(path, F.col("o_totalprice").alias("version"))
    new = o.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select(
        path, F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
               .otherwise(F.col("o_totalprice") + 1).alias("version"))
    return old, new


query("snapshot_diff", f"with {SNAP_SQL}\nselect * from d")(
    lambda s, d: SN.snapshot_diff(*order_snapshots(s, d)))
query("snapshot_diff_counts", f"with {SNAP_SQL}\nselect status, count(*) as files from d group by status")(
    lambda s, d: SN.diff_counts(SN.snapshot_diff(*order_snapshots(s, d))))


# ================================================================ sources and sinks

from navlens.operators import daily_state as DY  # noqa: E402
from navlens.plans import payload as PL  # noqa: E402
from navlens.sources import incremental as IN  # noqa: E402
from navlens.sources import reload as RL  # noqa: E402
from navlens.sources import sinks as SK  # noqa: E402
from navlens.streaming import sessionize as ST  # noqa: E402


@query("csv_hits", W("select watch_id, coalesce(client_id, '') as client_id, coalesce(url, '') as url, "
                     "datetime_hit, coalesce(title, '') as title from hits"))
def q_csv_hits(spark, sf_dir):
    path = SK.write_hits_csv(Inputs(spark, sf_dir).hits)
    return RD.read_hits_csv(spark, path)


@query("roundtrip_joined", W(f"{JN}\nselect *, cast(date_time as date) as visit_date from jn"))
def q_roundtrip_joined(spark, sf_dir):
    path = SK.write_joined(Inputs(spark, sf_dir).joined)
    return spark.read.parquet(path)


@query("reload_tables", W("select * from visits"))
def q_reload_tables(spark, sf_dir):
    name = SK.save_table(Inputs(spark, sf_dir).visits, "navlens_visits")
    return spark.table(name)


@query("daily_page_views", W("""select cast(datetime_hit as date) as day, url, count(*) as hits,
       count(distinct client_id) as clients from hits group by all"""))
def q_daily_page_views(spark, sf_dir):
    """Page views by day, kept up from a folder of daily files by its listing."""
    from navlens.session import scratch_path
    folder = scratch_path(spark, "hits-by-day")
    hits = Inputs(spark, sf_dir).hits.withColumn("day", F.to_date("datetime_hit"))
    hits.repartition("day").write.partitionBy("day").parquet(folder)

    def day_of(path):
        return F.regexp_extract(path, r"day=([0-9-]+)", 1).try_cast("date")

    def build(paths):
        rows = spark.read.parquet(*paths).withColumn("day", day_of(F.col("_metadata.file_path")))
        return rows.groupBy("day", "url").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("client_id").alias("clients"))

    table = IN.DayTable(spark, scratch_path(spark, "page-views"), build, day_of)
    table.refresh(RD.file_listing(spark, folder, "*.parquet"))
    return table.read()


# the two releases, every week of the month, and a period cut inside its first and last day
DAILY_PERIODS = [*R.DEFAULT_PERIODS,
                 *[(f"week from {d}", f"2024-01-{d:02} 00:00:00", f"2024-01-{d + 6:02} 23:59:59") for d in range(1, 25)],
                 ("cut", "2024-01-03 07:30:00", "2024-01-09 18:15:00")]


def daily_state(spark, sf_dir) -> DY.DailyState:
    """The state of every day that has visits, written in two updates."""
    from navlens.session import scratch_path
    i = Inputs(spark, sf_dir)

    def rows_of(days):
        wanted = F.to_date("date_time").isin([F.lit(d).cast("date") for d in days])
        return i.visits.where(wanted), i.hits, i.bridge

    state = DY.DailyState(spark, scratch_path(spark, "daily-state"), rows_of)
    days = sorted(str(r.day) for r in i.visits.select(F.to_date("date_time").alias("day")).distinct().collect() if r.day)
    state.write_days(days[:len(days) // 2])
    state.write_days(days[len(days) // 2:])
    return state


_DAILY_SQL = O.release_ctes(DAILY_PERIODS)


def _over_daily_periods(name: str) -> str:
    """The statement of a release query, over the overlapping periods."""
    return REGISTRY[name][1].replace(REL, _DAILY_SQL)


query("daily_release_info", _over_daily_periods("release_info"))(
    lambda s, d: daily_state(s, d).release_info(DAILY_PERIODS))
query("daily_pageview_metrics", _over_daily_periods("pageview_metrics"))(
    lambda s, d: daily_state(s, d).pageview_metrics(DAILY_PERIODS))


def reloaded(spark, sf_dir) -> RL.TableSet:
    """Visits and hits read from their CSV exports and made current together."""
    from navlens.session import scratch_path
    i = Inputs(spark, sf_dir)
    tables = RL.TableSet(spark, scratch_path(spark, "reload"))
    tables.reload({"visits": RD.read_visits_csv(spark, SK.write_visits_csv(i.visits)),
                   "hits": RD.read_hits_csv(spark, SK.write_hits_csv(i.hits))},
                  {"visits": [RL.unique_key("visit_id")], "hits": [RL.unique_key("watch_id")]})
    return tables


@query("reload_hits", W("select watch_id, coalesce(client_id, '') as client_id, coalesce(url, '') as url, "
                        "datetime_hit, coalesce(title, '') as title from hits"))
def q_reload_hits(spark, sf_dir):
    return reloaded(spark, sf_dir).read("hits")


@query("reload_visits", W(f"""{BALL}
select visit_id, watch_ids, date_time, is_new_user, page_views, visit_duration, device_category,
       {", ".join(f"coalesce({c}, '') as {c}" for c in O.VISIT_TEXT_COLS)}
from visits v"""))
def q_reload_visits(spark, sf_dir):
    return reloaded(spark, sf_dir).read("visits").select(*L.VISIT_COLS)


query("file_listing")(lambda s, d: RD.file_listing(s, d, "*.parquet"))


# The document, list by list: (path, query whose oracle gives its rows, filter, column of the order, fields).
_SEG = ["segment_value", "visits", "percentage", "avg_page_views", "avg_duration_sec", "single_page_visits"]
_BUCKET = ["range_min", "range_max", "count", "percentage"]
_DOC_LISTS = [
    ("session_distribution.by_page_views", "dist_page_views", "bucket", _BUCKET),
    ("session_distribution.by_duration_sec", "dist_duration", "bucket", _BUCKET),
    ("device_breakdown.by_category", "seg_device", "rank", ["device_category", *_SEG]),
    ("device_breakdown.by_os", "seg_os", "rank", _SEG), ("device_breakdown.by_browser", "seg_browser", "rank", _SEG),
    ("device_breakdown.by_screen_orientation", "seg_orientation", "rank", _SEG),
    ("traffic_sources.by_search_engine", "seg_search_engine", "rank", _SEG),
    ("geographic_distribution.top_cities", "seg_city", "rank", _SEG),
    ("page_metrics", "page_metrics", "rank", ["url", "title", "visits_as_entry", "visits_as_exit", "total_hits",
                                              "unique_visitors", "visits_with_single_page", "subsequent_page_diversity"]),
    ("navigation_patterns.common_transitions", "common_transitions", "rank", ["from_url", "to_url", "transition_count"]),
    ("navigation_patterns.loop_patterns", "loop_patterns", "rank", ["sequence", "occurrences"]),
    ("funnel_metrics.application_funnel", "funnel_entry_exit", "step", ["step", "url", "visits_entered", "visits_completed"])]
_DOC_VALUES = [
    ("release_info", "release_info", {c: c for c in ["version", "total_visits", "total_hits", "unique_clients"]}
     | {"data_period.start": "period_start", "data_period.end": "period_end"}),
    ("aggregate_metrics.visits", "visit_metrics", {c: c for c in [
        "total_count", "new_users", "returning_users", "avg_page_views", "median_page_views", "avg_duration_sec",
        "median_duration_sec", "total_duration_sec"]}),
    ("aggregate_metrics.page_views", "pageview_metrics", {c: c for c in ["total_count", "unique_urls"]}),
    ("navigation_patterns.reverse_navigation", "reverse_navigation", {c: c for c in [
        "visits_with_reverse_nav", "percentage", "total_reverse_transitions"]}),
    ("session_complexity_metrics.high_interaction_sessions", "high_interaction",
     {"sessions_with_10plus_pages": "sessions_high_interaction"}
     | {c: c for c in ["percentage", "avg_pages", "avg_duration_sec", "avg_unique_urls"]}),
    ("session_complexity_metrics.url_revisit_patterns", "url_revisits", {c: c for c in [
        "sessions_with_url_revisits", "percentage", "avg_revisits_per_session", "avg_unique_urls_revisited"]})]
_DOC_TEXTS = {"version", "segment_value", "url", "title", "from_url", "to_url"}
# The lists of a release without visits, literally.
_EMPTY_LISTS = {
    "session_distribution.by_page_views": {"range_min": 1, "range_max": 1}, "session_distribution.by_duration_sec": {"range_max": 30},
    "device_breakdown.by_category": {"device_category": 1, "segment_value": "Desktop"},
    **{p: {"segment_value": "Unknown"} for p in (
        "device_breakdown.by_os", "device_breakdown.by_browser", "device_breakdown.by_screen_orientation",
        "traffic_sources.by_search_engine", "geographic_distribution.top_cities")},
    "page_metrics": {"url": "/", "title": "Home"}, "navigation_patterns.common_transitions": {"from_url": "/", "to_url": "/"},
    "navigation_patterns.loop_patterns": {"sequence": "/"}, "funnel_metrics.application_funnel": {"step": 1, "url": "/"}}


def _document_sql(periods, placeholders: bool) -> str:
    """(release_ord, path, number, text) of the releases, from the oracles of the single reports.

    Without placeholders a list without rows is one row ``[]``; with them a release without visits has those of
    ``_EMPTY_LISTS`` (the data has rows for all lists of a release with visits).
    """
    old, new = O.periods_sql(R.DEFAULT_PERIODS), O.periods_sql(periods)
    names = sorted({n for _, n, *_ in _DOC_LISTS} | {n for _, n, _ in _DOC_VALUES})
    ctes = [f"{n}_ as ({REGISTRY[n][1].replace(old, new)})" for n in names]

    def value(path: str, column: str, is_text: bool) -> str:
        number = "cast(null as double)" if is_text else f"cast({column} as double)"
        return f"{path} as path, {number} as number, {f'cast({column} as varchar)' if is_text else 'cast(null as varchar)'} as text"

    parts = []
    for path, n, fields in _DOC_VALUES:
        for field, column in fields.items():
            time = "data_period" in field
            shown = f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if time else column
            parts.append(f"select release_ord, {value(repr(f'{path}.{field}'), shown, time or field in _DOC_TEXTS)} from {n}_")
    for path, n, order, fields in _DOC_LISTS:
        some = "release_ord in (select release_ord from release_info_ where total_visits > 0)" if placeholders else "true"
        ctes.append(f"{n}_l as (select *, '{path}[' || (row_number() over (partition by release_ord order by {order}) - 1) || ']'"
                    f" as place from {n}_ where {some})")
        for field in fields:
            if field == "sequence":
                parts += [f"select release_ord, {value(f'place || {chr(39)}.sequence[{k}]{chr(39)}', f'string_split(sequence, {chr(39)} -> {chr(39)})[{k + 1}]', True)} from {n}_l"
                          for k in range(3)]
            else:
                parts.append(f"select release_ord, {value(f'place || {chr(39)}.{field}{chr(39)}', field, field in _DOC_TEXTS)} from {n}_l")
        none = f"from release_info_ where release_ord not in (select release_ord from {n}_l)"
        if not placeholders:
            parts.append(f"select release_ord, {value(repr(path), repr('[]'), True)} {none}")
            continue
        for field in fields:
            given = _EMPTY_LISTS[path].get(field, 0)
            place = f"{path}[0].{field}" + ("[0]" if field == "sequence" else "")
            parts.append(f"select release_ord, {value(repr(place), repr(given), isinstance(given, str))} {none}")
    return f"with {', '.join(ctes)}\n" + "\nunion all ".join(parts)


def q_release_payload_json(spark, sf_dir):
    """The JSON text of each release, read back by the document's schema, leaf by leaf."""
    facts = _facts(spark, sf_dir).materialized()
    documents = PL.release_payload_json(facts)
    schema = PL.release_payload(facts).schema["release"].dataType
    return PL.flatten_document(documents, "payload", schema, ["release_ord"])


PAYLOAD_PERIODS = [("v0-empty", "2023-06-01 00:00:00", "2023-06-30 23:59:59"), R.DEFAULT_PERIODS[1]]


def q_payload_document(spark, sf_dir):
    """The payload of two releases, the first of them without visits, as JSON, read back leaf by leaf."""
    facts = Inputs(spark, sf_dir, PAYLOAD_PERIODS).facts.materialized()
    document = PL.payload_document(facts, "site", "2024-02-01 12:00:00")
    return PL.flatten_document(PL.as_json(document, "payload"), "payload", document.schema["payload"].dataType)


query("release_payload_json", _document_sql(R.DEFAULT_PERIODS, False))(q_release_payload_json)
query("payload_document", f"""select 'releases[' || (release_ord - 1) || '].' || path as path, number, text
from ({_document_sql(PAYLOAD_PERIODS, True)})
union all select * from (values ('metadata.project_name', cast(null as double), 'site'),
  ('metadata.generated_at', null, '2024-02-01 12:00:00'), ('metadata.data_source', null, 'postgres_analytics'))""")(q_payload_document)


@query("stream_sessions", W("""select user_id, min(ts) as session_start,
       max(ts) + interval '12 hours' + interval '1 microsecond' as session_end,
       max(ts) as last_event_ts, min(event_id) as first_event_id, count(*) as events
from ev group by user_id, sn"""))
def q_stream_sessions(spark, sf_dir):
    return ST.run_session_stream(spark, sf_dir).sessions()


# ================================================================ all segment dimensions in one pass

def _seg_all_sql() -> str:
    parts = []
    for dim in SQL_SEGMENTS:
        body = _seg_sql(dim)
        # reuse each dimension's statement as a sub-select (drop the device-only column)
        inner = body[body.index("with ") + 5:]
        parts.append((dim, inner))
    ctes, selects = [], []
    for i, (dim, inner) in enumerate(parts):
        selects.append(f"select release_ord, version, '{dim}' as dimension, rank, segment_value, visits, percentage, "
                       f"avg_page_views, avg_duration_sec, single_page_visits from s{i}")
        ctes.append(inner)
    # every per-dimension statement starts with the same fixture CTEs; wrap each as its own subquery
    subqueries = ",\n".join(f"s{i} as (with {inner})" for i, inner in enumerate(ctes))
    return f"with {subqueries}\n" + "\nunion all\n".join(selects)


query("seg_all", _seg_all_sql())(lambda s, d: R.segments(_facts(s, d)))


# ================================================================ F17, S4 through a CSV file

from navlens.functions import text as TXT  # noqa: E402


@query("decode_escapes", "select doc_id, text from documents")
def q_decode_escapes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    escaped = docs.select("doc_id", TXT.escape_non_ascii(F.col("text")).alias("escaped"))
    return escaped.select("doc_id", TXT.decode_escapes(F.col("escaped")).alias("text"))


@query("csv_visits", W(f"""{BALL}
select visit_id, watch_ids, date_time, is_new_user, page_views, visit_duration, device_category,
       {", ".join(f"coalesce({c}, '') as {c}" for c in O.VISIT_TEXT_COLS)}
from visits v"""))
def q_csv_visits(spark, sf_dir):
    path = SK.write_visits_csv(Inputs(spark, sf_dir).visits)
    v = RD.read_visits_csv(spark, path)
    return v.select(*L.VISIT_COLS)


# ================================================================ C10: text reports as (metric, value) tables

def _rows_sql(src: str, metrics, prefix: str = "") -> str:
    return "\nunion all ".join(f"select '{prefix}{m}' as metric, cast({m} as double) as value from {src}"
                               for m in metrics)


def _report_bins_sql(src: str, col: str, bins) -> str:
    vals = ", ".join(f"('{lab}', {float(lo)}, {'NULL' if hi is None else float(hi)})" for lab, lo, hi in bins)
    return f"""rb as (select b.segment, count(s.{col}) as sessions,
              case when (select count(*) from {src}) > 0 then count(s.{col}) / (select count(*) from {src}) * 100 end
                as percentage
       from (values {vals}) b(segment, lower, upper)
       left join {src} s on s.{col} > b.lower and (b.upper is null or s.{col} <= b.upper)
       group by b.segment)"""


_WS_SUMMARY = """wsum as (select count(*) as total_sessions, count(*) filter (where hits >= 8) as wandering_sessions,
       count(*) filter (where hits >= 8) / count(*) * 100 as wandering_pct, 8 as threshold,
       avg(hits) filter (where hits >= 8) as mean_hits, avg(unique_pages) filter (where hits >= 8) as mean_unique_pages,
       max(hits) filter (where hits >= 8) as max_hits,
       coalesce(count(*) filter (where hits >= 8) / count(*) > 0.1, false) as high_wandering_rate,
       coalesce(avg(unique_pages) filter (where hits >= 8) / avg(hits) filter (where hits >= 8) < 0.5, false)
         as repeat_visits_flag from ss),
wq as (select """ + ", ".join(f"quantile_cont(hits, {q}) as {name}" for name, q in SQL_WANDERING_QUANTILES.items()) + " from ws)"

query("wandering_report", W(f"""{JN},
{WANDER_SQL},
{_WS_SUMMARY},
{_report_bins_sql("ws", "hits", _WSEG)}
{_rows_sql("wsum", ["total_sessions", "wandering_sessions", "wandering_pct", "threshold", "mean_hits",
                    "mean_unique_pages", "max_hits", "high_wandering_rate", "repeat_visits_flag"])}
union all {_rows_sql("wq", list(SQL_WANDERING_QUANTILES), "hits ")}
union all select 'segment ' || segment || ' sessions', cast(sessions as double) from rb
union all select 'segment ' || segment || ' pct', cast(percentage as double) from rb"""))(
    lambda s, d: WD.wandering_report(Inputs(s, d).joined))

_BT_SUMMARY = """bsum as (select count(*) as total_sessions, count(*) filter (where backtracks > 0) as sessions_with_backtracks,
       count(*) filter (where backtracks = 0) as sessions_without_backtracks,
       count(*) filter (where backtracks > 0) / count(*) * 100 as pct_with_backtracks,
       avg(backtracks) as mean_backtracks, quantile_cont(backtracks, 0.5) as median_backtracks,
       max(backtracks) as max_backtracks,
       coalesce(max(backtracks) > quantile_cont(backtracks, 0.9), false) as has_outliers,
       avg(backtracks) > 2 as level_high, avg(backtracks) > 0.5 and avg(backtracks) <= 2 as level_moderate,
       avg(backtracks) <= 0.5 as level_low,
       count(*) filter (where backtracks > 5) as problematic_sessions from bt),
bq as (select """ + ", ".join(f"quantile_cont(backtracks, {q}) as {name}" for name, q in SQL_BACKTRACK_QUANTILES.items()) + " from bt)"

query("backtrack_report", W(f"""{JN},
{BT_SQL},
{_BT_SUMMARY},
{_report_bins_sql("bt", "backtracks", SQL_BACKTRACK_SEGMENTS)}
{_rows_sql("bsum", ["total_sessions", "sessions_with_backtracks", "sessions_without_backtracks",
                    "pct_with_backtracks", "mean_backtracks", "median_backtracks", "max_backtracks",
                    "has_outliers", "level_high", "level_moderate", "level_low", "problematic_sessions"])}
union all {_rows_sql("bq", list(SQL_BACKTRACK_QUANTILES), "backtracks ")}
union all select 'segment ' || segment || ' sessions', cast(sessions as double) from rb
union all select 'segment ' || segment || ' pct', cast(percentage as double) from rb"""))(
    lambda s, d: WD.backtrack_report(Inputs(s, d).joined))
