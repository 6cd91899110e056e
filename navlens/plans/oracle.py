"""SQL text of the fixture derivation, for DuckDB (the oracle) and Spark SQL.

``fixture_ctes(dialect)`` returns the ``WITH`` body defining ``hits`` and
``visits`` from the pre-registered ``events`` and ``nation`` views; oracle
queries append their own CTEs and a final ``SELECT``.
"""

from __future__ import annotations

_SUBST = {
    "duckdb": {
        "S": "varchar",
        "WATCH": "string_agg(watch_id, ',' order by ts, event_id) filter (where event_id % 59 <> 0)",
        "DUR": "cast(datesub('second', min(ts), max(ts)) as int)",
    },
    "spark": {
        "S": "string",
        "WATCH": "listagg(watch_id, ',') within group (order by ts, event_id) "
                 "filter (where event_id % 59 <> 0)",
        "DUR": "cast(timestampdiff(SECOND, min(ts), max(ts)) as int)",
    },
}

_FIXTURE = """
gaps as (
  select *, lag(ts) over (partition by user_id order by ts, event_id) as prev_ts from events),
brk as (
  select *, sum(case when prev_ts is not null and ts <= prev_ts + interval '12' hour then 0 else 1 end)
              over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as sn from gaps),
ev as (
  select min(event_id) over (partition by user_id, sn) as visit_id, sn, event_id, ts, user_id,
         row_number() over (partition by user_id, sn order by ts, event_id) as rn,
         count(*) over (partition by user_id, sn) as cnt,
         cast(event_id as {S}) as watch_id, cast(user_id as {S}) as client_id,
         case when event_id % 97 = 0 then null
              else concat('https://site.example/', event_type, '/', cast(user_id % 5 as {S})) end as url,
         case when event_type = 'error' then null else concat(event_type, ' page') end as title
  from brk),
hits as (
  select watch_id, client_id, url, ts as datetime_hit, title from ev where event_id % 53 <> 0),
v0 as (
  select visit_id, {WATCH} as watch_ids, min(ts) as date_time, min(sn) = 1 as is_new_user,
         max(case when rn = 1 then url end) as start_url, max(case when rn = cnt then url end) as end_url,
         cast(count(*) as int) as page_views, {DUR} as visit_duration, max(client_id) as client_id
  from ev group by visit_id),
visits as (
  select v0.visit_id, watch_ids, date_time, is_new_user, start_url, end_url, page_views, visit_duration,
         case when visit_id % 11 = 0 then null else n_name end as region_city, client_id,
         case visit_id % 4 when 0 then 'google' when 1 then 'yandex' when 2 then 'bing' else null end as last_search_engine_root,
         cast(case when visit_id % 10 = 9 then 3 else 1 + visit_id % 2 end as int) as device_category,
         concat('os_', cast(visit_id % 12 as {S})) as operating_system,
         concat('browser_', cast(visit_id % 13 as {S})) as browser,
         case when visit_id % 3 = 0 then 'portrait' else 'landscape' end as screen_orientation_name,
         case when visit_id % 10 <> 9 and visit_id % 2 = 1 then concat('phone_', cast(visit_id % 3 as {S})) else '' end as mobile_phone,
         case when visit_id % 10 <> 9 and visit_id % 2 = 1 then concat('model_', cast(visit_id % 7 as {S})) else '' end as mobile_phone_model,
         case when visit_id % 17 = 0 then null when visit_id % 2 = 1 then '9:16' else '16:9' end as screen_format
  from v0 left join nation on n_nationkey = visit_id % 25)"""


def fixture_ctes(dialect: str = "duckdb") -> str:
    s = _SUBST[dialect]
    return _FIXTURE.replace("{S}", s["S"]).replace("{WATCH}", s["WATCH"]).replace("{DUR}", s["DUR"])


def with_fixture(body: str, dialect: str = "duckdb") -> str:
    """``WITH <fixture>, <body>`` where body starts with more CTEs or is a SELECT.

    ``body`` either begins with ``select`` (final query) or with ``name as (``
    (more CTEs followed by the final select).
    """
    b = body.strip()
    if b.lower().startswith("select"):
        return f"with {fixture_ctes(dialect)}\n{b}"
    return f"with {fixture_ctes(dialect)},\n{b}"


# ---------------------------------------------------------------- shared CTEs
# Each returns "name as (...)" text to chain after the fixture CTEs.

WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def ids_sql(col: str = "watch_ids", bracketed: bool = False) -> str:
    """DuckDB list of ids: split on ',', strip, drop empties (optionally unwrap [..] and quotes)."""
    src = col
    if bracketed:
        src = (f"regexp_replace(regexp_replace({strip_sql(col)}, '^\\[|\\]$', '', 'g'), "
               "'[''\"]', '', 'g')")
    return f"list_filter(list_transform(string_split({src}, ','), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def periods_sql(periods) -> str:
    vals = ", ".join(f"({i + 1}, '{v}', timestamp '{s}', timestamp '{e}')"
                     for i, (v, s, e) in enumerate(periods))
    return (f"periods as (select * from (values {vals}) "
            "p(release_ord, version, period_start, period_end))")


RELEASE_CTES = """tv as (
  select v.*, p.release_ord, p.version from visits v
  join periods p on v.date_time between p.period_start and p.period_end),
br0 as (select visit_id, release_ord, {IDS} as ids from tv),
br as (select visit_id, release_ord, unnest(generate_series(1, len(ids))) as pos, unnest(ids) as watch_id
       from br0),
rh as (select h.*, i.release_ord from (select distinct release_ord, watch_id from br) i join hits h using (watch_id)),
pr as (select br.release_ord, br.visit_id, br.pos, br.watch_id, h.url, h.datetime_hit, h.title,
              h.client_id as hit_client_id from br join hits h using (watch_id)),
tot as (select p.release_ord, p.version, coalesce(x.n, 0) as total_visits
        from periods p left join (select release_ord, count(*) as n from tv group by 1) x using (release_ord))"""


def release_ctes(periods) -> str:
    return periods_sql(periods) + ",\n" + RELEASE_CTES.replace("{IDS}", ids_sql())


VISIT_TEXT_COLS = ["start_url", "end_url", "region_city", "client_id", "last_search_engine_root", "operating_system",
                   "browser", "screen_orientation_name", "mobile_phone", "mobile_phone_model", "screen_format"]
VISIT_OTHER_COLS = ["date_time", "is_new_user", "start_url", "end_url", "page_views",
                    "visit_duration", "region_city", "client_id", "last_search_engine_root",
                    "device_category", "operating_system", "browser", "screen_orientation_name",
                    "mobile_phone", "mobile_phone_model", "screen_format"]


def joined_ctes() -> str:
    """``ex`` = exploded visits (bracket-tolerant parse), ``jn`` = inner join with hits."""
    others = ", ".join(VISIT_OTHER_COLS)
    ex_others = ", ".join(c if c != "client_id" else "client_id as client_id_visit"
                          for c in VISIT_OTHER_COLS)
    return f"""ex0 as (select visit_id, {others}, {ids_sql(bracketed=True)} as ids from visits),
ex as (select visit_id, unnest(generate_series(1, len(ids))) as pos, unnest(ids) as watch_id, {others}
       from ex0),
jn as (select ex.visit_id, ex.pos, ex.watch_id, {ex_others.replace('client_id as client_id_visit', 'ex.client_id as client_id_visit')},
              h.client_id as client_id_hit, h.url, h.datetime_hit, h.title
       from ex join hits h on ex.watch_id = h.watch_id)"""
