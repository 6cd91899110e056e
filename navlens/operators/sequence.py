"""Ordered-sequence building blocks that stay balanced under key skew.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task,
which is right for all keys but the few that hold more rows than one task
should sort: a bot session, one user with a third of all rows. The helpers
count the rows of each key first (``hot_rows``). Keys up to the bound take the
plain window, in one shuffle. The rows of hotter keys are range-partitioned by
(key, order) over sampled bounds, so that they spread whatever their times are
(within one hour, all NULL, all equal with a tie), written once with the number
of their range as ``chunk``, and computed by (key, chunk); chunk edges are
stitched through a small per-chunk summary (one row a chunk, at most ``J``
values). Results are exactly those of the per-key window.

A caller that knows a good ``chunk`` of the order may pass it and skip the count.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navlens.session import scratch_path

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
#: Rows of a key up to which one task sorts it.
HOT_ROWS = 1_000_000
#: Most hot keys: they are sent to every task. 100,000 of them are at least 10^11 rows.
MAX_HOT_KEYS = 100_000
# Sentinels for rows whose time is NULL: first or last chunk of the key.
_MIN_CHUNK = -(2 ** 62)
_MAX_CHUNK = 2 ** 62


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 for a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH_NTZ}, cast({ts} as timestamp_ntz))")


def time_chunk(ts: str, chunk_seconds: int, nulls_first: bool = True) -> Column:
    """Monotone bucket of ``ts``; NULL time goes to the first (or last) chunk."""
    sentinel = _MIN_CHUNK if nulls_first else _MAX_CHUNK
    return F.coalesce(F.floor(epoch_seconds(ts) / F.lit(int(chunk_seconds))),
                      F.lit(sentinel).cast("bigint"))


def _spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Hash-partition on the key *and* the chunk.

    A window partitioned by ``(key, chunk)`` would otherwise accept input that
    is already partitioned by ``key`` alone (Spark does not require all
    clustering keys by default), and a hot key would land in one task again.
    When the input is not partitioned yet this is the window's own shuffle.
    """
    return df.repartition(*[F.col(c) for c in cols])


def split_hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int = HOT_ROWS,
                   sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with up to ``hot_rows`` rows, the other rows with a ``_nl_ck`` range number, None when there are none).

    ``sizes``, a cheaper table with the key columns and about a row per row of ``df``, may stand in for the count. The
    hot rows are written: a range is what one sampling of the bounds made it, so it must not be made again.
    """
    n = (df if sizes is None else sizes).groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl_n"))
    hot = n.filter(F.col("_nl_n") > hot_rows).select(*keys).limit(MAX_HOT_KEYS + 1).collect()
    if not hot:
        return df, None
    if len(hot) > MAX_HOT_KEYS:
        raise ValueError(f"more than {MAX_HOT_KEYS} keys with over {hot_rows} rows: raise hot_rows")
    spark = df.sparkSession
    found = spark.createDataFrame(hot, df.select(*keys).schema).toDF(*[f"_nl_h{i}" for i in range(len(keys))])
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_nl_h{i}")) for i, k in enumerate(keys)])
    path = scratch_path(spark, "hot-keys")
    ranged = (df.join(F.broadcast(found), same, "left_semi").repartitionByRange(*[F.col(k) for k in keys], *order)
                .withColumn("_nl_ck", F.spark_partition_id().cast("bigint")))
    ranged.write.parquet(path)
    return df.join(F.broadcast(found), same, "left_anti"), spark.read.schema(ranged.schema).parquet(path)


def _with_summary(d: DataFrame, summ: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``d`` with its chunk's summary; a NULL key is a key like others."""
    renamed = summ.select(*[F.col(k).alias(f"_nl_s{i}") if k in keys else F.col(k)
                            for i, k in enumerate(summ.columns)])
    at = {k: f"_nl_s{summ.columns.index(k)}" for k in keys}
    return d.join(renamed, functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in at.items()]))


def session_numbers(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int,
                    chunk_seconds: int | None = None, out: str = "sn", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the sessions of each ``key`` (1, 2, ...) by an inactivity gap.

    A new session starts at the first row of a key and wherever
    ``ts > previous ts + gap``; rows are ordered by ``(ts, tie)``. For hot keys
    ``sum(is_start) over (partition by key order by ts, tie)`` is computed per
    ``(key, chunk)`` plus a running offset over the chunk summary, so a hot key
    is spread over many tasks. ``ts`` must not be NULL.
    """
    gap = F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    if chunk_seconds is not None:
        return _chunked_sessions(df.select("*", time_chunk(ts, chunk_seconds).alias("_nl_ck")), key, ts, tie, gap, out)
    plain, hot = split_hot_keys(df, [key], [F.col(ts), F.col(tie)], hot_rows)
    done = plain_session_numbers(plain, key, ts, tie, gap_seconds, out)
    return done if hot is None else done.unionByName(_chunked_sessions(hot, key, ts, tie, gap, out))


def plain_session_numbers(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int, out: str = "sn") -> DataFrame:
    """:func:`session_numbers` of keys that a task can sort: one window, which leaves the rows partitioned by key."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    is_start = F.when(F.col(ts) <= F.lag(ts).over(w) + gap, 0).otherwise(1)
    return df.select("*", is_start.alias("_nl_brk")).select(
        *df.columns, F.sum("_nl_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias(out))


def _chunked_sessions(d: DataFrame, key: str, ts: str, tie: str, gap: Column, out: str) -> DataFrame:
    ck = "_nl_ck"
    cols = [c for c in d.columns if c != ck]
    w = Window.partitionBy(key, ck).orderBy(ts, tie)
    d = _spread(d, [key, ck])
    prev = F.lag(ts).over(w)
    # breaks inside the chunk; the first row's break is settled by the summary
    d = d.select("*", F.when(prev.isNull(), 0).when(F.col(ts) <= prev + gap, 0).otherwise(1).alias("_nl_brk"))
    d = d.select("*", F.sum("_nl_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                 .alias("_nl_cum"))
    summ = d.groupBy(key, ck).agg(F.min(ts).alias("_nl_first"), F.max(ts).alias("_nl_last"),
                                  F.sum("_nl_brk").alias("_nl_nb"))
    wk = Window.partitionBy(key).orderBy(ck)
    plast = F.lag("_nl_last").over(wk)
    fb = F.when(plast.isNull() | (F.col("_nl_first") > plast + gap), 1).otherwise(0)
    summ = summ.select(key, ck, "_nl_nb", fb.alias("_nl_fb"))
    before = F.sum(F.col("_nl_fb") + F.col("_nl_nb")).over(wk.rowsBetween(Window.unboundedPreceding, -1))
    summ = summ.select(key, ck, (F.coalesce(before, F.lit(0)) + F.col("_nl_fb")).alias("_nl_base"))
    return _with_summary(d, summ, [key, ck]).select(
        *cols, (F.col("_nl_base") + F.col("_nl_cum")).cast("int").alias(out))


def with_neighbors(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], chunk: Column | None,
                   value: str, leads: Sequence[int] = (), lags: Sequence[int] = (),
                   prefix: str = "", hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Attach ``lead(value, j)`` / ``lag(value, j)`` within ``key`` in ``order``.

    A given ``chunk`` must be non-decreasing along ``order`` (see :func:`time_chunk`);
    without one, keys are split by size (see :func:`split_hot_keys`).
    Output columns are ``{prefix}next{j}`` and ``{prefix}prev{j}``; NULL means
    there is no such row. ``value`` is expected non-NULL (callers drop or
    coalesce NULL values first), so NULL is unambiguous.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if chunk is not None:
        return _chunked_neighbors(df.select("*", chunk.alias("_nl_ck")), keys, order, value, leads, lags, prefix)
    plain, hot = split_hot_keys(df, keys, order, hot_rows, sizes)
    w = Window.partitionBy(*keys).orderBy(*order)
    done = plain.select("*", *[F.lead(value, j).over(w).alias(f"{prefix}next{j}") for j in leads],
                        *[F.lag(value, j).over(w).alias(f"{prefix}prev{j}") for j in lags])
    return done if hot is None else done.unionByName(
        _chunked_neighbors(hot, keys, order, value, leads, lags, prefix))


def _chunked_neighbors(d: DataFrame, keys: list[str], order: Sequence[Column], value: str, leads: Sequence[int],
                       lags: Sequence[int], prefix: str) -> DataFrame:
    ck, rn, cnt = "_nl_ck", "_nb_rn", "_nb_cnt"
    cols = [c for c in d.columns if c != ck]
    span = max(list(leads) + list(lags) + [1])
    w = Window.partitionBy(*keys, ck).orderBy(*order)
    d = _spread(d, [*keys, ck])
    d = d.select("*", F.row_number().over(w).alias(rn),
                 F.count(F.lit(1)).over(Window.partitionBy(*keys, ck)).alias(cnt),
                 *[F.lead(value, j).over(w).alias(f"_nb_ld{j}") for j in leads],
                 *[F.lag(value, j).over(w).alias(f"_nb_lg{j}") for j in lags])

    # first and last `span` values of every chunk: bounded arrays
    def ends(cond: Column) -> Column:
        picked = F.sort_array(F.collect_list(F.when(cond, F.struct(F.col(rn), F.col(value)))))
        return F.transform(picked, lambda s: s[value])

    summ = (d.filter((F.col(rn) <= span) | (F.col(rn) > F.col(cnt) - span))
             .groupBy(*keys, ck)
             .agg(ends(F.col(rn) <= span).alias("_nb_head"),
                  ends(F.col(rn) > F.col(cnt) - span).alias("_nb_tail")))
    wk = Window.partitionBy(*keys).orderBy(ck)

    def gathered(col: str, lo: int, hi: int) -> Column:
        parts = F.array_sort(F.collect_list(F.struct(F.col(ck), F.col(col))).over(wk.rowsBetween(lo, hi)))
        return F.flatten(F.transform(parts, lambda s: s[col]))

    summ = summ.select(*keys, ck,
                       *([gathered("_nb_head", 1, span).alias("_nb_after")] if leads else []),
                       *([F.reverse(gathered("_nb_tail", -span, -1)).alias("_nb_before")] if lags else []))
    nxt = [F.when(F.col(rn) + j <= F.col(cnt), F.col(f"_nb_ld{j}"))
            .otherwise(F.try_element_at("_nb_after", (F.col(rn) + j - F.col(cnt)).cast("int")))
            .alias(f"{prefix}next{j}") for j in leads]
    prv = [F.when(F.col(rn) - j >= 1, F.col(f"_nb_lg{j}"))
            .otherwise(F.try_element_at("_nb_before", (F.lit(j + 1) - F.col(rn)).cast("int")))
            .alias(f"{prefix}prev{j}") for j in lags]
    return _with_summary(d, summ, [*keys, ck]).select(*cols, *nxt, *prv)


def ordinal_in_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column],
                   chunk: Column | None = None, out: str = "step", hot_rows: int = HOT_ROWS,
                   sizes: DataFrame | None = None) -> DataFrame:
    """``row_number() over (partition by key order by ...)`` without one task for a hot key.

    For hot keys: row number inside ``(key, chunk)`` plus the number of rows in
    earlier chunks of the key (a running sum over the per-chunk counts).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if chunk is not None:
        return _chunked_ordinals(df.select("*", chunk.alias("_nl_ck")), keys, order, out)
    plain, hot = split_hot_keys(df, keys, order, hot_rows, sizes)
    done = plain.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint").alias(out))
    return done if hot is None else done.unionByName(_chunked_ordinals(hot, keys, order, out))


def _chunked_ordinals(d: DataFrame, keys: list[str], order: Sequence[Column], out: str) -> DataFrame:
    ck = "_nl_ck"
    cols = [c for c in d.columns if c != ck]
    w = Window.partitionBy(*keys, ck).orderBy(*order)
    d = _spread(d, [*keys, ck])
    d = d.select("*", F.row_number().over(w).alias("_on_rn"))
    summ = d.groupBy(*keys, ck).agg(F.count(F.lit(1)).alias("_on_n"))
    wk = Window.partitionBy(*keys).orderBy(ck)
    summ = summ.select(*keys, ck, F.coalesce(F.sum("_on_n").over(
        wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_on_off"))
    return _with_summary(d, summ, [*keys, ck]).select(
        *cols, (F.col("_on_off") + F.col("_on_rn")).cast("bigint").alias(out))
