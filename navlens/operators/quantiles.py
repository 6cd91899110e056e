"""Exact quantiles of whole-number columns by rank bracketing.

``percentile`` keeps a map of all distinct values of a group in the one task
that finishes the group. Here values are counted first (one row per distinct
value, spread over tasks), the counts are summed by the value's high bits, and
a running sum over these buckets tells in which bucket each wanted rank lies;
only those buckets are looked into. A group of 32-bit values has at most 65,536
buckets, and a bucket at most 65,536 values, however many rows there are.

Quantiles are interpolated linearly between the two neighbouring ranks, as
``percentile`` does; missing values do not count; a group without values has
NULL. Larger whole numbers stay exact, with more buckets.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW_BITS = 16


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """``(*keys, q)`` per group of ``keys``: ``q`` is a struct of ``{column}_{i}`` for the i-th quantile of each column.

    All columns are done in the same passes. Groups without a value of any column are absent.
    """
    for c in wanted:
        if not isinstance(df.schema[c].dataType, T.IntegralType):
            raise TypeError(f"{c} is no whole-number column")
    names, group = list(wanted), [*keys, "_m"]
    melted = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), F.col(c).cast("long").alias("_v"))
                                                 for i, c in enumerate(names)]))).where("_v is not null")
    counts = (melted.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_b", F.shiftright("_v", LOW_BITS)))
    ordered = Window.partitionBy(*group).orderBy("_b")
    sums = counts.groupBy(*group, "_b").agg(F.sum("_n").alias("_s")).select(
        *group, "_b", "_s", F.sum("_s").over(ordered).alias("_upto"), F.sum("_s").over(Window.partitionBy(*group)).alias("_all"))

    def ranks(m: int) -> Column:
        """(quantile, its position, a rank next to it) for each quantile of a column."""
        out = []
        for k, q in enumerate(wanted[names[m]]):
            place = F.lit(float(q)) * (F.col("_all") - 1)
            out += [F.struct(F.lit(k).alias("k"), place.alias("place"), side(place).cast("long").alias("rank"))
                    for side in (F.floor, F.ceil)]
        return F.array(*out)

    of_column = F.lit(None)
    for m in range(len(names)):
        of_column = F.when(F.col("_m") == m, ranks(m)) if m == 0 else of_column.when(F.col("_m") == m, ranks(m))
    start = F.col("_upto") - F.col("_s")
    hit = sums.select(*group, "_b", start.alias("_start"), F.filter(
        of_column, lambda r: (r["rank"] >= start) & (r["rank"] < F.col("_upto"))).alias("_r")).where(F.size("_r") > 0)
    inside = Window.partitionBy(*group, "_b").orderBy("_v")
    at = [*group, "_b"]
    hit = hit.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(at)], "_start", "_r")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(at)])
    found = (counts.join(hit, same)  # at most a bucket per wanted rank; a NULL key is a group too
             .withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))
             .select(*group, "_v", F.explode(F.filter("_r", lambda r: (r["rank"] < F.col("_upto"))
                                                      & (r["rank"] >= F.col("_upto") - F.col("_n")))).alias("r")))
    fields = []
    for m, c in enumerate(names):
        for k in range(len(wanted[c])):
            mine = (F.col("_m") == m) & (F.col("r.k") == k)
            low, high = F.min(F.when(mine, F.col("_v"))), F.max(F.when(mine, F.col("_v")))
            place = F.max(F.when(mine, F.col("r.place")))
            between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
            fields.append(F.when(low == high, low.cast("double")).otherwise(between).alias(f"{c}_{k}"))
    return found.groupBy(*keys).agg(F.struct(*fields).alias("q"))


def quantile_row(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> Column:
    """The struct of :func:`exact_quantiles` over all rows, as a scalar to use in another query's select."""
    return exact_quantiles(df, [], wanted).select("q").scalar()
