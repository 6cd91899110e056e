"""Object-store snapshot difference (J11) as a full outer join of two listings.

A listing is a DataFrame ``(path, version)`` (modification time or ETag),
never a driver-side map, so two listings of any size diff in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, status, old_version, new_version)``; status is ``new``,
    ``deleted``, ``modified`` or ``not_modified`` (versions compared NULL-safe)."""
    o = old.select("path", F.col("version").alias("old_version"), F.lit(True).alias("_o"))
    n = new.select("path", F.col("version").alias("new_version"), F.lit(True).alias("_n"))
    j = o.join(n, "path", "full_outer")
    status = (F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted")
               .when(F.col("old_version").eqNullSafe(F.col("new_version")), "not_modified")
               .otherwise("modified"))
    return j.select("path", status.alias("status"), "old_version", "new_version")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
