"""Sinks: materialised tables (Parquet, partitioned), CSV, JSON documents,
catalog tables. Paths default to sub-folders of the shared checkpoint folder
(``spark.checkpoint.dir``), never to a machine-local folder on a cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navlens.session import scratch_path
from navlens.sources.readers import HIT_CSV_COLUMNS


def write_parquet(df: DataFrame, path: str | None = None, partition_by: Sequence[str] = (),
                  name: str = "table") -> str:
    """Overwrite a Parquet table (optionally partitioned) and return its path."""
    path = path or scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_joined(joined: DataFrame, path: str | None = None) -> str:
    """The visit-hit fact table, partitioned by visit day (enables pruning)."""
    return write_parquet(joined.withColumn("visit_date", F.to_date("date_time")), path,
                         ["visit_date"], name="joined")


def write_hits_csv(hits: DataFrame, path: str | None = None) -> str:
    """Hits as a header CSV with the export's column names."""
    path = path or scratch_path(hits.sparkSession, "hits-csv")
    inv = {v: k for k, v in HIT_CSV_COLUMNS.items()}
    out = hits.select(*[(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if c == "datetime_hit" else F.col(c))
                        .alias(inv[c]) for c in HIT_CSV_COLUMNS.values()])
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str | None = None, name: str = "json") -> str:
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").json(path)
    return path


def save_table(df: DataFrame, name: str, path: str | None = None) -> str:
    """Drop-and-reload of a catalog table: overwrite, stored at ``path``."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    return name


def write_visits_csv(visits: DataFrame, path: str | None = None) -> str:
    """Visits in the CSV export layout: one row per listed hit id (one without
    an id for a visit that lists none), the visit's other columns repeated,
    plus an explicit ``rowNo`` ordinal."""
    from navlens.operators.linkage import explode_visits
    from navlens.sources.readers import VISIT_CSV_COLUMNS
    path = path or scratch_path(visits.sparkSession, "visits-csv")
    rows = explode_visits(visits, bracketed=False, outer=True)
    inv = {v: k for k, v in VISIT_CSV_COLUMNS.items()}
    fmt = {"date_time": F.date_format("date_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
           "is_new_user": F.when(F.col("is_new_user"), "True").otherwise("False")}
    out = rows.select(*[fmt.get(c, F.col(c)).cast("string").alias(inv[c]) for c in VISIT_CSV_COLUMNS.values()],
                      # file-row ordinal: explode keeps a visit's rows adjacent and in list order
                      F.monotonically_increasing_id().cast("string").alias("rowNo"))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_export(visits: DataFrame, hits: DataFrame, visits_path: str, hits_path: str, brackets: bool = True) -> None:
    """Visits and hits as an export: prefixed export names, ids in brackets, times as text."""
    from navlens.sources.datasets import HIT_EXPORT, VISIT_EXPORT
    from navlens.sources.readers import HIT_PREFIX, VISIT_PREFIX

    def renamed(df: DataFrame, names: dict[str, str], prefix: str) -> DataFrame:
        back = {c: n for n, c in names.items() if c in df.columns}
        return df.select(*[F.col(c).alias(f"{prefix}{n}") for c, n in back.items()])

    def text(c: str):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")

    if brackets:
        visits = visits.withColumn("watch_ids", F.concat(F.lit("["), F.col("watch_ids"), F.lit("]")))
    renamed(visits.withColumn("date_time", text("date_time")), VISIT_EXPORT, VISIT_PREFIX).write.parquet(visits_path)
    renamed(hits.withColumn("datetime_hit", text("datetime_hit")), HIT_EXPORT, HIT_PREFIX).write.parquet(hits_path)
