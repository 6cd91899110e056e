"""Registry of exported datasets and their reconciliation to the library's schema.

A site version is exported as two tables, visits and hits, whose columns carry
a prefix and the export's names, in any order, in whatever types the export
used, some absent. :func:`reconcile` brings such a table to the library's
columns and types; :class:`Registry` reads the datasets by version and gives
their joined tables, and the union of all versions.

Cases: an absent column is NULL throughout; a column the library does not know
is dropped; a value that does not parse is NULL; of a prefixed and a plain
column of one name the prefixed one counts; names are matched exactly. Ids
are joined inside their dataset: the same id in two datasets is two hits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navlens.functions.scalars import parse_bool, parse_datetime, parse_int
from navlens.operators.linkage import (HIT_COLS, VISIT_COLS, hits_matching_visits, joined_table, visits_filtered_by_hits,
                                       watch_id_bridge)
from navlens.sources.csv_records import read_csv_columns
from navlens.sources.readers import HIT_CSV_COLUMNS, HIT_PREFIX, VISIT_CSV_COLUMNS, VISIT_PREFIX

# Export names -> library names. The export lists a visit's hits in one column.
VISIT_EXPORT = {n: c for n, c in VISIT_CSV_COLUMNS.items() if n != "watchID"} | {"watchIDs": "watch_ids"}
HIT_EXPORT = HIT_CSV_COLUMNS
_TYPES = {"visit_id": "long", "page_views": "int", "visit_duration": "int", "device_category": "int",
          "is_new_user": "boolean", "date_time": "timestamp_ntz", "datetime_hit": "timestamp_ntz"}


def _typed(value: Column, have: T.DataType, want: str) -> Column:
    """A column of any export type as the library's type; text is parsed by the loaders' rules."""
    if isinstance(have, T.StringType):
        if want == "boolean":
            return parse_bool(value)
        if want == "timestamp_ntz":
            return parse_datetime(value)
        return value if want == "string" else parse_int(value).cast(want)
    if want == "boolean" and isinstance(have, T.NumericType):
        return value == 1
    if want == "string" and isinstance(have, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: x.cast("string")), ",")
    if want == "string" and isinstance(have, (T.DoubleType, T.FloatType)):  # whole ids that went through a float
        return F.when(value == F.floor(value), F.floor(value).cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
    return value.try_cast(want)


def reconcile(raw: DataFrame, names: dict[str, str], columns: Sequence[str], prefix: str = "") -> DataFrame:
    """``columns`` from an export with (optionally) prefixed names: renamed, typed, absent ones NULL, others dropped."""
    have = {f.name: f.dataType for f in raw.schema}
    export = {c: n for n, c in names.items()}
    out = []
    for c in columns:
        want = _TYPES.get(c, "string")
        source = next((s for s in (f"{prefix}{export[c]}", export[c]) if s in have), None)
        value = F.lit(None).cast(want) if source is None else _typed(F.col(f"`{source}`"), have[source], want)
        out.append(value.alias(c))
    return raw.select(*out)


@dataclass(frozen=True)
class Dataset:
    """One exported version: where its two tables are and how their columns are prefixed."""

    version: str
    visits_path: str
    hits_path: str
    format: str = "parquet"            # or csv (text columns, header names)
    visit_prefix: str = VISIT_PREFIX
    hit_prefix: str = HIT_PREFIX

    def _raw(self, spark: SparkSession, path: str, names: Iterable[str], prefix: str) -> DataFrame:
        if self.format == "csv":
            return read_csv_columns(spark, path, [*(f"{prefix}{n}" for n in names), *names]).drop("_order")
        return spark.read.format(self.format).load(path)

    def visits(self, spark: SparkSession) -> DataFrame:
        raw = self._raw(spark, self.visits_path, VISIT_EXPORT, self.visit_prefix)
        if self.format == "csv":
            raw = _filled(raw, VISIT_EXPORT, self.visit_prefix)
        return reconcile(raw, VISIT_EXPORT, VISIT_COLS, self.visit_prefix)

    def hits(self, spark: SparkSession) -> DataFrame:
        raw = self._raw(spark, self.hits_path, HIT_EXPORT, self.hit_prefix)
        if self.format == "csv":
            raw = _filled(raw, HIT_EXPORT, self.hit_prefix)
        return reconcile(raw, HIT_EXPORT, HIT_COLS, self.hit_prefix)

    def joined(self, spark: SparkSession) -> DataFrame:
        """Parsed ids, hits that some visit lists, visits that some hit has, then the join: as :func:`joined_table`."""
        return joined_table(self.visits(spark), self.hits(spark))

    def matched(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(exploded visits with a hit, hits with a visit)."""
        visits, hits = self.visits(spark), self.hits(spark)
        bridge = watch_id_bridge(visits, bracketed=True)
        return visits_filtered_by_hits(bridge, hits), hits_matching_visits(hits, bridge)


def _filled(raw: DataFrame, names: Iterable[str], prefix: str) -> DataFrame:
    """Prefixed text columns, from the plain ones where the prefixed are missing."""
    return raw.select(*[F.coalesce(F.col(f"`{prefix}{n}`"), F.col(f"`{n}`")).alias(f"{prefix}{n}") if prefix
                        else F.col(f"`{n}`") for n in names])


class Registry:
    """Datasets by version, in the order in which they were added (the order of releases)."""

    def __init__(self, spark: SparkSession, datasets: Iterable[Dataset] = ()):
        self.spark, self._by_version = spark, {}
        for d in datasets:
            self.add(d)

    def add(self, dataset: Dataset) -> "Registry":
        if dataset.version in self._by_version:
            raise ValueError(f"version {dataset.version} is there already")
        self._by_version[dataset.version] = dataset
        return self

    def __getitem__(self, version: str) -> Dataset:
        return self._by_version[version]

    @property
    def versions(self) -> list[str]:
        return list(self._by_version)

    def _union(self, tables: list[DataFrame]) -> DataFrame:
        if not tables:
            raise ValueError("the registry has no dataset")
        tagged = [t.withColumn("release_ord", F.lit(k)).withColumn("version", F.lit(v))
                  for k, (v, t) in enumerate(zip(self._by_version, tables), start=1)]
        return functools.reduce(lambda a, b: a.unionByName(b), tagged)

    def visits(self) -> DataFrame:
        return self._union([d.visits(self.spark) for d in self._by_version.values()])

    def hits(self) -> DataFrame:
        return self._union([d.hits(self.spark) for d in self._by_version.values()])

    def joined(self) -> DataFrame:
        """The joined tables of all versions, with release_ord and version: input of the version comparisons."""
        return self._union([d.joined(self.spark) for d in self._by_version.values()])
