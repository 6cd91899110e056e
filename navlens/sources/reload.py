"""Reload of several tables as one step: stage, validate, switch.

The tables of a load are written into a folder of their own. Only when all are
written, read back and valid does one small file, the manifest, make them the
current load; it is created under its final name in one step, which either
happens or not. Readers take the newest manifest, so they see the tables of one
load together, the old ones until the new ones are all there. A load that fails
leaves files nobody refers to; running it again writes a new folder.

Old loads stay until :func:`drop_old_loads`, so queries that began on them end
on them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Check = Callable[[DataFrame], str | None]


class ReloadError(ValueError):
    """A staged table is not valid; the current load is as it was."""


def unique_key(*columns: str) -> Check:
    """No two rows of one key, and none without it."""
    def check(df: DataFrame) -> str | None:
        missing = df.where(" or ".join(f"`{c}` is null" for c in columns)).limit(1).count()
        twice = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        return f"rows without {columns}" if missing else f"rows with the same {columns}" if twice else None
    return check


def not_empty(df: DataFrame) -> str | None:
    return None if df.limit(1).count() else "no rows"


class TableSet:
    """Tables that are loaded and read together, under one folder of the shared store."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    @property
    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the loads that became current, in order."""
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "tables": name -> {"path", "rows", "schema"}} of a load, by default the current one."""
        found = self.versions()
        if not found:
            raise ReloadError(f"nothing has been loaded into {self.base}")
        version = found[-1] if version is None else version
        stream = self._fs.open(self._path(f"manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version)["tables"][name]
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(entry["path"])

    def reload(self, tables: Mapping[str, DataFrame], checks: Mapping[str, list[Check]] | None = None) -> int:
        """Write all tables, check them as they were written, make them current; the number of the load."""
        load, entries = uuid.uuid4().hex, {}
        for name, df in tables.items():
            path = f"{self.base}/loads/{load}/{name}"
            df.write.parquet(path)
            staged = self.spark.read.schema(df.schema).parquet(path)
            wrong = [w for w in (check(staged) for check in (checks or {}).get(name, [])) if w]
            if wrong:
                raise ReloadError(f"{name}: {'; '.join(wrong)}")
            entries[name] = {"path": path, "rows": staged.count(), "schema": json.loads(df.schema.json())}
        return self._switch(entries)

    def _switch(self, entries: dict) -> int:
        """The manifest under the next number: written aside, then renamed, which fails if that number is taken."""
        version = max(self.versions(), default=0) + 1
        aside = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "tables": entries}).encode("utf-8")))
        finally:
            out.close()
        target = self._path(f"manifests/{version}.json")
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise ReloadError(f"load {version} was made by somebody else meanwhile: read it and reload")
        return version

    def drop_old_loads(self, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` loads and their manifests; the numbers that went."""
        gone = self.versions()[:-keep] if keep else self.versions()
        for version in gone:
            for entry in self.manifest(version)["tables"].values():
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(entry["path"]), True)
            self._fs.delete(self._path(f"manifests/{version}.json"), False)
        return gone
