"""Column helpers that several operators of this package share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from navlens.session import checkpoint_dir

# The white space that ends a word, the class of word characters, ASCII letters.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression that a lambda captures is computed again for every element;
    bound as a lambda variable it is computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null and empty texts have none."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back: cuts lineage, survives lost executors."""
    spark: SparkSession = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    gc.collect()  # plans of earlier rounds that only Python's reference cycles hold in the driver
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of a batch of rows for a Python worker in the session, unless it names a smaller bound in bytes.

    A task holds several copies of a batch, the JVM's and the worker's.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting).removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(setting, str(most))


def text_partitions(df: DataFrame, floor: int = 12) -> int:
    """Partitions for a shuffle that follows ``spark.sql.shuffle.partitions``, ``floor`` at least."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def send_state(spark: SparkSession, value):
    """Broadcast of an object's attributes (plain data and arrays); tasks rebuild the object with ``from_state``."""
    return spark.sparkContext.broadcast(vars(value))


def from_state(cls, state: dict):
    out = cls.__new__(cls)
    out.__dict__.update(state)
    return out
