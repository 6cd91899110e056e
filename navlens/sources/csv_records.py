"""Parallel reader of quoted CSV whose records may hold line breaks, each file by its own header.

A quoted field may go over several lines, so a split in the middle of a file
does not know whether it starts inside quotes. Reading is therefore two passes
over lines, both parallel over byte ranges of the files:

1. every range counts its quotes. An even number of quotes before a range (a
   running sum over the ranges of the file, one short row each) means that it
   starts outside quotes. The same pass brings each file's first line, its header;
2. lines are put together to records inside their range. What a range begins or
   ends in mid-record is a fragment; fragments are joined in file order.

Records are parsed by Spark's own CSV parser and brought to the asked columns by
the header of the file that they stand in. Where no line of the input has an odd
number of quotes, which pass 1 tells, every line is a record and the second pass
is the parse alone, without Python.

Cases: empty files and files with a header only give no rows; blank lines are
no records; a line equal to its file's header is a header wherever it stands
(exports put one after the other); a byte order mark in front of the header and
carriage returns at the end of a record go;
short records are filled with NULL; columns that a file lacks are NULL, further
columns are ignored, of two columns of one name the last counts; a quote that is
never closed makes the rest of its file one record; a header that goes over
several lines raises.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most different headers in one input: each is a branch of the parse expression.
MAX_LAYOUTS = 200
#: Most byte ranges, which are sent to every task (some 150 bytes each). 1,000,000 of 128 MB are 128 TB.
MAX_RANGES = 1_000_000
_OPTIONS = {"sep": ",", "quote": '"', "escape": '"'}
_RECORD = "file string, block long, seq long, kind int, record string"
WHOLE, HEAD, REST = 0, 1, 2


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("record"))


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _ranges(lines: DataFrame) -> DataFrame:
    """One row a byte range: whether it starts inside quotes, whether a line of it has an odd number, the header."""
    n = _quotes(F.col("record"))
    per = lines.groupBy("file", "block", "length").agg(
        F.sum(n).alias("quotes"), F.max(n % 2).alias("odd"),
        F.min(F.when(F.col("block") == 0, F.struct("seq", "record"))).alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("file", "block", "length", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
                      (F.col("odd") == 1).alias("odd"), F.col("first.record").alias("header"))


def _records_of_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of byte ranges, each in order, to records (WHOLE) and fragments (HEAD: goes on in the next range, REST)."""
    at, open_, start, kind, inside = None, [], 0, WHOLE, False
    out: list[tuple] = []

    def close(kind: int) -> None:
        out.append((*at, start, kind, "\n".join(open_)))
        open_.clear()

    for batch in batches:
        for file, block, seq, line, begins in zip(*(batch[c].tolist() for c in ("file", "block", "seq", "record", "inside"))):
            if at != (file, block):
                if open_:
                    close(HEAD if kind == WHOLE else REST)
                if begins is None:
                    raise RuntimeError(f"{file} is cut at other places than when its quotes were counted: read it again")
                at, inside, kind = (file, block), begins, REST if begins else WHOLE
            if not open_:
                start = seq
            open_.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                close(kind)
                kind = WHOLE
        yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "record"])
        out.clear()
    if open_:
        close(HEAD if kind == WHOLE else REST)
        yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "record"])


def _stitched(fragments: DataFrame) -> DataFrame:
    """Fragments in file order, each HEAD with the RESTs behind it: at most two fragments a byte range."""
    upto = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = fragments.withColumn("n", F.sum((F.col("kind") == HEAD).cast("int")).over(upto))
    pieces = F.array_sort(F.collect_list(F.struct("block", "seq", "record")))
    return numbered.groupBy("file", "n").agg(pieces.alias("p")).select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"),
        F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))


def csv_records(lines: DataFrame, ranges: DataFrame, odd: bool) -> DataFrame:
    """``(file, record)`` rows with block and seq; odd: a record may be several lines."""
    if not odd:
        return lines.drop("length")
    starts = F.broadcast(ranges.select("file", "block", "length", "inside"))
    found = lines.join(starts, ["file", "block", "length"], "left").mapInPandas(_records_of_lines, _RECORD)
    return found.where(f"kind = {WHOLE}").drop("kind").unionByName(_stitched(found.where(f"kind != {WHOLE}")))


def _places(header: str) -> dict[str, int]:
    """Column names of a header and where they stand."""
    if header.count('"') % 2:
        raise ValueError(f"the header goes over several lines: {header!r}")
    return {n: i for i, n in enumerate(next(csv.reader([header.lstrip("\ufeff").rstrip("\r")]), []))}


def _named(name: str, layouts: dict[str, dict[str, int]]) -> Column:
    """A column of a parsed record by its header's place for it."""
    def at(places):
        return F.col(f"c{places[name]}") if name in places else F.lit(None).cast("string")
    (_, first), *others = layouts.items()
    out = at(first)
    for header, places in others:
        out = F.when(F.col("header") == header, at(places)).otherwise(out)
    return out.alias(name)


def read_csv_columns(spark: SparkSession, path, names: Sequence[str]) -> DataFrame:
    """Text columns ``names`` of header CSV files and ``_order``, which sorts rows as they stand in the files."""
    lines = _lines(spark, path)
    ranges = _ranges(lines)
    facts = ranges.agg(F.max("odd").alias("odd"), F.count(F.lit(1)).alias("n")).first()
    if facts.n > MAX_RANGES:
        raise ValueError(f"{facts.n} byte ranges are too many to send to every task: raise spark.sql.files.maxPartitionBytes")
    headers = ranges.where("header is not null").select("file", "header")
    layouts = [r[0] for r in headers.select("header").distinct().limit(MAX_LAYOUTS + 1).collect()]
    if len(layouts) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers in {path}")
    if not layouts:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names)
                                     + ", _order struct<file:string,block:long,seq:long>")
    rows = csv_records(lines, ranges, bool(facts.odd))
    if len(layouts) == 1:
        rows = rows.withColumn("header", F.lit(layouts[0]))
    else:  # a row a file, of which there are no more than ranges
        rows = rows.join(F.broadcast(headers), "file")
    record = F.rtrim(F.col("record"), F.lit("\r"))
    by_header = {header: _places(header) for header in layouts}
    width = 1 + max((i for places in by_header.values() for i in places.values()), default=0)
    # a generator's output: taken straight from from_csv, each column would parse the record anew
    fields = F.from_csv(record, F.lit(", ".join(f"c{i} string" for i in range(width))), _OPTIONS)
    parsed = rows.where((record != "") & (F.col("record") != F.col("header"))).select(
        F.inline(F.array(fields)), "header", F.struct("file", "block", "seq").alias("_order"))
    return parsed.select(*[_named(n, by_header) for n in names], "_order")
