"""Analysis-report text operators as Spark jobs over a text column.

The reference splits one report into named sections in Python. Here the same
rule runs over a whole table of texts, inside the row: a text is split in
lines, header lines are classified with one regex, and each section is the
slice of lines up to the next header. No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navlens.functions.text import SUMMARY_FALLBACK_CHARS, header_section, py_strip


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _named_sections(text: Column) -> Column:
    """Array of (section, content) of one text; NULL when it has no section but ``main``."""
    def of_lines(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda line, i: F.struct(
            (i + 1).alias("at"), header_section(line).alias("section"))), lambda h: h["section"].isNotNull())

        def of_starts(starts: Column) -> Column:  # at: number of the header line; 0 before the first line
            spans = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.struct(
                a["section"].alias("section"), a["at"].alias("at"),
                (F.coalesce(b["at"], F.size(lines) + 1) - a["at"] - 1).alias("n")))
            return _let(F.filter(spans, lambda s: s["n"] > 0), of_filled)

        def of_filled(spans: Column) -> Column:  # a repeated section keeps its last occurrence
            last = F.filter(spans, lambda s, i: ~F.exists(
                F.slice(spans, i + 2, F.size(spans)), lambda x: x["section"] == s["section"]))
            rows = F.transform(last, lambda s: F.struct(s["section"].alias("section"), py_strip(
                F.array_join(F.slice(lines, s["at"] + 1, s["n"]), "\n")).alias("content")))
            return F.when(F.exists(spans, lambda s: s["section"] != "main"), rows)

        main = F.array(F.struct(F.lit(0).alias("at"), F.lit("main").alias("section")))
        return _let(F.concat(main, heads), of_starts)

    return _let(F.split(text, "\n"), of_lines)


def text_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, section, content)`` for every document.

    Text before the first header is ``main``; a header line opens its section
    and is itself dropped; a section is kept only if at least one line follows
    its header, and a repeated section keeps its last occurrence. A document
    with no section other than ``main`` yields one ``full_text`` row holding
    the original text.
    """
    whole = F.array(F.struct(F.lit("full_text").alias("section"), F.col(text).alias("content")))
    return docs.select(key, F.inline(F.coalesce(_named_sections(F.col(text)), whole)))


def text_summary(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Summary pick: ``summary``, else ``conclusions``, else the first 500
    characters of ``full_text`` (an empty string falls through)."""
    g = sections.groupBy(key).agg(
        F.max(F.when(F.col("section") == "summary", F.col("content"))).alias("_s"),
        F.max(F.when(F.col("section") == "conclusions", F.col("content"))).alias("_c"),
        F.max(F.when(F.col("section") == "full_text", F.col("content"))).alias("_f"))
    return g.select(key, F.coalesce(F.when(F.col("_s") != "", F.col("_s")),
                                    F.when(F.col("_c") != "", F.col("_c")),
                                    F.substring(F.coalesce(F.col("_f"), F.lit("")), 1,
                                                SUMMARY_FALLBACK_CHARS)).alias("summary"))
