"""Scalar rules shared by the operators, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c: Column | str) -> Column:
    """Truthiness of a string: not NULL and not ``''``."""
    c = _col(c)
    return c.isNotNull() & (c != "")


def nonempty_or_null(c: Column | str) -> Column:
    """The value when non-empty, else NULL (so count/distinct skip it)."""
    c = _col(c)
    return F.when(c != "", c)


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def py_round(c: Column | str, digits: int) -> Column:
    """Python ``round(x, n)``: half-to-even. Use ``round_even`` in DuckDB."""
    return F.bround(_col(c).cast("double"), digits)


def trunc_int(c: Column | str) -> Column:
    """Python ``int(x)`` of a float: truncation toward zero."""
    return _col(c).cast("double").cast("int")


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` when ``den > 0`` else ``default`` (the reference's guard)."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(default))


def pct_of(num: Column, den: Column, digits: int = 1) -> Column:
    """``round(num / den * 100, digits)``, 0 when ``den`` is 0."""
    return F.when(den > 0, py_round(num.cast("double") / den * 100, digits)).otherwise(F.lit(0.0))


def pct_change(old: Column, new: Column) -> Column:
    """``(new - old) / old * 100`` guarded by ``old > 0`` (else 0)."""
    return F.when(old > 0, (new - old).cast("double") / old * 100).otherwise(F.lit(0.0))


def url_leaf(url: Column | str, default: str = "Page") -> Column:
    """Last ``/``-separated segment of a URL, or ``default`` when empty."""
    leaf = F.element_at(F.split(_col(url), "/"), -1)
    return F.coalesce(F.when(leaf != "", leaf), F.lit(default))


# Spellings accepted as true by the CSV boolean parser.
TRUE_SPELLINGS = ["1", "True", "true", "TRUE"]


def parse_bool(c: Column | str) -> Column:
    """``1 / True / true / TRUE`` -> true; anything else (NULL too) -> false."""
    return F.coalesce(_col(c).isin(*TRUE_SPELLINGS), F.lit(False))


def parse_int(c: Column | str) -> Column:
    """Integer through float, truncating; bad or empty text -> NULL."""
    s = F.trim(_col(c).cast("string"))
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


def parse_datetime(c: Column | str) -> Column:
    """ISO date, or date-time with a space or ``T``; bad, partial or empty text -> NULL (naive)."""
    s = F.regexp_replace(F.trim(_col(c).cast("string")), "T", " ")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp_ntz"))
