"""Hit-id list parsing and id normalisation as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The ASCII whitespace that Python's str.strip() removes.
STRIP_CHARS = " \t\n\r\x0b\x0c"


def strip_ws(c: Column) -> Column:
    """``str.strip()`` for ASCII whitespace: a character-set trim, no regex."""
    return F.trim(c, F.lit(STRIP_CHARS))


def split_id_list(c: Column | str) -> Column:
    """``"a, b,,c"`` -> ``[a, b, c]``: split on ``,``, strip, drop empty parts.

    NULL or empty text gives NULL / an empty array (no ids either way).
    """
    parts = F.transform(F.split(_col(c), ","), strip_ws)
    return F.filter(parts, lambda x: x != "")


def parse_id_list(c: Column | str) -> Column:
    """Parse an id list in any of its stored encodings.

    Accepts ``1,2``, ``[1,2]``, ``["1","2"]``, ``['1', '2']``, ``[abc,def]``,
    ``7``, ``[]`` and empty text: outer brackets are stripped and both quote
    kinds removed before :func:`split_id_list`. One expression instead of a
    JSON -> literal -> strip fallback cascade.
    """
    body = F.regexp_replace(strip_ws(_col(c)), r"^\[|\]$", "")
    return split_id_list(F.regexp_replace(body, "['\"]", ""))


# 2^60: splits whole doubles in two exact parts.
_LIMB = 1 << 60


def _whole_text(x: Column) -> Column:
    """A double truncated to a whole number, in plain digits, exact below 2^123 (NULL beyond, and for NaN).

    Doubles below 2^63 fit a bigint. Larger ones are whole; dividing by 2^60 is exact, and so are both limbs.
    """
    high = F.floor(F.abs(x) / F.lit(float(_LIMB)))
    low = (F.abs(x) - high.cast("double") * F.lit(float(_LIMB))).cast("bigint")
    big = (high.cast("decimal(19,0)") * F.lit(_LIMB).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("string")
    return (F.when(F.abs(x) < F.lit(float(1 << 63)), x.cast("bigint").cast("string"))
             .when(F.abs(x) < F.lit(float(1 << 123)), F.when(x < 0, F.concat(F.lit("-"), big)).otherwise(big)))


def normalize_id(c: Column | str) -> Column:
    """Canonical text of a hit id.

    Text in scientific notation (``e+`` / ``e-``, any case) and ids of a
    floating-point column become the whole number that the double holds;
    anything else is trimmed and stripped of quotes, so whole numbers never go
    through a double. Text that is no number, and doubles of 2^123 and more,
    stay as they are.
    """
    col = _col(c)
    s = col.cast("string")
    floating = F.typeof(col).isin("double", "float")  # a constant of the plan
    sci = s.rlike("(?i)e[+-]")
    number = F.when(floating, s.try_cast("double")).when(sci, s.try_cast("double"))
    return (F.when(floating | sci, F.coalesce(_whole_text(number), s))
             .otherwise(F.regexp_replace(strip_ws(s), "['\"]", "")))
