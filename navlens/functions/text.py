"""Text rules for the analysis-report operators (escape decoding, headers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section names and the header titles (ru / en) that open them,
# in matching order — the first section whose titles fit a header line wins.
SECTION_TITLES = [
    ("summary", ["Резюме", "Summary", "Краткое описание"]),
    ("problems", ["Проблемы", "Problems", "Issues", "Выявленные проблемы"]),
    ("recommendations", ["Рекомендации", "Recommendations", "Предложения"]),
    ("key_changes", ["Ключевые изменения", "Key Changes", "Изменения"]),
    ("navigation", ["Навигация", "Navigation", "Паттерны навигации"]),
    ("ux_issues", ["UX проблемы", "UX Issues", "UX Problems"]),
    ("conclusions", ["Выводы", "Conclusions", "Заключение"]),
]
SUMMARY_FALLBACK_CHARS = 500


def header_section(line: Column) -> Column:
    """Section name a line opens, or NULL when it is not a header line.

    One regex pass per line: the title right after the ``#`` marks is
    extracted with a single alternation and mapped (lower-cased) to its
    section. Titles are anchored at the same place and no title of one
    section is a prefix of another section's title, so this equals testing
    the sections one by one in order.
    """
    titles = [t for _, ts in SECTION_TITLES for t in ts]
    found = F.regexp_extract(line, "(?iuU)^#+\\s*(" + "|".join(titles) + ")", 1)
    lookup = F.create_map(*[x for name, ts in SECTION_TITLES for t in ts for x in (F.lit(t.lower()), F.lit(name))])
    return F.when(found != "", F.element_at(lookup, F.lower(found)))


def py_strip(c: Column) -> Column:
    """``str.strip()``: drop leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


ESCAPE_RUN = r"(?:\\u[0-9a-fA-F]{4})+"
_TOKENS = ESCAPE_RUN + r"|(?:(?!\\u[0-9a-fA-F]{4})[\s\S])+"


def decode_escapes(c: Column) -> Column:
    r"""Replace every ``\uXXXX`` escape by its character, keep the rest.

    The text is cut into alternating tokens (runs of escapes / plain text); a
    run is decoded as UTF-16BE in one piece, so surrogate pairs join into one
    character. A native expression — no Python per row.
    """
    toks = F.regexp_extract_all(c, F.lit(_TOKENS), 0)

    def one(t: Column) -> Column:
        hexes = F.regexp_replace(t, r"\\u", "")
        return F.when(t.rlike("^" + ESCAPE_RUN + "$"), F.decode(F.unhex(hexes), "UTF-16BE")).otherwise(t)

    return F.when(c.isNull(), c).otherwise(F.array_join(F.transform(toks, one), ""))


def escape_non_ascii(c: Column) -> Column:
    r"""Inverse helper: every non-ASCII character as ``\uXXXX`` (pairs for astral ones)."""
    chars = F.regexp_extract_all(c, F.lit(r"(?s)."), 0)

    def one(ch: Column) -> Column:
        h = F.hex(F.encode(ch, "UTF-16BE"))
        esc = F.when(F.length(h) == 8, F.concat(F.lit("\\u"), F.substring(h, 1, 4), F.lit("\\u"),
                                                 F.substring(h, 5, 4))) \
               .otherwise(F.concat(F.lit("\\u"), h))
        return F.when(F.ascii(ch) > 127, esc).otherwise(ch)

    return F.array_join(F.transform(chars, one), "")
