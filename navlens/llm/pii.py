"""Personal data in plain and disguised form, as spans of the source text.

Two readings of every text:

* plain: e-mail addresses, IPv4 addresses, payment cards and phone numbers as
  the patterns below find them, leftmost and without overlap per kind; a match
  that fails its check (parts, digits, Luhn) is dropped;
* deobfuscated: a chain of transducers rewrites the text, and the same
  patterns run on the result. The chain is: lookalike characters and foreign
  digits to ASCII, one for one; invisible characters out; "at" and "dot" in
  words or brackets to signs where they stand between the parts of an address;
  spelled digits and "plus" to signs, letters drawn for digits between digits
  to digits. Each transducer keeps the list of its edits, so a span found in
  the last text is carried back edit list by edit list to the code points of
  the source (``Layer.back``).

The deobfuscated spans are added to the plain ones, unless a plain span of the
same kind overlaps; plain spans always stay. A text that no transducer edits
has the same spans in both readings, so only its plain ones are looked for.

Everything happens inside one row; no shuffle.

Cases: null and empty texts have no spans; long texts are read whole, in time
in proportion to their length; repeated rows give equal results; ties: spans
are listed by start, then kind in the order of ``KINDS``; extra columns pass
through, result columns replace columns of the same name; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ["email", "ip", "card", "phone"]
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType())])
_RESULT = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# --- plain identifiers -------------------------------------------------------------------------------------------

_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match that starts inside a run of digits could also start at the run's first digit
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each "@" with a domain behind it takes the characters of a local part in front, not back into the last match."""
    floor = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield Span("email", start, m.end())
            floor = m.end()


def plain_spans(text: str) -> list[Span]:
    """Spans of all kinds by start, then kind."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        # a part may be as long as the text: compare without leading zeros before the number is made
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
            out.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(Span("phone", *m.span()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


# --- transducers --------------------------------------------------------------------------------------------------

class Layer:
    """A rewritten text and the edits that made it: (start, end) in the new text for (start, end) in the old one."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, self.new, self.old = [], [], []
        at = size = 0
        for start, end, put in edits:  # ascending, without overlap
            out += (text[at:start], put)
            size += start - at
            self.new.append((size, size + len(put)))
            self.old.append((start, end))
            size, at = size + len(put), end
        out.append(text[at:])
        self.text = "".join(out)
        self.starts = [a for a, _ in self.new]

    def _edit(self, place: int) -> tuple[bool, int, int]:
        """(inside an edit, that edit's or the last one's index, shift of untouched places after it)."""
        k = bisect_right(self.starts, place) - 1
        if k < 0:
            return False, -1, 0
        return place < self.new[k][1], k, self.old[k][1] - self.new[k][1]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the old text that became [start, end) of the new one."""
        inside, k, shift = self._edit(start)
        first = self.old[k][0] if inside else start + shift
        inside, k, shift = self._edit(end - 1)
        return first, self.old[k][1] if inside else end + shift


# Characters that look like ASCII letters, each over the letter it looks like.
_LOOKALIKE = "аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅαοινκρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ"
_LOOKS_LIKE = "aeopcyxijshdqwABEKMHOPCTXYIJSaoivkptuxABEZHIKMNOPTYXiag"
_DASHES = "‐‑‒–—―−"
_INVISIBLE = "­͏؜ᅟᅠ᠎​‌‍‎‏‪‫‬‭‮" \
             "⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
# Fixed values: "at", "dot" and the digits in English, German, French and Spanish.
_AT = "at|arroba|arobase|ät"
_DOT = "dot|punkt|point|punto"
_SPELLED = {
    "0": ["zero", "null", "zéro", "cero"], "1": ["one", "eins", "un", "uno"], "2": ["two", "zwei", "deux", "dos"],
    "3": ["three", "drei", "trois", "tres"], "4": ["four", "vier", "quatre", "cuatro"], "5": ["five", "fünf", "cinq", "cinco"],
    "6": ["six", "sechs", "seis"], "7": ["seven", "sieben", "sept", "siete"], "8": ["eight", "acht", "huit", "ocho"],
    "9": ["nine", "neun", "neuf", "nueve"]}
_DIGIT_OF = {w: d for d, ws in _SPELLED.items() for w in ws}


@cache
def _one_for_one() -> dict[str, str]:
    """Character table: lookalikes, dashes, spaces, and every character whose compatibility form or digit is one ASCII one."""
    table = dict(zip(_LOOKALIKE, _LOOKS_LIKE)) | dict.fromkeys(_DASHES, "-") | {"\u3002": "."}
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1A0)]:
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            table[c] = str(digit)
        elif len(form) == 1 and " " <= form <= "~" and form != c:
            table.setdefault(c, form)
    return table


_NOT_ASCII = re.compile(r"[^\x00-\x7F]")
_INVISIBLES = re.compile(f"[{_INVISIBLE}]+")
_BRACKET_AT = re.compile(rf"(?<=[A-Za-z0-9])\s*+[\[({{<]\s*+(?:{_AT}|@)\s*+[\])}}>]\s*+(?=[A-Za-z0-9])", re.I)
_BRACKET_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s*+[\[({{<]\s*+(?:{_DOT}|\.)\s*+[\])}}>]\s*+(?=[A-Za-z0-9])", re.I)
_OPEN = re.compile(r"[\[({<]|\s@\s")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s++@\s++(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)")
_SEP = r"(?:\s++|[-_*/])"
_WORD_DOT = rf"{_SEP}(?:{_DOT}){_SEP}"
_WORD_AT = rf"{_SEP}(?:{_AT}){_SEP}"
_LABEL = r"[A-Za-z0-9]++"
_SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?:{_LABEL}(?:[._%+-]|{_WORD_DOT}))*?{_LABEL}(?P<at>{_WORD_AT}|@)"
    rf"(?!(?:the|a|an|this|that|my|our|your|his|her|their){_SEP}){_LABEL}(?:(?:[.-]|{_WORD_DOT}){_LABEL})*?"
    rf"{_WORD_DOT}[A-Za-z]{{2,}}+(?:{_WORD_DOT}{_LABEL})*", re.I)
_SPOKEN_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z]{{2,}}+[._][A-Za-z0-9._]*[A-Za-z0-9](?P<at>\s++(?:{_AT})\s++)"
                        r"(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,})", re.I)
_DOT_WORD = re.compile(rf"\b(?:{_DOT})\b", re.I)
_AT_WORD = re.compile(rf"\b(?:{_AT})\b|@", re.I)
_SEPARATOR = re.compile(rf"(?P<at>{_WORD_AT})|(?P<dot>{_WORD_DOT})", re.I)
_WORDS = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_DIGIT_WORDS = re.compile(rf"\b(?:{_WORDS})(?:(?:[\s-]++|\s++(?:{_DOT})\s++)(?:{_WORDS}))+\b", re.I)
_DIGIT_WORD = re.compile(rf"(?P<word>{_WORDS})|\s(?P<dot>{_DOT})\s", re.I)
_SIGN_WORDS = re.compile(rf"\bplus\s++(?=[0-9])|(?<=[0-9])(?:\s++|\s*+[\[({{<]\s*+)(?:{_DOT})(?:\s*+[\])}}>]\s*+|\s++)(?=[0-9])", re.I)
_DRAWN = re.compile(r"(?<=[0-9])[OoIl|]+(?=[\x20)-]?[0-9]|\.[0-9])|(?:(?<=[0-9][\x20.-])|(?<=\())[OoIl|]+(?=[0-9])")
_DRAWN_AS = str.maketrans("OoIl|", "00111")

Edits = list[tuple[int, int, str]]


def _lookalikes(text: str) -> Edits:
    table = _one_for_one()
    if table.keys().isdisjoint(text):
        return []
    return [(m.start(), m.end(), table[m.group()]) for m in _NOT_ASCII.finditer(text) if m.group() in table]


def _invisible(text: str) -> Edits:
    return [(*m.span(), "") for m in _INVISIBLES.finditer(text)]


def _brackets(text: str) -> Edits:
    if not _OPEN.search(text):
        return []
    return sorted([(*m.span(), "@") for m in _BRACKET_AT.finditer(text)] + [(*m.span(), ".") for m in _BRACKET_DOT.finditer(text)]
                  + [(*m.span(), "@") for m in _SPACED_AT.finditer(text)])


def _spoken(text: str) -> Edits:
    """Separators in words inside what reads as a whole address, so that the words around them stay in place."""
    out: Edits = []
    if _DOT_WORD.search(text) and _AT_WORD.search(text):
        for m in _SPOKEN.finditer(text):
            out += [(m.start() + s.start(), m.start() + s.end(), "@" if s["at"] else ".")
                    for s in _SEPARATOR.finditer(m.group())]
    taken = {a for a, _, _ in out}
    return sorted(out + [(*m.span("at"), "@") for m in _SPOKEN_AT.finditer(text) if m.start("at") not in taken])


def _digit_words(text: str) -> Edits:
    out: Edits = []
    for run in _DIGIT_WORDS.finditer(text):
        last, between = run.start(), ""
        for m in _DIGIT_WORD.finditer(run.group()):
            if m["dot"]:
                between = "."
                continue
            a, b = run.start() + m.start(), run.start() + m.end()
            if last < a:
                out.append((last, a, between))
            out.append((a, b, _DIGIT_OF[m["word"].lower()]))
            last, between = b, ""
    return out


def _signs(text: str) -> Edits:
    return [(*m.span(), "+" if m.group()[:4].lower() == "plus" else ".") for m in _SIGN_WORDS.finditer(text)]


def _drawn_digits(text: str) -> Edits:
    return [(*m.span(), m.group().translate(_DRAWN_AS)) for m in _DRAWN.finditer(text)]


TRANSDUCERS: list[Callable[[str], Edits]] = [_lookalikes, _invisible, _brackets, _spoken, _digit_words, _signs, _drawn_digits]


def deobfuscated(text: str) -> tuple[str, list[Layer]]:
    """The text behind all transducers and the layers of edits that lead back."""
    layers = []
    for rewrite in TRANSDUCERS:
        if text.isascii() and rewrite in (_lookalikes, _invisible):
            continue  # both edit other characters only
        edits = rewrite(text)
        if edits:
            layers.append(Layer(text, edits))
            text = layers[-1].text
    return text, layers


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, plain and deobfuscated spans)."""
    base = plain_spans(text)
    clear, layers = deobfuscated(text)
    if not layers:
        return base, base
    out, ends = list(base), {k: [s for s in base if s.kind == k] for k in KINDS}
    for kind, start, end in plain_spans(clear):
        for layer in reversed(layers):
            start, end = layer.back(start, end)
        known = ends[kind]
        k = bisect_right(known, start, key=lambda s: s.start)
        if not (k and known[k - 1].end > start or k < len(known) and known[k].start < end):
            out.append(Span(kind, start, end))
    return base, in_order(out)


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (plain spans) and ``spans`` (all), each an array of (kind, start, end) in code points."""

    @F.pandas_udf(_RESULT)
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [all_spans(t) if isinstance(t, str) else ([], []) for t in texts]
            yield pd.DataFrame([[[s._asdict() for s in side] for side in row] for row in rows], columns=["base", "spans"])

    return (docs.withColumn("__p", of_texts(F.col("text")))
            .withColumns({"base": F.col("__p.base"), "spans": F.col("__p.spans")}).drop("__p"))
