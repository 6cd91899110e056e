"""URL filter: host/path rules first, then a weighted URL vocabulary.

The vocabulary is matched with an Aho-Corasick automaton in one pass over the
lower-cased URL. A hit counts only when it is not inside a longer run of
letters and digits. A URL is rejected when the weights of its *distinct* terms
reach ``threshold``: a strict term weighs the threshold itself, so one is
enough, soft terms need several.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged by the vocabulary (a null URL has no term: allowed);
repeated rows are judged alike, one result each; extra columns pass through,
and result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from navlens.llm.common import ascii_lower

# The contract's rules (host/path prefix -> verdict).
RULES: tuple[tuple[str, str], ...] = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
# The default vocabulary. One strict term rejects; soft terms need two distinct hits.
STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "escort", "warez", "phishing", "malware")
SOFT_TERMS = ("win", "bet", "poker", "bonus", "jackpot", "loan", "sex", "adult", "pills", "torrent", "crack", "free",
              "hack", "dating")
THRESHOLD = 2.0
SOFT_WEIGHT = 1.0

_HITS = T.StructType([T.StructField("n_strict", T.IntegerType()), T.StructField("n_soft", T.IntegerType()),
                      T.StructField("weight", T.DoubleType())])


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits the host (or a parent domain of it) and starts the path; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):  # the last one set is the longest
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def vocabulary_hits(strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS,
                    soft_weight: float = SOFT_WEIGHT, threshold: float = THRESHOLD):
    """Pandas UDF url -> (distinct strict terms, distinct soft terms, weight of the distinct terms)."""
    weights = {t.lower(): soft_weight for t in soft} | {t.lower(): threshold for t in strict}
    strict_set = {t.lower() for t in strict}

    @F.pandas_udf(_HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        automaton.make_automaton()

        def inside(ch: str) -> bool:
            return ch.isascii() and ch.isalnum()

        def found(url) -> set[str]:
            if not isinstance(url, str):
                return set()
            u, out = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url), set()
            for end, term in automaton.iter(u):
                start = end - len(term)
                if (start < 0 or not inside(u[start])) and (end + 1 >= len(u) or not inside(u[end + 1])):
                    out.add(term)
            return out

        for urls in batches:
            sets = [found(u) for u in urls]
            yield pd.DataFrame({
                "n_strict": [len(s & strict_set) for s in sets],
                "n_soft": [len(s - strict_set) for s in sets],
                "weight": [float(sum(weights[t] for t in s)) for s in sets]})

    return hits


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT_TERMS,
               soft: Sequence[str] = SOFT_TERMS, soft_weight: float = SOFT_WEIGHT,
               threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, n_strict, n_soft, url_weight and verdict (``allow`` or ``block``)."""
    hits = vocabulary_hits(strict, soft, soft_weight, threshold)
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.lit(None).cast("map<string,string>")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    return (pages.withColumn("__h", hits(F.col("url")))
            .withColumns({"host": host, "path": path})
            .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
            .withColumns({"n_strict": F.col("__h.n_strict"), "n_soft": F.col("__h.n_soft"),
                          "url_weight": F.col("__h.weight")})
            .withColumn("verdict", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")])
                        .when(F.col("url_weight") >= threshold, "block").otherwise("allow"))
            .drop("__h"))
