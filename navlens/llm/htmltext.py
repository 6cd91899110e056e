"""Main text of HTML pages by structure and nearest-URL page differencing.

A page becomes a list of text lines, one per block, each marked with where it
stands: inside the declared article (``article``, ``main``), in page furniture
(navigation, site header, footer, sidebar, form, advert, notice, reader
comments; never kept), or elsewhere. Pages of a host are ordered by URL path;
each is compared with the neighbour whose path shares the longest start, passing
over copies of itself: pages whose line lists are equal but for one line in
twenty. Their lines are aligned by longest common subsequence, and lines that
both share are deleted as the site's own. The declared article is spared: what
an article repeats from another is still its text. So for a page with an
article the article is the result, whatever else the alignment leaves of the
frame; for one without, the lines elsewhere that the neighbour doesn't share.

Pages are parsed, range-partitioned by (host, path, page_id) with their lines
compressed, and streamed in order, so a host of any size spreads over tasks. A
task settles the pages whose neighbours it meets. Those of its first and last run of copies, whose neighbours
may stand in other partitions, and of a run of more than ``LONGEST_RUN`` copies,
of which it holds no more, are written as they are, with the pages that runs begin
and end with; runs are then numbered through over the partitions, and each page
left open gets the page before and the page after its run by a join. So every
page has the neighbours it would have in one stream.

Cases: null and empty html give an empty text; a null URL counts as empty host
and path; markup that is cut off ends where the page ends; repeated rows give
one result each; ties: of two neighbours with an equally long common path start
the one before counts; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from navlens.llm.common import text_partitions
from navlens.llm.urlfilter import url_host, url_path
from navlens.session import scratch_path

#: Most pages of a run of copies that a task keeps until the next other page comes; those of longer runs are joined.
LONGEST_RUN = 1000
# Rows of the written pass: settled pages, pages without their neighbours, pages that runs begin and end with.
SETTLED, OPEN, FIRST, LAST = range(4)
_PAGE = "page_id string, url string, host string, path string, lines string, places string"
_PACKED = "page_id string, url string, host string, path string, lines binary, places string"
_PASS = f"part int, run long, kind int, {_PAGE}, text string, n_shared int"
_TEXT = "page_id string, url string, text string, n_shared int"
# Where a line stands.
ELSEWHERE, IN_ARTICLE, IN_FURNITURE = range(3)

# HTML element names by role.
RAW = "script style noscript template textarea title iframe svg canvas object audio video select math"
FURNITURE = "nav footer aside form header menu dialog button fieldset"
ARTICLE = "article main"
INLINE = ("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small"
          " span strike strong sub sup time tt u var wbr img input")
VOID = "area base br col embed hr img input link meta param source track wbr"
# Words of a class or id that mark page furniture.
FURNITURE_WORDS = ("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments"
                   " consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice"
                   " notices popup promo promotion related share sharing sidebar social sponsor sponsored subscribe"
                   " toolbar widget")

_RAW, _FURNITURE, _ARTICLE = frozenset(RAW.split()), frozenset(FURNITURE.split()), frozenset(ARTICLE.split())
_INLINE, _VOID = frozenset(INLINE.split()), frozenset(VOID.split())
_WORDS = frozenset(FURNITURE_WORDS.split())
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                     r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _marks_furniture(name: str, attributes: str) -> bool:
    if name in ("html", "body"):
        return False
    for groups in _NAMED.findall(attributes):
        if any(not _WORDS.isdisjoint(_WORD.findall(value.lower())) for value in groups if value):
            return True
    return False


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """(line, where it stands) of every block, in page order."""
    if not page:
        return []
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    articles, skipping, depth, at, end = 0, "", 0, 0, len(page)

    def close_block() -> None:
        if parts:
            line = _SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()
            if line:
                lines.append((line, IN_FURNITURE if skipping else IN_ARTICLE if articles else ELSEWHERE))
            parts.clear()

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                parts.append(htmllib.escape(m.group()[9:].removesuffix("]]>"), quote=False))
            continue
        closing = bool(m.group(1))
        if name in _RAW and not closing:
            if not m.group(3).endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if skipping:
            if name in _ARTICLE and not closing and skipping not in _ARTICLE:
                close_block()
                skipping = ""  # furniture that is never closed ends where the article begins
            else:
                if name == "br":
                    parts.append(" ")
                elif name not in _INLINE or name == skipping and depth == 1 and closing:
                    close_block()
                if name == skipping:
                    depth += -1 if closing else 1
                    if depth == 0:
                        skipping = ""
                continue
        if name == "br":
            parts.append(" ")
            continue
        furniture = not closing and name not in _VOID and (
            name in _FURNITURE and not (name == "header" and articles) or _marks_furniture(name, m.group(3)))
        if name not in _INLINE or furniture:
            close_block()
        if furniture:
            skipping, depth = name, 1
        elif name in _ARTICLE:
            articles = max(0, articles + (-1 if closing else 1))
    close_block()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (bit-parallel, whole rows as integers)."""
    places: dict[str, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << i
    row = everything = (1 << len(a)) - 1
    rows = [row]  # rows[j]: bit i is 0 where one more line of a[:i + 1] matches within b[:j]
    for line in b:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & everything
        rows.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(i)
    return out


def _common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def aligned(lines: list[tuple[str, int]], other: list[tuple[str, int]]) -> tuple[set[int], bool]:
    """(positions that the other page shares, the two pages are copies): copies differ in one line of twenty at most."""
    if lines == other:
        return set(range(len(lines))), True
    shared = shared_lines([line for line, _ in lines], [line for line, _ in other])
    return shared, 20 * len(shared) >= 19 * max(len(lines), len(other))


def main_text(lines: list[tuple[str, int]], *neighbours: list[tuple[str, int]] | None) -> tuple[str, int]:
    """(main text, lines outside the article deleted as shared with the first neighbour that is no copy)."""
    shared: set[int] = set()
    for other in neighbours:
        if other is not None:
            found, copies = aligned(lines, other)
            if not copies:
                shared = {i for i in found if lines[i][1] != IN_ARTICLE}
                break
    wanted = IN_ARTICLE if any(place == IN_ARTICLE for _, place in lines) else ELSEWHERE
    return "\n".join(t for i, (t, place) in enumerate(lines) if place == wanted and i not in shared), len(shared)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Html -> lines, which hold no line break, compressed, and where each stands as a digit."""
    for batch in batches:
        for at in range(0, len(batch), 2000):
            rows = batch.iloc[at:at + 2000]
            pages = [page_lines(page) for page in rows["html"]]
            yield rows.drop(columns="html").assign(lines=[zlib.compress("\n".join(t for t, _ in page).encode()) for page in pages],
                                                   places=["".join(str(k) for _, k in page) for page in pages])


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            rows = batch.iloc[at:at + 2000]
            yield rows.assign(lines=[zlib.decompress(lines).decode() for lines in rows["lines"]])


def _lines_of(lines: str, places: str) -> list[tuple[str, int]]:
    return list(zip(lines.split("\n"), map(int, places))) if places else []


def _settled(page, before, after) -> tuple[str, int]:
    """Main text of a page by the neighbours of its run; pages are (page_id, url, host, path, lines)."""
    near = [p for p in (before, after) if p is not None and p[2] == page[2]]
    near.sort(key=lambda p: -_common_start(p[3], page[3]))
    return main_text(page[4], *[p[4] for p in near])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of a partition in order -> texts; a run of copies waits for the page after it, or is left open."""
    rows: list[tuple] = []

    def unsettled(kind, at, page):
        lines, places = "\n".join(t for t, _ in page[4]), "".join(str(k) for _, k in page[4])
        rows.append((part, at, kind, *page[:4], lines, places, None, None))

    part, number, before, last, run, is_open = 0, -1, None, None, [], False
    for batch in batches:
        for part, page_id, url, host, path, lines, places in zip(*(batch[c] for c in (
                "part", "page_id", "url", "host", "path", "lines", "places"))):
            page = page_id, url, host, path, _lines_of(lines, places)
            if last is None or last[2] != host or not aligned(last[4], page[4])[1]:
                rows.extend((part, number, SETTLED, *p[:2], None, None, None, None, *_settled(p, before, page)) for p in run)
                number, before, run, was_open = number + 1, last, [], is_open
                is_open = number == 0  # what is before the partition is not known
                if was_open or is_open:
                    unsettled(FIRST, number, page)
            last = page
            run.append(page)
            if len(run) > LONGEST_RUN:
                is_open = True
                unsettled(LAST, number - 1, before)
            if is_open:
                for p in run:
                    unsettled(OPEN, number, p)
                run = []
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=_columns(_PASS))
                rows.clear()
    for p in run:
        unsettled(OPEN, number, p)
    if last is not None:
        unsettled(LAST, number, last)
        if number and not is_open:
            unsettled(LAST, number - 1, before)
    yield pd.DataFrame(rows, columns=_columns(_PASS))


def _columns(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _copies(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    return pd.Series([x["host"] == y["host"] and aligned(_lines_of(x["lines"], x["places"]), _lines_of(y["lines"], y["places"]))[1]
                      for x, y in zip(a.to_dict("records"), b.to_dict("records"))], dtype=bool)


def _neighbours(passed: DataFrame) -> DataFrame:
    """part, run, before, after of every run with open pages; runs that go on in the next partition are one."""
    page = F.struct("host", "path", "lines", "places").alias("page")
    edges = passed.where(f"kind in ({FIRST}, {LAST})").select("part", "run", "kind", page)
    by_part = Window.orderBy("part")  # one short row a partition
    parts = edges.groupBy("part").agg(F.max("run").alias("runs")).select(
        "part", "runs", F.lag("part").over(by_part).alias("part_before"), F.lag("runs").over(by_part).alias("run_before"))
    begin = edges.where(f"kind = {FIRST} and run = 0").select("part", F.col("page").alias("begin"))
    end = edges.where(f"kind = {LAST}").select(F.col("part").alias("part_before"), F.col("run").alias("run_before"),
                                               F.col("page").alias("end"))
    goes_on = F.pandas_udf(_copies, "boolean")("begin", "end")
    joined = parts.join(begin, "part").join(end, ["part_before", "run_before"]).select("part", goes_on.alias("goes_on"))
    bases = parts.join(joined, "part", "left").select("part", F.sum(  # the first partition begins at 0
        F.coalesce("run_before", F.lit(-1)) + F.when(F.col("goes_on"), 0).otherwise(1)).over(by_part).alias("base"))
    numbered = edges.join(bases, "part").withColumn("n", F.col("base") + F.col("run"))
    before = numbered.where(f"kind = {LAST}").groupBy((F.col("n") + 1).alias("n")).agg(F.max_by("page", "part").alias("before"))
    after = numbered.where(f"kind = {FIRST}").groupBy((F.col("n") - 1).alias("n")).agg(F.min_by("page", "part").alias("after"))
    return (passed.where(f"kind = {OPEN}").select("part", "run").distinct().join(bases, "part")
            .withColumn("n", F.col("base") + F.col("run")).join(before, "n", "left").join(after, "n", "left")
            .select("part", "run", "before", "after"))


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open pages with the neighbours of their runs -> texts."""
    def page(host, path, lines, places):
        return None if host is None else (None, None, host, path, _lines_of(lines, places))

    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            own = r.page_id, r.url, r.host, r.path, _lines_of(r.lines, r.places)
            rows.append((r.page_id, r.url, *_settled(own, *[page(*[getattr(r, f"{side}_{c}") for c in (
                "host", "path", "lines", "places")]) for side in ("before", "after")])))
        yield pd.DataFrame(rows, columns=_columns(_TEXT))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines deleted as shared) of every page."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "page-texts")
    key = ["host", "path", "page_id"]
    parsed = (pages.select(F.col("page_id").cast("string"), "url", url_host(F.col("url")).alias("host"),
                           url_path(F.col("url")).alias("path"), "html")  # as text: a null id makes no floats in pandas
              .mapInPandas(_parse, _PACKED))
    placed = (parsed.repartitionByRange(text_partitions(pages), *key).mapInPandas(_unpack, _PAGE)
              .sortWithinPartitions(*key, "lines", "places")
              .withColumn("part", F.spark_partition_id()))
    # written: a range is what one sampling of the bounds made it, so it must not be made again
    placed.mapInPandas(_extract, _PASS).write.option("compression", "zstd").parquet(path)
    passed = spark.read.schema(_PASS).parquet(path)
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in ("host", "path", "lines", "places")]
    left_open = (passed.where(f"kind = {OPEN}").select("part", "run", *_columns(_PAGE))
                 .join(_neighbours(passed), ["part", "run"], "left").select(*_columns(_PAGE), *sides)
                 .mapInPandas(_settle, _TEXT))
    return (passed.where(f"kind = {SETTLED}").select(*_columns(_TEXT)).unionByName(left_open)
            .select(F.col("page_id").cast("long"), "url", "text", F.char_length("text").cast("long").alias("n_chars"),
                    "n_shared"))
