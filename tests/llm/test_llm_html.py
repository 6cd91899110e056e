"""Page differencing: the query against a plain version, heavy boilerplate, groups of copies."""
import random

import pandas as pd
import pytest

from navlens.llm import htmltext as H
from navlens.llm.common import table

rnd = random.Random(9)
WORDS = "alpha beta gamma delta omega kappa sigma theta".split()


def words(n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 10 ** 6)) for _ in range(n))


def html(lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"


def texts(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        return {r.page_id: r for r in H.extract_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def lcs_positions(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_given_pages_are_aligned(spark):
    got = H.extract_text(table(spark, "/root/testdata/sf0.1", "pages"))
    assert got.where("n_shared > 0").count() > 50


@pytest.mark.parametrize("frame", [1, 3, 8, 15])
def test_heavy_boilerplate_goes(spark, monkeypatch, frame):
    monkeypatch.setattr(H, "text_partitions", lambda df: 1)
    site = [f"menu entry {k} of the site" for k in range(frame)]
    own = [words(12) for _ in range(4)]
    got = texts(spark, [(f"http://a.com/p/{k}", html(site[:frame // 2] + [x] + site[frame // 2:])) for k, x in enumerate(own)])
    assert {k: r.text for k, r in got.items()} == dict(enumerate(own))
    assert all(r.n_shared == frame for r in got.values())


def test_copies_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(H, "text_partitions", lambda df: 1)
    site = ["site line", "site foot"]
    a, b = words(20), words(20)
    pages = [(f"http://a.com/x/{k:02}", html([site[0], a, site[1]])) for k in range(9)]
    pages += [("http://a.com/x/50", html([site[0], b, site[1]]))]
    pages += [(f"http://b.com/{k}", html([site[0], a, site[1]])) for k in range(2)]  # copies only: nothing goes
    got = texts(spark, pages)
    assert {got[k].text for k in range(9)} == {a} and got[9].text == b
    assert {got[k].text for k in (10, 11)} == {"\n".join([site[0], a, site[1]])}


def test_long_runs_of_copies_hold_no_more_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(H, "text_partitions", lambda df: 1)
    a, b = words(20), words(20)
    pages = [("http://a.com/0", html(["top", b]))] + [(f"http://a.com/1/{k:04}", html(["top", a])) for k in range(1200)]
    got = texts(spark, pages)
    assert {r.text for k, r in got.items() if k} == {a} and got[0].text == b


def test_against_plain_pairs(spark, monkeypatch):
    """Pages of one host without articles: each against the nearest by path that is no copy, by a plain alignment."""
    monkeypatch.setattr(H, "text_partitions", lambda df: 1)
    pool = [f"line {k}" for k in range(12)]
    for _ in range(4):
        pages = [(f"http://h.com/{''.join(rnd.choices('ab', k=4))}{k:02}", rnd.sample(pool, rnd.randint(1, 7)) + [words(2)])
                 for k in range(12)]
        pages += [(u + "z", lines) for u, lines in rnd.sample(pages, 3)]
        got = texts(spark, [(u, html(lines)) for u, lines in pages])
        order = sorted(range(len(pages)), key=lambda k: (pages[k][0], k))
        for at, k in enumerate(order):
            lines = pages[k][1]

            def copy(i, j):
                a, b = pages[order[i]][1], pages[order[j]][1]
                return 20 * lcs_positions(a, b) >= 19 * max(len(a), len(b))
            left, right = at, at
            while left and copy(left - 1, left):
                left -= 1
            while right + 1 < len(order) and copy(right, right + 1):
                right += 1
            near = [order[i] for i in (left - 1, right + 1) if 0 <= i < len(order)]
            near.sort(key=lambda j: -H._common_start(H_path(pages[j][0]), H_path(pages[k][0])))
            near = [j for j in near if 20 * lcs_positions(lines, pages[j][1]) < 19 * max(len(lines), len(pages[j][1]))]
            n = lcs_positions(lines, pages[near[0]][1]) if near else 0
            kept = got[k].text.split("\n") if got[k].text else []
            assert got[k].n_shared == n and len(kept) == len(lines) - n
            rest = iter(lines)
            assert all(x in rest for x in kept)
            if near:  # what went stands in the neighbour, in order
                gone, other = list(lines), iter(pages[near[0]][1])
                for x in kept:
                    gone.remove(x)
                assert all(x in other for x in gone)


def H_path(url):
    return url[len("http://h.com"):]


def test_ties_take_the_page_before(spark, monkeypatch):
    monkeypatch.setattr(H, "text_partitions", lambda df: 1)
    got = texts(spark, [("http://t.com/a1", html(["one", "x"])), ("http://t.com/a2", html(["one", "two", "y"])),
                        ("http://t.com/a3", html(["two", "z"]))])
    assert got[1].text == "two\ny"


def test_article_is_spared(spark, monkeypatch):
    monkeypatch.setattr(H, "text_partitions", lambda df: 1)
    page = "<nav><a>home</a></nav><div>stray</div><article><p>shared passage</p><p>{}</p></article><footer>foot</footer>"
    got = texts(spark, [("http://s.com/1", page.format("own one")), ("http://s.com/2", page.format("own two"))])
    assert got[0].text == "shared passage\nown one" and got[0].n_shared == 3


def plain_texts(pages):
    """(text, shared lines) by page number: all pages in one list, whatever the run's length."""
    rows = sorted((url[7:].split("/")[0], "/" + url[7:].split("/", 1)[1], str(k), H.page_lines(page)) for k, (url, page) in enumerate(pages))
    starts = [k for k in range(len(rows)) if not k or rows[k - 1][0] != rows[k][0] or not H.aligned(rows[k - 1][3], rows[k][3])[1]]
    out = {}
    for begin, end in zip(starts, [*starts[1:], len(rows)]):
        for host, path, page_id, lines in rows[begin:end]:
            near = [rows[k] for k in (begin - 1, end) if 0 <= k < len(rows) and rows[k][0] == host]
            near.sort(key=lambda p: -H._common_start(p[1], path))
            out[int(page_id)] = H.main_text(lines, *[p[3] for p in near])
    return out


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_edges_of_partitions_and_long_runs_are_exact(spark, monkeypatch, partitions):
    """Runs within a partition, over its edge, over several partitions, and of more copies than a task keeps."""
    monkeypatch.setattr(H, "text_partitions", lambda df: partitions)
    a, b, c = words(9), words(9), words(9)
    pages = [("http://a.com/0", html(["top", b, "end"])), ("http://a.com/1/z", html(["end", c]))]
    pages += [(f"http://a.com/1/{k:04}", html(["top", a, "end"])) for k in range(H.LONGEST_RUN + 300)]
    pages += [(f"http://b.com/{k}", html(["top", a, "end"])) for k in range(3)]
    for host in "cdef":
        for k in range(60):
            pages += [(f"http://{host}.com/{k:02}/{j:02}", html(["top", f"part {k % 3}", f"own {k}", "end"]))
                      for j in range(rnd.choice([1, 1, 1, 2, 5]))]
    rnd.shuffle(pages)
    got = texts(spark, pages)
    assert {k: (r.text, r.n_shared) for k, r in got.items()} == plain_texts(pages)
    assert all(r.n_chars == len(r.text) for r in got.values())
    # the nearest page is the one after: by the page before alone, "top" would have gone
    run = [k for k, (url, _) in enumerate(pages) if url.startswith("http://a.com/1/") and url[-1] != "z"]
    assert {got[k].text for k in run} == {f"top\n{a}"}


def test_pages_are_shuffled_compressed():
    """What a page takes in the shuffle; a block of plain lines takes about two thirds of their bytes there."""
    lines = [[words(40) for _ in range(8)] for _ in range(50)]
    rows = pd.DataFrame({"page_id": [str(k) for k in range(50)], "html": [html(x) for x in lines]})
    packed = pd.concat(H._parse(iter([rows])))
    assert packed["lines"].map(len).sum() < 0.55 * sum(len("\n".join(x)) for x in lines)
    assert list(pd.concat(H._unpack(iter([packed])))["lines"]) == ["\n".join(x) for x in lines]
