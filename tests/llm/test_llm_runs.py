"""Periodic runs against a comparison of all words at every distance."""
import hashlib
import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from navlens.llm import queries, runs as R
from navlens.llm.common import table

rnd = random.Random(1)


def plain_runs(s, least):
    n, out = len(s), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q) and not any(
                    all(s[k] == s[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_trees_find_all_runs():
    for _ in range(1500):
        s = [rnd.randint(1, rnd.choice([1, 2, 3])) for _ in range(rnd.randint(1, 40))]
        assert [tuple(x) for x in R.runs_of(s, 3).tolist()] == plain_runs(s, 3)


def test_stretches_lose_no_run():
    for _ in range(1500):
        s = []
        for _ in range(rnd.randint(1, 6)):
            m, p = rnd.randint(1, 80), [rnd.randint(1, rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(1, 14))]
            s += (p * (m // len(p) + 1))[:m] if rnd.random() < .7 else [rnd.randint(1, 50) for _ in range(m // 3)]
        assert [tuple(x) for x in R.word_runs(s).tolist()] == plain_runs(s, 24)


def test_common_prefixes():
    for _ in range(200):
        s = [rnd.randint(1, 2) for _ in range(rnd.randint(2, 30))]
        tree, n = R.SuffixTree(s), len(s)
        for i in range(n):
            for j in range(i + 1, n):
                k = 0
                while j + k < n and s[i + k] == s[j + k]:
                    k += 1
                assert tree.common(R.np.array([i]), R.np.array([j]))[0] == k


def test_query_against_plain_version(spark, sf):
    docs = table(spark, sf, "documents").where(F.length("text") < 6000)
    docs = docs.unionByName(spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(
        [None, "", " \n", "a b " * 40, "x " * 23, "x " * 24])], "doc_id long, text string"), allowMissingColumns=True)
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = R.find_runs(docs)
    for r in out.select("doc_id", "runs").collect():
        ws = (rows[r.doc_id] or "").encode().split()
        assert [tuple(x) for x in r.runs] == plain_runs(ws, 24)


def test_query_digests(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert got.keys() == texts.keys() and any(r.n_runs for r in got.values())
    for doc_id, text in texts.items():
        ws = (text or "").encode().split()
        n, h = len(ws), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        if n > 1200:
            continue
        runs, r = plain_runs(ws, 24), got[doc_id]
        top = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == ((len(runs),) + (top or (None, None, None)))
        assert r.exponent_milli == (top and 1000 * top[1] // top[2])
        kept = [w for i, w in enumerate(ws) if not any(a + q <= i < a + m for a, m, q in runs)]
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
