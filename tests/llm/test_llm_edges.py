"""Nulls, empty and long texts, repeated rows, empty tables, clashing extra columns."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from navlens.llm import bpe, decontaminate as D, htmltext as H, jaccard as J, licenses as L, lm, quality as Q, \
    sharding as S, toxicity as X, urlfilter as U
import public_tokenizers

TEXTS = [None, "", "   \n ", "word", "Same text here.", "Same text here.", "long words again " * 20_000, "x" * 30_000,
         (4, "Same text here."), (None, "no id"), "Licensed under the MIT License. All rights reserved."]
CLASH = ["n_words", "kept", "size", "shard", "score", "predicted", "n_tokens", "license", "node", "block", "votes"]


@pytest.fixture(scope="module")
def docs(make_docs):
    out = make_docs(TEXTS)
    for c in CLASH:
        out = out.withColumn(c, F.lit("clash"))
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, t) for i in range(8) for t in (0, 1)] + [(None, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "same text here"), (None, "long words again long words")],
                                 "item_id long, text string")


def ops(labels, items):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    trains = F.col("doc_id") % 2 == 0
    return {
        "op1": lambda d: Q.judge_quality(d), "op2": lambda d: S.shard_documents(d), "op3": lambda d: D.find_leaks(d, items),
        "op4": lambda d: X.score_toxicity(d, labels, F.col("doc_id") % 4 != 2), "op5": lambda d: J.link_documents(d),
        "op6": lambda d: L.scan_licenses(d), "op7": lambda d: bpe.encode_decode(d, path, public_tokenizers.PATTERN),
        "op9": lambda d: lm.score_texts(d, trains)}


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9"])
def test_odd_rows(docs, labels, items, name):
    got = ops(labels, items)[name](docs).collect()
    if name == "op3":
        assert {(r.doc_id, r.item_id) for r in got} >= {(4, 3), (5, 3), (6, None)}
        return
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    empty = [by[i][0] for i in (0, 1, 2)]
    if name == "op1":
        assert all(r.n_words == 0 and r.base_failed and not r.kept for r in empty)
        assert by[6][0].n_repeat_words == by[6][0].n_words == 60_000
    if name == "op2":
        assert [by[0][0].size, by[1][0].size] == [16, 16]
        assert {r.shard for r in by[4] + by[5]} == {by[4][0].shard}
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if name == "op4":
        assert len({r.score for r in empty[:2]}) == 1 and all(0 <= r.score <= 1 for r in got)
    if name == "op5":
        assert [r.component_id for r in empty] == [0, 1, 2] and {r.component_id for r in by[4] + by[5]} == {4}
    if name == "op6":
        assert by[10][0].sentence_ids == "<mit><reserved>" and by[10][0].license == "MIT" and by[0][0].license is None
    if name == "op7":
        assert [r.n_tokens for r in empty[:2]] == [0, 0]
    if name == "op9":
        assert [r.n_tokens for r in empty] == [1, 1, 1]


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9"])
def test_empty_table(docs, labels, items, name):
    assert ops(labels, items)[name](docs.limit(0)).collect() == []


def test_no_items_no_labels(docs, labels, items):
    assert D.find_leaks(docs, items.limit(0)).collect() == []
    assert D.drop_leaks(docs, items.limit(0)).count() == len(TEXTS)
    assert {r.score for r in X.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {X.UNLEARNT}


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "no scheme", ""), (3, "HTTP://WWW.Example.COM/en/x?q", "<p>a"), (3, "HTTP://WWW.Example.COM/en/x?q", "<p>a"),
         (4, "http://a.net/es/", "<article>b</article>"), (None, "http://x.org/free-win", "c"), (5, "http://casino.org", "d"),
         (6, "http://casinos.org/winner", "e" * 300_000), (7, "http://example.com", "f")], "page_id long, url string, html string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages).collect()), key=str)
    assert got == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"),
        (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (4, "a.net", "/es/", "net/es/", "block"), (0, "x.org", "/free-win", None, "block"),
        (5, "casino.org", "", None, "block"), (6, "casinos.org", "/winner", None, "allow"),
        (7, "example.com", "", None, "allow")], key=str)
    texts = [(r.page_id, r.text) for r in H.extract_text(pages).collect()]
    assert len(texts) == 9 and (1, "") in texts and texts.count((3, "a")) == 2 and (None, "c") in texts
    assert U.judge_urls(pages.limit(0)).collect() == [] and H.extract_text(pages.limit(0)).collect() == []


def test_stages_keep_columns_and_take_odd_rows(spark, docs, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
