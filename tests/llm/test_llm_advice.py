"""Cases of the second review: each failed before its change."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from navlens.llm import decontaminate as D, toxicity as X

rnd = random.Random(11)
VOCAB = ["".join(rnd.choices("abcdefghilmnoprstuv", k=rnd.randint(4, 8))) for _ in range(400)]


@pytest.mark.parametrize("share", [5, 25, 35, 50, 80, 95])
def test_toxicity_learns_at_every_class_share(spark, make_docs, share):
    toxic = [i % 100 < share for i in range(400)]
    texts = [" ".join(rnd.choices(VOCAB, k=30) + (["vilecur", "scumlord"] if t else ["kindly", "welcome"])) for t in toxic]
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    got = X.score_toxicity(make_docs(texts), labels, F.col("doc_id") % 4 != 0).collect()
    assert {r.doc_id for r in got if r.predicted} == {i for i, t in enumerate(toxic) if t}


def test_toxicity_stage_keeps_documents_when_nothing_can_be_learnt(spark, make_docs, tmp_path):
    docs = make_docs(["the same words here", "the same words here", "other words", None, "more"])
    for name, marks in (("none", []), ("all", [(i, 1) for i in range(5)]), ("mixed", [(i, i % 2) for i in range(5)])):
        spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.toxic_documents(spark, docs, f"{tmp_path}/{name}").count() == 5


def test_near_duplicate_stage_links_by_five_words_and_four_fifths(spark, make_docs, sf):
    texts = []
    for words, edits in ((50, 1), (100, 2), (500, 10), (1800, 45), (400, 5), (400, 40), (760, 19), (40, 1), (4, 0), (3, 0)):
        base = rnd.choices(VOCAB, k=words)
        for _ in range(4):
            copy = list(base)
            for at in rnd.sample(range(words), edits):
                copy[at] = rnd.choice(VOCAB) + "x"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in map(str.split, texts)]
    part = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                part = [min(part[i], part[j]) if x in (part[i], part[j]) else x for x in part]
    got = corpus_pipeline.near_duplicates(spark, make_docs(texts), sf).collect()
    assert {r.doc_id for r in got} == {i for i, x in enumerate(part) if i == x}


def test_long_items_are_found_at_any_place(spark, make_docs):
    def sentence(k):
        return " ".join(rnd.choices(VOCAB, k=k))
    items = [f"{sentence(n - 20)}. {sentence(20)}." for n in (40, 64, 65, 100, 120, 150, 200, 200, 400)]
    texts = [f"{sentence(at)} {t} {sentence(90)}" for t in items for at in (0, 7, 16, 41)] + [sentence(600)] * 2
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, want = make_docs(texts), {(4 * i + k, i) for i in range(len(items)) for k in range(4)}
    for size in (20_000, 3):
        got = D.find_leaks(docs, benchmark, slice_items=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(0 < r.bm25_share <= 1 for r in got)
    assert {r.doc_id for r in D.drop_leaks(docs, benchmark).collect()} == {len(texts) - 2, len(texts) - 1}
