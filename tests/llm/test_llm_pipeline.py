"""The pipeline against a plain version of each of its decisions."""
import corpus_pipeline
from navlens.llm import queries
from navlens.llm.common import table, written


def test_pipeline_takes_each_operators_decisions(spark, sf):
    docs = table(spark, sf, "documents")
    ids = {r.doc_id for r in docs.collect()}
    kept = {r.doc_id for r in queries.op1_quality_rules(spark, sf).collect() if r.kept}
    stages = dict(corpus_pipeline.STAGES)
    first = written(stages["quality rules"](spark, docs, sf), "t1")
    assert {r.doc_id for r in first.collect()} == kept < ids
    second = written(stages["toxicity"](spark, first, sf), "t2")
    assert {r.doc_id for r in second.collect()} <= kept
    third = written(stages["n-gram jaccard join"](spark, second, sf), "t3").collect()
    sets = {}
    for r in second.collect():
        ws = "".join(c.lower() if c.isascii() else c for c in r.text).split()
        sets[r.doc_id] = {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    assert {r.doc_id for r in third} == {i for i in sets if find(i) == i}
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in third if not any(t in r.text for t in items)}
