"""Quality rules: the fit decides, not all-must-pass, and the corpus stage computes its counts once per read."""
from pyspark.sql import functions as F

from navlens.llm import quality as Q
from navlens.llm.common import table


def test_verdict_is_not_all_must_pass(spark):
    got = Q.judge_quality(table(spark, "/root/testdata/sf0.01", "documents")).where("not base_failed")
    bad = F.array_contains("votes", -1)
    counts = got.agg(F.sum((F.col("kept") & bad).cast("int")).alias("weak"), F.sum((~F.col("kept") & bad).cast("int")).alias("strong")).first()
    assert counts.weak > 0 and counts.strong > 0


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = (Q.judge_quality(table(spark, sf, "documents")).where("not base_failed").select("doc_id", "kept")
           .join(table(spark, sf, "labels"), "doc_id"))
    n = got.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    n = {r.quality: r for r in n}
    assert n[1].kept == n[1].n and n[0].kept <= 0.05 * n[0].n


def test_stage_computes_features_once(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    kept = Q.keep_good(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.lower().count("rlike") == 1
    want = {r.doc_id for r in Q.judge_quality(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
