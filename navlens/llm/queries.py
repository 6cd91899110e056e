"""Registered queries of this package: thin digests over the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from navlens.llm import (bpe, conversations, damage, decontaminate, htmltext, jaccard, licenses, lm, oracle, pii,
                         quality, runs, sharding, toxicity, urlfilter)
from navlens.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality.BASE, "base_failed", "kept", "quality")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("text_md5")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out_labels() -> Column:
    """Rows whose labels no model may see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out_labels())
            .select("doc_id", held_out_labels().alias("held_out"), "score", "predicted", "n_restored"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                             public_tokenizers.PATTERN).drop("text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages")).drop("n_shared")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    repaired, _ = conversations.repair_conversations(damage.with_faults(given))
    ids = given.select(F.col("conv_id").alias("__id")).distinct()  # a conversation may have lost all its rows
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (ids.join(repaired, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
            .withColumn("conv_id", F.col("__id")).drop("__id")
            .fillna(zeros | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are of the plain spans, which the contract fixes; spans are all, n_added the others."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(damage.with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # runs stand by start, then period: the first of equal exponents stays
    top = F.aggregate("runs", F.lit(None).cast(runs.RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("__t", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__t.start"), F.col("__t.length"), F.col("__t.period"),
        F.expr("1000 * __t.length DIV __t.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256)
        .alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_lm_score": op9_lm_score,
    "op10_html_text": op10_html_text,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_pii": op12_pii,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
