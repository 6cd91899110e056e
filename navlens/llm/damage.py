"""Inputs that the queries of two operators are stated on: texts with a periodic tail, conversations with faults.

Only rows are made here, by the rules that the queries state; what is found in them is left to the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navlens.llm.common import words


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs`` where every tenth text (by crc32 of doc_id) repeats a stretch of its words up to its end.

    A null doc_id has no crc32: its text stays.
    """
    marked = docs.withColumn("__h", F.crc32(F.col("doc_id").cast("string")))
    ws = F.when(F.col("__h") % 10 == 0, words(F.col("text")))
    out = (marked.withColumn("__w", ws).withColumn("__g", F.floor(F.col("__h") / 10)).withColumn("__n", F.size("__w"))
           .withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
           .withColumn("__m", F.col("__n") - F.col("__a"))
           .withColumn("__p", (F.lit(1) + F.floor(F.col("__m") / (F.lit(3) + F.col("__g") % 8))).cast("int")))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")),
                                            F.ceil(F.col("__m") / F.col("__p")).cast("int"))), F.lit(1), F.col("__m"))
    changed = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), tail), " ")
    return (out.withColumn("text", F.when((F.col("__h") % 10 == 0) & (F.col("__n") > 0), changed).otherwise(F.col("text")))
            .select(*docs.columns))


def with_faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``conversations`` with rows dropped, emptied, cut, repeated or under another role.

    What happens to a row follows from crc32 of ``conv_id:turn``; a null counts as one space there and in role and text.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    return (rows.where("fault != 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
        .alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))))
        .drop("col"))
