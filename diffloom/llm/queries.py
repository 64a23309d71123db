"""Queries of the llm operators over the tables of TESTDATA.md, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.llm import encode, generated, lookalike, pack, secrets, split, syntax
from diffloom.session import spread_table, staged, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Changed files that nobody wrote by hand."""
    return p1_reasons(spark, d).select("file_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Those files with what gave them away."""
    return generated.unwritten_files(spread_table(spark, d, "changed_files"), table(spark, d, "gate_options"))


def p1_gate(spark: SparkSession, d: str) -> DataFrame:
    """How past gate decisions (the last run of each file) agree with what was found."""
    last = F.max_by(F.struct("decision", "reason"), F.struct("run_no", "decided_at", "decision_id")).alias("last")
    decided = table(spark, d, "gate_decisions").groupBy("file_id").agg(last)
    both = decided.join(p1_reasons(spark, d).withColumnRenamed("reason", "found"), "file_id", "left")
    return both.groupBy(F.col("last.decision").alias("decision"), F.col("last.reason").alias("reason"), "found").agg(F.count(F.lit(1)).alias("files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Units with more than 120 added lines, by way of their pieces."""
    return split.split_units(table(spark, d, "review_units"), with_lines=False).where("piece = 0").select("unit_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of those units, with their lines."""
    return split.split_units(table(spark, d, "review_units"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose source isn't valid syntax in its language."""
    return p4_faults(spark, d).select("case_id")


def p4_faults(spark: SparkSession, d: str) -> DataFrame:
    """Those cases with the first fault and its line."""
    return syntax.source_faults(spread_table(spark, d, "eval_cases")).where("reason IS NOT NULL")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files, faulty files and their rate per repository and language."""
    return syntax.fault_rates(syntax.source_faults(spread_table(spark, d, "eval_cases")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a secret begins."""
    return secrets.find_secrets(spread_table(spark, d, "review_units"), with_text=False).where(F.size("kinds") > 0).select("unit_id", "line_no")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All lines that change, redacted."""
    return secrets.find_secrets(spread_table(spark, d, "review_units"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.token_ids(spread_table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The text of each document, decoded from its ids."""
    return encode.decode_ids(staged(p6_ids(spark, d), "ids"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    return pack.pack(encode.token_counts(spread_table(spark, d, "documents")))


def p7_use(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers, tokens, and the share of room that is used."""
    per = p7_containers(spark, d).groupBy("container").agg(F.sum("size").alias("tokens"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.avg(F.col("tokens") / pack.CAPACITY).alias("used"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but differ in characters."""
    return lookalike.lookalike_pairs(spread_table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of each document's text."""
    return lookalike.forms(spread_table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document that looks the same as another one, with its class and the number of different texts in it."""
    classes, members = lookalike.lookalikes(spread_table(spark, d, "documents"))
    sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("texts"))
    return members.join(classes.join(sizes, "class"), "text_hash").select("doc_id", F.hex("class").alias("class"), "texts")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p1_gate": p1_gate,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_faults": p4_faults,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_containers": p7_containers,
    "p7_use": p7_use,
    "p8_found": p8_found,
    "p8_forms": p8_forms,
    "p8_classes": p8_classes,
}

SQL: dict[str, str] = {
    "p3_found": """
        SELECT DISTINCT unit_id FROM review_units
        WHERE len(list_distinct(list_filter(added_line_numbers, lambda x: x >= start_line AND x <= end_line))) > 120
    """,
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
