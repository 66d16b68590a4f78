"""Queries of the problems of text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import canon, leakage, mixing, pairs, repeated_lines, splitting
from loamgrid.session import spread_out, table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_out(table(spark, folder, "documents").select("doc_id", "source", "text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one table whose texts differ but read the same."""
    out = []
    for name, key in (("documents", "doc_id"), ("chunks", "chunk_id")):
        rows = spread_out(table(spark, folder, name).select(F.col(key).cast("string").alias("key"), "text"))
        out.append(canon.lookalike_pairs(rows).select(F.lit(name).alias("tbl"), "key_a", "key_b"))
    return out[0].unionByName(out[1])


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of documents and chunks in its one form."""
    out = []
    for name, key in (("documents", "doc_id"), ("chunks", "chunk_id")):
        rows = canon.canonical_text(spread_out(table(spark, folder, name).select(F.col(key).cast("string").alias("key"), "text")))
        out.append(rows.select(F.lit(name).alias("tbl"), "key", "text"))
    return out[0].unionByName(out[1])


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of rows of one table whose texts differ but read the same, and their members."""
    out = []
    for name, key in (("documents", "doc_id"), ("chunks", "chunk_id")):
        rows = spread_out(table(spark, folder, name).select(F.col(key).cast("string").alias("key"), "text"))
        out.append(canon.lookalike_classes(rows).select(F.lit(name).alias("tbl"), "key", "class", "n_strings", "n_rows"))
    return out[0].unionByName(out[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Running lines of documents by source and of page records by company."""
    out = []
    for name, key, group in (("documents", "doc_id", "source"), ("page_records", "page_id", "code")):
        found = repeated_lines.lines_to_remove(spread_out(table(spark, folder, name).select(key, group, "text")), key, group, "text")
        out.append(found.select(F.lit(name).alias("tbl"), "row_id", "line_no"))
    return out[0].unionByName(out[1])


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and page records without their running lines."""
    out = []
    for name, key, group in (("documents", "doc_id", "source"), ("page_records", "page_id", "code")):
        rows = repeated_lines.without_running_lines(spread_out(table(spark, folder, name).select(key, group, "text")), key, group, "text")
        out.append(rows.select(F.lit(name).alias("tbl"), "row_id", "text", "n_removed"))
    return out[0].unionByName(out[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs of question and answer."""
    return pairs.defects(table(spark, folder, "eval_results"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of held-out items."""
    return leakage.leaked(_documents(spark, folder), table(spark, folder, "eval_items"))


def p6_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of held-out items that were cut or lightly changed."""
    return leakage.proximity(_documents(spark, folder), table(spark, folder, "eval_items"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Records chosen for the mix with their repeats."""
    return mixing.mix(spark, _documents(spark, folder), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the mix that each source reaches."""
    return mixing.shares(p7_selection(spark, folder), table(spark, folder, "mix_targets"))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents under each profile of limits."""
    return splitting.split_texts(_documents(spark, folder), table(spark, folder, "size_limits"))


QUERIES = {f.__name__: f for f in (p2_found, p2_canonical, p2_classes, p3_found, p3_cleaned, p5_found, p6_found, p6_proximity, p7_selection, p7_shares, p8_pieces)}
SQL: dict[str, str] = {}
