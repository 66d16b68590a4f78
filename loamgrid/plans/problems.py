"""Queries of the general problems: quantities in different units and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.operators import nested
from loamgrid.operators.units import found_levels
from loamgrid.session import shared_folder, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of metrics in base units."""
    return found_levels(table(spark, folder, "page_records"), table(spark, folder, "chunks"), table(spark, folder, "metrics"))


def _nested_tables(spark: SparkSession, folder: str) -> str:
    """The folder to which one pass over all nested columns has written its flat tables."""
    place = shared_folder(spark, "nested")
    nested.write_tables(nested.all_nodes(*(table(spark, folder, name) for name in ("page_records", "eval_results", "raw_results"))), place)
    return place


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of nested records with their parents and places, from the flat tables."""
    return nested.found_leaves(spark, _nested_tables(spark, folder))


def p4_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each flat table and of those that name a parent which is another row; both agree but for the roots."""
    rows = spark.read.parquet(_nested_tables(spark, folder)).select("src", "tag", "key", "pk", "parent")
    above = rows.select("src", F.col("pk").alias("parent")).distinct().withColumn("linked", F.lit(True))
    counts = rows.join(above, ["src", "parent"], "left").groupBy("src", "tag")
    return counts.agg(F.count("*").alias("n"), F.count("linked").alias("n_linked"), F.count_if(F.col("parent") == F.col("key")).alias("n_top"), F.countDistinct("pk").alias("n_pk"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_tables)}
SQL: dict[str, str] = {}
