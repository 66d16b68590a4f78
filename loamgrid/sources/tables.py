"""Readers and writers: lines of JSON, partitions by company, the manifest, and checks of downloaded files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.session import fresh

PAGE = "code string, name string, page int, section string, text string, tables array<struct<title: string, rows: array<array<string>>, degraded: boolean>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; a path that isn't there is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_company(df: DataFrame, path: str) -> None:
    """One folder for each company, so that a page is found by reading one."""
    df.write.mode("overwrite").partitionBy("code").parquet(path)


def read_by_company(spark: SparkSession, path: str, company: str = "code") -> DataFrame:
    """All companies' folders, company by company: partitions are ranges of companies, each in order."""
    return spark.read.parquet(path).repartitionByRange(company, "page").sortWithinPartitions(company, "page")


def write_report(lines: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """Lines of a report as text files whose names follow their order; a range of lines is one file, so that no task holds a report."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.mode("overwrite").text(path)


def of_companies(rows: DataFrame, companies: DataFrame, company: str = "code") -> DataFrame:
    """Rows of the companies of a list."""
    return rows.join(companies.select(company).distinct(), company, "left_semi")


def page(pages: DataFrame, code: str, number: int) -> DataFrame:
    """One page, once however often it was delivered; the filters reach the scan."""
    return fresh(pages.where((F.col("code") == code) & (F.col("page") == number)), "page")


def latest(rows: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    """The last version of each key; equal versions are told apart by the tie columns."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties])
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    return latest(old.unionByName(new), key, version, *ties)


def whole_pdf(content: Column, length: Column) -> Column:
    """Large enough, with the head and the end of a PDF."""
    head, tail = F.substring(content, 1, 1024), F.substring(content, -2048, 2048)
    return (length >= 20_000) & (F.locate("%PDF", head.cast("string")) > 0) & (F.locate("%%EOF", tail.cast("string")) > 0)


def file_mark(content: Column) -> Column:
    """Sixteen hex digits of the hash of a file's first MiB."""
    return F.substring(F.sha2(F.substring(content, 1, 1 << 20), 256), 1, 16)


def plain_title(title: Column) -> Column:
    """A title without the marks of a search's hits."""
    return F.trim(F.regexp_replace(title, "</?em>", ""))


#: Words in titles of announcements that aren't the report itself.
BANNED = ("摘要", "英文", "更正", "取消", "修订", "审计报告", "内部控制", "社会责任", "ESG", "独立董事", "关于", "说明", "公告", "致股东")


def report_priority(title: Column, year: Column) -> Column:
    """0 for a title that names the year's report and ends in a report's name, 1 for one that names it, null for none or a banned word."""
    named = [F.contains(title, F.concat(year.cast("string"), F.lit(x))) for x in ("年年度报告", "年度报告")]
    priority = F.when(F.endswith(title, F.lit("年度报告")), 0).otherwise(1)
    return F.when((named[0] | named[1]) & ~title.rlike("|".join(BANNED)), priority)
