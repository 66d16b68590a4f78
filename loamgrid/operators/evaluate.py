"""Grading of answers, coverage by entity and summaries, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.text import bare_number, citations

#: Phrases by which an answer says that the material lacks something.
SAID_NO = ("未提及", "未披露", "没有", "无法", "不包含", "不含", "不提供", "未预测", "未涉及", "无法确定", "不能确定")


def _form(text: Column) -> Column:
    return F.lower(bare_number(F.coalesce(text, F.lit(""))))


def expected_hits(answer: Column, expected: Column) -> Column:
    """Those of the expected values that stand in the answer."""
    return F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda x: F.contains(_form(answer), _form(x)))


def said_no(answer: Column) -> Column:
    return bare_number(F.coalesce(answer, F.lit(""))).rlike("|".join(SAID_NO))


def grade(df: DataFrame) -> DataFrame:
    """Adds hits, misses and grade (正确, 部分正确, 错误). Needs answer, expect, expect_all, expect_reject and recall_ok.

    An empty answer is wrong. Where a refusal is expected, it is right if it says so and names no amount in 亿. Else all, some
    or none of expect_all decide, or any of expect where there is no such list; where nothing is expected nothing is hit.
    """
    strict = F.size(F.coalesce("expect_all", F.array().cast("array<string>"))) > 0
    wanted = F.when(strict, F.col("expect_all")).otherwise(F.coalesce("expect", F.array().cast("array<string>")))
    df = df.withColumn("hits", expected_hits(F.col("answer"), wanted))
    df = df.withColumn("misses", F.array_except(wanted, "hits"))
    answer = F.col("answer")
    right, some, wrong = F.lit("正确"), F.lit("部分正确"), F.lit("错误")
    rejected = F.when(said_no(answer) & ~answer.rlike(r"[0-9]+\.?[0-9]*\s*亿"), right).otherwise(wrong)
    listed = F.when(F.size("misses") == 0, right).when((F.size("hits") > 0) & F.coalesce("recall_ok", F.lit(False)), some).otherwise(wrong)
    loose = F.when(F.size("hits") > 0, right).otherwise(wrong)
    empty = F.trim(F.coalesce(answer, F.lit(""))) == ""
    return df.withColumn("grade", F.when(empty, wrong).when(F.coalesce("expect_reject", F.lit(False)), rejected).when(strict, listed).otherwise(loose))


def checked_citations(answer: Column, chunks: Column) -> tuple[Column, Column]:
    """Cited numbers that exist, and those that don't."""
    cited = F.coalesce(citations(answer), F.array().cast("array<int>"))
    n = F.when(chunks.isNull(), 0).otherwise(F.size(chunks))
    valid = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_intersect(cited, valid)), F.array_sort(F.array_except(cited, valid))


def coverage(results: DataFrame) -> DataFrame:
    """result_id, company, covered, n_chunks, chunk_idxs, cited: each needed company against the chunks that were recalled."""
    used, _ = checked_citations(F.col("answer"), F.col("chunks"))
    rows = results.select("result_id", used.alias("used"), "chunks", F.explode(F.array_distinct("need_companies")).alias("company"))
    none = F.array().cast("array<int>")
    mine = F.coalesce(F.transform(F.filter("chunks", lambda c: c["company"] == F.col("company")), lambda c: c["idx"]), none)
    rows = rows.withColumn("chunk_idxs", F.array_sort(mine))
    return rows.select("result_id", "company", (F.size("chunk_idxs") > 0).alias("covered"), F.size("chunk_idxs").alias("n_chunks"), "chunk_idxs", (F.size(F.array_intersect("chunk_idxs", "used")) > 0).alias("cited"))


def not_targeted(results: DataFrame) -> DataFrame:
    """result_id and company of every company that was recalled without being needed."""
    none = F.array().cast("array<string>")
    more = F.array_except(F.array_distinct(F.coalesce("companies_recalled", none)), F.coalesce("need_companies", none))
    return results.select("result_id", F.explode(more).alias("company"))


def spotted(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key and name of every known name that a text holds.

    Names are met by equal substrings: a text gives its substrings of each length that names have, so that the join is
    on equality and no text is compared with all names.
    """
    lengths = names.agg(F.array_sort(F.collect_set(F.length("name"))).alias("lengths"))  # one row, as many values as names have lengths
    rows = texts.select(key, text).join(F.broadcast(lengths))
    spots = F.flatten(F.transform("lengths", lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.col(text).substr(i, n))).otherwise(F.array().cast("array<string>"))))
    return rows.select(key, F.explode(F.array_distinct(spots)).alias("name")).join(names.select("name").distinct(), "name").select(key, "name")
