"""Lexical, dense and hybrid retrieval for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions.text import words
from loamgrid.params import DEFAULTS, Params

#: Rows of a block of vectors: two blocks make a matrix of 32 MB.
BLOCK = 2048


@dataclass(frozen=True)
class Index:
    """Postings (id, term, tf, dl), vocabulary (term, df, idf) and one row of statistics (n, avgdl)."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame


def _idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def postings_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """id, dl, term and tf of the words of each row; rows without words have none."""
    tokens = rows.select(F.col(key).alias("id"), words(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))
    # The outer form keeps the optimiser from tokenizing twice to drop rows without words first.
    terms = tokens.select("id", "dl", F.explode_outer("tokens").alias("term")).where("term is not null")
    return terms.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def write_index(rows: DataFrame, key: str, text: str, folder: str) -> Index:
    """Stores the index of a corpus as three tables and reads them from there. The corpus is tokenized once.

    Rows without words have no postings but count in the mean length.
    """
    spark = rows.sparkSession
    postings_of(rows, key, text).write.mode("overwrite").parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    stats = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).join(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row each
    stats.select("n", (F.col("words") / F.nullif("n", F.lit(0))).alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/stats")
    stats = spark.read.parquet(f"{folder}/stats")
    vocabulary = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))  # one row
    vocabulary.select("term", "df", _idf(F.col("n"), F.col("df")).alias("idf")).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "vocabulary", "stats")))


def top(df: DataFrame, group: str, score: Column, tie: list, k: int, to: str = "rank") -> DataFrame:
    """The k best rows of each group, numbered from 1; scores are compared to nine places."""
    order = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), *tie)
    return df.withColumn(to, F.row_number().over(order)).where(F.col(to) <= k)


def bm25_topk(queries: DataFrame, index: Index, k: int | None = None, p: Params = DEFAULTS) -> DataFrame:
    """qid, id, score and rank of the best rows of a stored index for each query. queries has qid and q; a query's words count once."""
    asked = queries.select("qid", F.explode(F.array_distinct(words(F.col("q")))).alias("term"))
    known = asked.join(index.vocabulary.select("term", "idf"), "term").join(F.broadcast(index.stats))  # one row
    weight = F.col("idf") * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avgdl")))
    scores = index.postings.join(known, "term").groupBy("qid", "id").agg(F.sum(weight).alias("score"))
    return top(scores, "qid", F.col("score"), [F.col("id")], k or p.bm25_topk).where("score > 0")


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def write_vectors(rows: DataFrame, key: str, vector: str, folder: str) -> DataFrame:
    """Stores vectors at length 1 (id, v), so that searches needn't make them again, and reads them from there. Null vectors are left out."""
    rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), unit(F.col(vector)).alias("v")).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _best(k: int):
    """A function from a block of rows and a block of queries to the k best rows of each query, ties by id."""

    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        qids, ids = queries["qid"].to_numpy(), rows["id"].to_numpy()
        if not len(qids) or not len(ids):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left, right = (np.asarray(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (queries, rows))
        scores = left @ right.T
        # Scores are compared as the final ranking does; all rows up to the k-th score come through, then ties are cut by id.
        ranked = -np.round(scores, 9)
        edge = np.partition(ranked, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.inf
        q, r = np.nonzero(ranked <= edge)
        order = np.lexsort((ids[r], ranked[q, r], q))
        q, r = q[order], r[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, r = q[keep], r[keep]
        return pa.table({"qid": qids[q], "id": ids[r], "score": scores[q, r]})

    return best


def vector_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int | None = None, p: Params = DEFAULTS) -> DataFrame:
    """qid, id, score and rank of the nearest vectors by cosine. queries has qid and v; rows without a vector take no part.

    Both sides are cut into blocks of about BLOCK rows by their keys' hash. Each pair of blocks is multiplied by one task, which passes
    on the best k of its queries only.
    """
    k = k or p.vector_topk
    asked = queries.where("v is not null").select(F.col("qid").cast("bigint").alias("qid"), unit(F.col("v")).alias("v"))
    held = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), unit(F.col(vector)).alias("v"))
    n_asked, n_held = (1 + df.count() // BLOCK for df in (asked, held))

    def cut(df: DataFrame, own: str, own_blocks: int, other_blocks: int, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64(own), F.lit(own_blocks)).cast("int")
        return df.withColumn(names[0], mine).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    blocks = cut(held, "id", n_held, n_asked, ("rb", "qb")).groupBy("rb", "qb").cogroup(cut(asked, "qid", n_asked, n_held, ("qb", "rb")).groupBy("rb", "qb"))
    return top(blocks.applyInArrow(_best(k), "qid bigint, id bigint, score double"), "qid", F.col("score"), [F.col("id")], k)


def fused(dense: DataFrame, lexical: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, id, rank): qid, id, vector_rank, bm25_rank and rrf of all rows of either."""
    a = dense.select("qid", "id", F.col("rank").alias("vector_rank"))
    b = lexical.select("qid", "id", F.col("rank").alias("bm25_rank"))
    both = a.join(b, ["qid", "id"], "full_outer")
    part = [F.coalesce(1.0 / (p.rrf_k + F.col(c)), F.lit(0.0)) for c in ("vector_rank", "bm25_rank")]
    return both.withColumn("rrf", part[0] + part[1])


def fuse(dense: DataFrame, lexical: DataFrame, p: Params = DEFAULTS, k: int | None = None) -> DataFrame:
    """The k best rows of each query by reciprocal rank fusion, with their rank."""
    both = fused(dense, lexical, p)
    ties = [F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), F.col("id")]
    return top(both, "qid", F.col("rrf"), ties, k or p.final_topk)


def group_best(df: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """The best row of each group, then all groups' rows in order: the two stages of "which one is highest"."""
    best = df.groupBy(*group).agg(F.max_by(F.struct("*"), F.struct(F.round(score, 9), tie)).alias("x")).select("x.*")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(group[0]).orderBy(F.round(score, 9).desc(), F.col(tie))))


def prompt_block(idx: Column, company: Column, code: Column, section: Column, page: Column, kind: Column, body: Column) -> Column:
    """A numbered passage of a prompt."""
    named = F.when(F.coalesce(section, F.lit("")) == "", F.lit("未标注")).otherwise(section)
    return F.concat(F.lit("["), idx.cast("string"), F.lit("] "), company, F.lit("（"), code, F.lit("） "), named, F.lit(" 第"), page.cast("string"), F.lit("页 "), kind, F.lit("\n"), F.coalesce(body, F.lit("")))
