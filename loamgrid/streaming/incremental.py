"""Incremental indexing: new chunks only, keyed by their content, in batches that may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "content string, chunk_id string, code string, chars int"


def content_key(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of contents with the batch (epoch) that brought each."""
    return spark.read.schema(INDEX + ", epoch bigint").parquet(f"{folder}/index")


def store_new(batch: DataFrame, folder: str, epoch: int) -> None:
    """Writes the contents that no batch before has brought, under the batch's own number, so that a repeated batch overwrites itself."""
    rows = batch.select(content_key(F.col("embed_text")).alias("content"), "chunk_id", "code", F.length("embed_text").alias("chars"))
    first = rows.groupBy("content").agg(F.min_by(F.struct("chunk_id", "code", "chars"), "chunk_id").alias("x")).select("content", "x.*")
    known = read_index(batch.sparkSession, folder).where(F.col("epoch") < epoch).select("content")
    first.join(known, "content", "left_anti").write.mode("overwrite").parquet(f"{folder}/index/epoch={epoch}")


def run(spark: SparkSession, source: str, pattern: str, schema, folder: str, files_per_batch: int = 4) -> DataFrame:
    """Takes in all files that aren't taken in yet and returns the index: content, chunk_id, code, chars and epoch, a content once.

    The stream's checkpoint in `folder` remembers the files, so that a later call on the same folder goes on where the last one ended.
    chunk_id is the smallest of the batch that brought the content.
    """
    spark.createDataFrame([], INDEX).write.mode("ignore").parquet(f"{folder}/index/epoch=-1")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, epoch: store_new(batch, folder, epoch)).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_index(spark, folder)
