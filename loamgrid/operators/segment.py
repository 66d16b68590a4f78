"""Segmentation: pieces of text and of tables, and the catalogue of chunks with stable ids.

Sentences are found in the JVM; which of them make up a piece is told by their lengths alone, by one walk over running sums in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.text import sentences, stripped
from loamgrid.params import DEFAULTS, Params
from loamgrid.session import stored


def piece_spans(lengths: list[int], p: Params, keep_copies: bool) -> list[tuple[int, int]]:
    """First and last sentence of each piece."""
    ends, out, start = [0, *accumulate(lengths)], [], 0
    for i in range(len(lengths)):
        if ends[i + 1] - ends[start] >= p.chunk_size:
            out.append((start, i))
            # The next piece begins with the last sentence that leaves the overlap behind it, never before this one's first.
            back = bisect_right(ends, ends[i + 1] - p.chunk_overlap, start, i + 1) - 1
            start = max(back, start)
    n = len(lengths)
    if n and ends[n] - ends[start] > p.tail_over and (keep_copies or not out or out[-1][1] < n - 1):
        out.append((start, n - 1))
    return out


def _spans(lengths: Column, p: Params, keep_copies: bool) -> Column:
    """array<struct<a, b>> of piece_spans."""

    @F.arrow_udf("array<struct<a: int, b: int>>")
    def walk(rows: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.array([[{"a": a, "b": b} for a, b in piece_spans(x or [], p, keep_copies)] for x in rows.to_pylist()], kind)

    return walk(lengths)


def chunk_text(df: DataFrame, text: str, keep_copies: bool = True, p: Params = DEFAULTS, ends: str | None = None) -> DataFrame:
    """Adds piece_no and piece for each piece of a text.

    A piece is emitted once it has `chunk_size` characters; the next one begins with its last whole sentences that make up
    the overlap. What is left at the end is a piece if it is longer than `tail_over`. With keep_copies=False a rest that
    only repeats the overlap is left out. Null texts have no pieces.
    """
    kept = df.columns
    df = df.withColumn("_s", sentences(F.col(text), ends) if ends else sentences(F.col(text)))
    df = df.withColumn("_p", _spans(F.transform("_s", F.length), p, keep_copies))
    df = df.select(*kept, "_s", F.posexplode("_p").alias("piece_no", "_x"))
    piece = F.array_join(F.slice("_s", F.col("_x.a") + 1, F.col("_x.b") - F.col("_x.a") + 1), "")
    return df.select(*kept, "piece_no", piece.alias("piece"))


def table_lines(table: Column) -> Column:
    """Lines of a table: its title, if any, then each row's filled cells between bars; rows without any are left out."""
    title = F.when(F.coalesce(table["title"], F.lit("")) != "", F.array(F.concat(F.lit("【表】"), table["title"]))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<array<string>>")
    cells = F.transform(F.coalesce(table["rows"], none), lambda r: F.array_join(F.filter(F.transform(r, stripped), lambda c: c != ""), " | "))
    return F.concat(title, F.filter(cells, lambda x: x != ""))


def chunk_tables(df: DataFrame, tables: str, p: Params = DEFAULTS) -> DataFrame:
    """Adds table_no, piece_no and piece: each table in pieces of at most `table_lines` lines."""
    kept = df.columns
    df = df.select(*kept, F.posexplode(F.transform(F.col(tables), table_lines)).alias("table_no", "_l"))
    n = p.table_lines
    starts = F.when(F.size("_l") > 0, F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.select(*kept, "table_no", "_l", F.explode(starts).alias("piece_no"))
    return df.select(*kept, "table_no", "piece_no", F.array_join(F.slice("_l", F.col("piece_no") * n + 1, F.lit(n)), "\n").alias("piece"))


def running_number(df: DataFrame, group: str | list[str], block: str, order: list[str], to: str) -> DataFrame:
    """Numbers rows 1.. within a group by (block, order) without sorting a whole group in one task.

    Blocks are counted first and added up per group; only the rows of one block are sorted together.
    """
    group = [group] if isinstance(group, str) else group
    counts = df.groupBy(*group, block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, block).orderBy(*order))
    return df.join(counts, [*group, block]).withColumn(to, (F.col("_before") + inside).cast("bigint")).drop("_before")


def chunk_catalog(pages: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """chunk_id, code, name, section, page, seq, kind, text and embed_text of all pieces of all pages.

    pages has one row for each page. Text pieces come before table pieces; pieces that are too short get no number.
    """
    base = ["code", "name", "section", "page"]
    texts = chunk_text(pages.select(*base, "text"), "text", True, p).where(F.length(stripped(F.col("piece"))) >= p.min_text_piece)
    texts = texts.select(*base, F.lit("text").alias("kind"), F.lit(0).alias("table_no"), "piece_no", F.col("piece").alias("text"))
    tables = chunk_tables(pages.select(*base, "tables"), "tables", p).where(F.length(stripped(F.col("piece"))) >= p.min_table_piece)
    tables = tables.select(*base, F.lit("table").alias("kind"), (F.col("table_no") + 1).alias("table_no"), "piece_no", F.col("piece").alias("text"))
    # Pieces are made once: they are counted and numbered from a stored table.
    both = running_number(stored(texts.unionByName(tables), "pieces"), "code", "page", ["table_no", "piece_no"], "seq")
    chunk_id = F.concat("code", F.lit("-T"), F.lpad(F.col("seq").cast("string"), 5, "0"))
    chunk_id = F.when(F.col("seq") < 100_000, chunk_id).otherwise(F.concat("code", F.lit("-T"), F.col("seq").cast("string")))
    embed = F.concat(F.coalesce("name", F.lit("")), F.lit("（"), "code", F.lit("） "), F.coalesce("section", F.lit("")), F.lit("\n"), "text")
    return both.select(chunk_id.alias("chunk_id"), "code", "name", "section", "page", "seq", "kind", "text", embed.alias("embed_text"))
