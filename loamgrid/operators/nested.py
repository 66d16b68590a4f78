"""Deeply nested semi-structured records as related flat tables that keep parent and child linked.

A depth-first walk visits each record once and emits every node as one tagged row: tag, pk, parent, path, leaf, payload. All tables of
one source come from that single pass; `write_tables` stores them partitioned by source and tag and `read_table` applies a tag's schema.
Arrays of known type are walked by array functions in the JVM. Payloads of uneven JSON are walked by a small visitor in
Arrow batches, as no fixed schema can read them. A pk is made of positions, so that it is unique whatever the records call themselves; the
path has their own numbers where they have some.

Defined results: null or empty records, lists and payloads give nothing; text that is no JSON object gives nothing; an empty
string is a leaf, a null isn't; missing keys give null fields; rows delivered again count once; other columns are left out, so
that names can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.session import fresh_rows

#: One emitted node. `key` is the record's, `path` the place below it, `leaf` the value that identifies a child, if it has one.
TAGGED = "tag string, pk string, parent string, path string, leaf string, payload string"


def _node(**fields: Column) -> Column:
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def _text(number: Column) -> Column:
    return number.cast("string")


def walk_tables(df: DataFrame, key: str, tables: str) -> DataFrame:
    """Tags `table`, `row` and `cell` of array<struct<title, rows: array<array<string>>, degraded>>."""
    none = F.lit(None).cast("string")

    def cells(at: Column, row: Column) -> Column:
        every = F.transform(row, lambda cell, k: _node(tag=F.lit("cell"), pk=F.concat_ws("/", at, _text(k)), parent=at, leaf=cell, payload=none))
        return F.filter(every, lambda x: x["leaf"].isNotNull())

    def rows(at: Column, all_rows: Column) -> Column:
        def one(row: Column, j: Column) -> Column:
            place = F.concat_ws("/", at, _text(j))
            own = _node(tag=F.lit("row"), pk=place, parent=at, leaf=none, payload=_text(F.size(row)))
            return F.when(row.isNotNull(), F.concat(F.array(own), cells(place, row))).otherwise(F.array().cast("array<struct<tag:string,pk:string,parent:string,leaf:string,payload:string>>"))

        return F.flatten(F.transform(F.coalesce(all_rows, F.array().cast("array<array<string>>")), one))

    def one(t: Column, i: Column) -> Column:
        about = F.to_json(_node(title=t["title"], degraded=t["degraded"]))
        own = _node(tag=F.lit("table"), pk=_text(i), parent=F.lit(""), leaf=none, payload=about)
        return F.when(t.isNotNull(), F.concat(F.array(own), rows(_text(i), t["rows"]))).otherwise(F.array().cast("array<struct<tag:string,pk:string,parent:string,leaf:string,payload:string>>"))

    df = df.where(F.size(tables) > 0).select(F.col(key).cast("string").alias("key"), F.explode(F.flatten(F.transform(F.col(tables), one))).alias("n"))
    parent = F.when(F.col("n.parent") == "", F.col("key")).otherwise(F.concat_ws("/", "key", "n.parent"))
    return df.select("key", "n.tag", F.concat_ws("/", "key", "n.pk").alias("pk"), parent.alias("parent"), F.col("n.pk").alias("path"), "n.leaf", "n.payload")


def walk_structs(df: DataFrame, key: str, items: str, leaf: str, tag: str) -> DataFrame:
    """One tag: the elements of array<struct>, identified by their field `leaf`; a null element is none."""
    df = df.where(F.size(items) > 0).select(F.col(key).cast("string").alias("key"), F.posexplode(items).alias("pos", "item")).where("item is not null")
    path = _text(F.col("pos"))
    return df.select("key", F.lit(tag).alias("tag"), F.concat_ws("/", "key", path).alias("pk"), F.col("key").alias("parent"), path.alias("path"), F.col("item")[leaf].cast("string").alias("leaf"), F.to_json("item").alias("payload"))


def _records(value, fields: frozenset[str]) -> Iterator[tuple[str | None, dict]]:
    """Children in any shape: a list, one record by itself, or records under keys. Gives the key, if any, and the record."""
    if isinstance(value, list):
        for x in value:
            if isinstance(x, dict):
                yield None, x
    elif isinstance(value, dict):
        if any(k in fields for k in value):
            yield None, value
        else:
            for k, x in value.items():
                if isinstance(x, dict):
                    yield k, x


def _deep(record, name: str):
    """A field of a record, or the first of that name further down."""
    if isinstance(record, dict):
        if record.get(name) is not None:
            return record[name]
        for x in record.values():
            if isinstance(x, dict) and (found := _deep(x, name)) is not None:
                return found
    return None


_RESULT = frozenset({"no", "question", "kind", "chunks", "per_company_coverage", "recall"})
_CHUNK = frozenset({"idx", "chunk_id", "meta", "retrieval", "snippet", "company", "page", "section", "kind", "rrf_score"})
_COVER = frozenset({"company", "covered", "n_chunks", "chunk_idxs", "cited_in_answer"})


def _word(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _leaves(record: dict) -> dict:
    """A record without levels: fields of records inside it stand beside its own, which come first."""
    out, inner = {}, []
    for name, value in record.items():
        if isinstance(value, dict):
            inner.append(value)
        elif value is not None:
            out[name] = value
    for value in inner:
        out = _leaves(value) | out
    return out


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def visit(payload: str) -> Iterator[tuple[str, str, str, str, str | None, str]]:
    """tag, pk, parent, path, leaf and payload of each node of one evaluation run, parents first; pk and parent below the run's own."""
    try:
        run = json.loads(payload)
    except (ValueError, RecursionError):
        return
    if not isinstance(run, dict):
        return
    yield "run", "", "", "", _word(_deep(run.get("run"), "id")), _json({k: v for k, v in run.items() if k not in ("result", "results")})
    results = [x for name in ("result", "results") for x in _records(_deep(run, name) if name not in run else run[name], _RESULT)]
    for at, (under, result) in enumerate(results):
        no, own = _word(result.get("no", under)) or str(at + 1), str(at)
        yield "result", own, "", no, _word(result.get("question")), _json({k: v for k, v in result.items() if k not in ("chunks", "per_company_coverage")})
        for k, (under, chunk) in enumerate(_records(result.get("chunks"), _CHUNK)):
            idx = _word(chunk.get("idx", under)) or str(k + 1)
            flat = _leaves(chunk)
            yield "chunk", f"{own}/c{k}", own, f"{no}/{idx}", _word(flat.get("chunk_id")), _json(flat | {"idx": idx})
        cover = result.get("per_company_coverage")
        if not isinstance(cover, dict):
            continue
        yield "cover", f"{own}/p", own, no, None, _json({k: v for k, v in cover.items() if k != "coverage"})
        for k, (_, one) in enumerate(_records(cover.get("coverage"), _COVER)):
            yield "coverage", f"{own}/p/{k}", f"{own}/p", f"{no}/{k}", _word(_deep(one, "company")), _json(_leaves(one))


def walk_payloads(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Tags `run`, `result`, `chunk`, `cover` and `coverage` of JSON payloads of uneven shape."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[] for _ in range(7)]
            for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for tag, pk, above, path, leaf, body in visit(text):
                    for column, value in zip(out, (k, tag, f"{k}/{pk}" if pk else k, f"{k}/{above}" if above else k if pk else "", path, leaf, body), strict=True):
                        column.append(value)
            names = ["key", *(x.split()[0] for x in TAGGED.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=names)

    narrow = df.where(F.col(payload).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(payload).alias("payload"))
    return narrow.mapInArrow(batches, "key string, " + TAGGED)


def all_nodes(pages: DataFrame, results: DataFrame, raw: DataFrame) -> DataFrame:
    """Tagged rows of all nested columns: src, key, tag, pk, parent, path, leaf and payload."""
    parts = {
        "page_records": walk_tables(fresh_rows(pages.select("page_id", "tables"), "page_id"), "page_id", "tables"),
        "eval_results": walk_structs(fresh_rows(results.select("result_id", "chunks"), "result_id"), "result_id", "chunks", "chunk_id", "chunk"),
        "raw_results": walk_payloads(fresh_rows(raw.select("raw_id", "payload"), "raw_id"), "raw_id", "payload"),
    }
    out = None
    for src, nodes in parts.items():
        nodes = nodes.select(F.lit(src).alias("src"), "key", *(x.split()[0] for x in TAGGED.split(", ")))
        out = nodes if out is None else out.unionByName(nodes)
    return out


#: What `read_table` makes of each tag's payload. Fields beyond these stay in the payload.
SCHEMAS = {
    "run": "run struct<id: string, config: struct<topk: int, fusion: struct<k: int>>>",
    "result": "no string, question string, kind string, recall struct<n_vector: int, n_bm25: int>",
    "chunk": "idx string, chunk_id string, company string, section string, page string, kind string, rrf_score double, vector_rank int, bm25_rank int, snippet string",
    "cover": "targets array<string>, covered int, missing array<string>",
    "coverage": "company string, covered boolean, n_chunks int, chunk_idxs array<int>, cited_in_answer boolean",
    "table": "title string, degraded boolean",
}


def write_tables(nodes: DataFrame, folder: str) -> None:
    """Stores all tables of one pass, a folder for each source and tag."""
    nodes.write.mode("overwrite").partitionBy("src", "tag").parquet(folder)


def read_table(spark: SparkSession, folder: str, src: str, tag: str) -> DataFrame:
    """One flat table: key, pk, parent, path, leaf and the fields of the tag's schema. Only its folder is read."""
    kind = "key string, pk string, parent string, path string, leaf string, payload string, src string, tag string"
    rows = spark.read.schema(kind).parquet(folder).where((F.col("src") == src) & (F.col("tag") == tag))
    own = ["key", "pk", "parent", "path", "leaf"]
    if tag not in SCHEMAS:
        return rows.select(*own)
    return rows.select(*own, F.from_json("payload", SCHEMAS[tag]).alias("x")).select(*own, "x.*")


#: Where the leaves of each source stand: source, tag and the name of both together.
LEAVES = (("page_records", "cell", "page_records.tables"), ("eval_results", "chunk", "eval_results.chunks"), ("raw_results", "chunk", "raw_results.chunks"), ("raw_results", "coverage", "raw_results.coverage"))


def found_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of the flat tables in a folder with the place they hang at: src, parent_key, path, leaf."""
    out = None
    for src, tag, name in LEAVES:
        rows = read_table(spark, folder, src, tag).where("leaf is not null").select(F.lit(name).alias("src"), F.col("key").alias("parent_key"), "path", "leaf")
        rows = rows.distinct() if src == "raw_results" else rows  # results may bear one number twice
        out = rows if out is None else out.unionByName(rows)
    return out
