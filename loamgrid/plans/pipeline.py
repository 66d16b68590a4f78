"""Queries of the retrieval and evaluation pipeline over the whole test tables, each with its SQL where SQL can say it.

Rows delivered again count once. Words are searched for by all test items; vectors by the rows whose id is divisible by 100; both against all rows.
Wide columns are cut down to what a query needs before rows are made distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions.text import NOISE, SENTENCE_ENDS, STOPWORDS, clean_lines, sentences, stripped, words
from loamgrid.operators import evaluate, layout, ports, retrieve, segment
from loamgrid.sources import tables
from loamgrid.session import fresh, fresh_rows, shared_folder, spread_out, table
from loamgrid.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _pages(spark: SparkSession, folder: str, *columns) -> DataFrame:
    return fresh(table(spark, folder, "page_records").select("page_id", *columns), "page_id")


def _chunks(spark: SparkSession, folder: str, *columns) -> DataFrame:
    return fresh(table(spark, folder, "chunks").select("chunk_id", *columns), "chunk_id")


def _results(spark: SparkSession, folder: str, *columns) -> DataFrame:
    return fresh(table(spark, folder, "eval_results").select("result_id", *columns), "result_id")


def _wide(spark: SparkSession, folder: str, name: str, key: str, *columns) -> DataFrame:
    """The same with columns that are too wide to be shuffled."""
    return fresh_rows(spread_out(table(spark, folder, name).select(key, *columns)), key)


_ONE_PAGE = "(SELECT * FROM page_records QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY extracted_at) = 1)"
_ONE_CHUNK = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"
_ONE_RESULT = "(SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY received_at) = 1)"


def _strip(x: str) -> str:
    blanks = r"[ \t\r\n\x0B\x0C\x{00A0}\x{3000}]+"
    return f"regexp_replace({x}, '^{blanks}|{blanks}$', '', 'g')"


def _sentences_of(x: str) -> str:
    pattern = f"([^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+)"
    return f"list_filter(list_transform(regexp_extract_all({x}, '{pattern}', 1), lambda x: {_strip('x')}), lambda x: x <> '')"


def _words_of(x: str) -> str:
    return rf"""list_filter(flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '(\p{{Han}}+|[A-Za-z0-9]+)', 1), lambda r:
  CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN [r] WHEN length(r) < 2 THEN [] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i::INT, 2)) END)),
  lambda w: (length(w) > 1 OR regexp_matches(w, '^[0-9]$')) AND NOT list_contains({list(STOPWORDS)}, w))"""


def _form_of(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[,，\s　]', '', 'g'))"


# --- segmentation -----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, i::INT AS pos, md5(s[i + 1]) AS sentence FROM (SELECT doc_id, {_sentences_of('text')} AS s FROM documents), range(0, len(s)) AS r(i)")
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.md5("s").alias("sentence"))


def _chunk_sql(copies: bool) -> str:
    extra = "" if copies else " AND (lastb IS NULL OR lastb < n - 1)"
    return f"""
WITH RECURSIVE s AS (SELECT doc_id, {_sentences_of("text")} AS ss FROM documents),
p AS (SELECT doc_id, ss, len(ss) AS n, list_prepend(0, list_transform(range(1, len(ss) + 1), lambda k: list_sum(list_transform(ss[1:k], lambda x: length(x))))) AS e FROM s WHERE len(ss) > 0),
w AS (
  SELECT doc_id, n, e, 0::BIGINT AS i, 0::BIGINT AS f, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS lastb, 0::BIGINT AS k FROM p
  UNION ALL
  SELECT doc_id, n, e, i + 1,
    CASE WHEN e[i + 2] - e[f + 1] >= 800 THEN coalesce(list_max(list_filter(range(f, i + 1), lambda j: e[i + 2] - e[j + 1] >= 120)), f) ELSE f END,
    CASE WHEN e[i + 2] - e[f + 1] >= 800 THEN f END, CASE WHEN e[i + 2] - e[f + 1] >= 800 THEN i END,
    CASE WHEN e[i + 2] - e[f + 1] >= 800 THEN i ELSE lastb END, k + CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END
  FROM w WHERE i < n),
pieces AS (
  SELECT doc_id, k, a, b FROM w WHERE a IS NOT NULL
  UNION ALL
  SELECT doc_id, k + CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END, f, n - 1 FROM w WHERE i = n AND e[n + 1] - e[f + 1] > 20{extra})
SELECT doc_id, k::INT AS piece_no, md5(array_to_string(ss[a + 1:b + 1], '')) AS piece, (e[b + 2] - e[a + 1])::INT AS chars FROM pieces JOIN p USING (doc_id)"""


def _chunk_text(spark: SparkSession, folder: str, copies: bool) -> DataFrame:
    rows = segment.chunk_text(spread_out(table(spark, folder, "documents").select("doc_id", "text")), "text", copies)
    return rows.select("doc_id", "piece_no", F.md5("piece").alias("piece"), F.length("piece").alias("chars"))


@query(_chunk_sql(True))
def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_text(spark, folder, True)


@query(_chunk_sql(False))
def chunk_text_dedup_tail(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_text(spark, folder, False)


_LINES = f"""SELECT page_id, code, page, t AS table_no,
  list_filter(list_concat(CASE WHEN coalesce(tables[t + 1].title, '') <> '' THEN ['【表】' || tables[t + 1].title] ELSE [] END,
    list_transform(coalesce(tables[t + 1].rows, []), lambda r: coalesce(array_to_string(list_filter(list_transform(r, lambda c: {_strip("c")}), lambda c: c <> ''), ' | '), ''))), lambda l: l <> '') AS lines
  FROM {_ONE_PAGE}, range(0, len(tables)) AS r(t)"""


@query(f"WITH l AS ({_LINES}) SELECT page_id, table_no::INT AS table_no, k::INT AS piece_no, md5(array_to_string(lines[k * 14 + 1:k * 14 + 14], chr(10))) AS piece FROM l, range(0, (len(lines) + 13) // 14) AS r(k)")
def table_chunk(spark: SparkSession, folder: str) -> DataFrame:
    rows = segment.chunk_tables(_wide(spark, folder, "page_records", "page_id", "tables").where("tables is not null"), "tables")
    return rows.select("page_id", "table_no", "piece_no", F.md5("piece").alias("piece"))


@query()
def chunk_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """No SQL: the recursive walk of every page is too slow there; tested against a plain version on a small fixture."""
    rows = segment.chunk_catalog(_wide(spark, folder, "page_records", "page_id", "code", "name", "section", "page", "text", "tables"))
    return rows.select("chunk_id", "code", "page", "seq", "kind", F.md5("embed_text").alias("embed_text"))


@query(f"SELECT code, kind, count(*)::BIGINT AS chunks, sum(length(text))::BIGINT AS chars, count(DISTINCT page)::BIGINT AS pages, count(DISTINCT section)::BIGINT AS sections FROM {_ONE_CHUNK} GROUP BY ROLLUP (code, kind)")
def corpus_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder, "code", "kind", "page", "section", F.length("text").alias("n"))
    return rows.rollup("code", "kind").agg(F.count("*").alias("chunks"), F.sum("n").alias("chars"), F.countDistinct("page").alias("pages"), F.countDistinct("section").alias("sections"))


@query(f"SELECT code, count(*)::BIGINT AS chunks, count_if(kind = 'text')::BIGINT AS n_text, count_if(kind = 'table')::BIGINT AS n_table, list_sort(list(DISTINCT section)) AS sections FROM {_ONE_CHUNK} GROUP BY code")
def chunk_stats_by_company(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder, "code", "kind", "section")
    return rows.groupBy("code").agg(F.count("*").alias("chunks"), F.count_if(F.col("kind") == "text").alias("n_text"), F.count_if(F.col("kind") == "table").alias("n_table"), F.array_sort(F.collect_set("section")).alias("sections"))


# --- words and lexical index ------------------------------------------------------------------------------------------

_TOKENS = f"SELECT chunk_id AS id, {_words_of('coalesce(embed_text, text)')} AS tokens FROM {_ONE_CHUNK}"


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(spark, folder, "chunks", "chunk_id", F.coalesce("embed_text", "text").alias("body"))


def _index(spark: SparkSession, folder: str) -> retrieve.Index:
    return retrieve.write_index(_corpus(spark, folder), "chunk_id", "body", shared_folder(spark, "index"))


@query(f"SELECT id AS chunk_id, len(tokens)::BIGINT AS n_tokens, len(list_distinct(tokens))::BIGINT AS n_distinct FROM ({_TOKENS})")
def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").select("chunk_id", words(F.coalesce("embed_text", "text")).alias("w"))
    return fresh(rows.select("chunk_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct")), "chunk_id")


@query(
    f"WITH t AS ({_TOKENS}), d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM t) GROUP BY term), n AS (SELECT count(*) AS n FROM t) SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM d, n"
)
def vocab_idf(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).vocabulary.withColumn("idf", F.round("idf", 6))


@query(f"SELECT count(*)::BIGINT AS n, round(avg(len(tokens)), 6) AS avgdl FROM ({_TOKENS})")
def corpus_bm25_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).stats.withColumn("avgdl", F.round("avgdl", 6))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """All test items as queries."""
    return table(spark, folder, "eval_items").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def _bm25_sql(tokens: str) -> str:
    return f"""t AS ({tokens}), n AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
asked AS (SELECT DISTINCT item_id AS qid, unnest({_words_of("text")}) AS term FROM eval_items),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM t) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM tf JOIN d USING (term) JOIN asked USING (term), n GROUP BY qid, id),
lexical AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM b QUALIFY rank <= 20 AND score > 0)"""


@query(f"WITH {_bm25_sql(_TOKENS)} SELECT qid, id AS chunk_id, rank::INT AS rank, round(score, 6) AS score FROM lexical")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieve.bm25_topk(_asked(spark, folder), _index(spark, folder))
    return rows.select("qid", F.col("id").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


# --- vectors and fusion -----------------------------------------------------------------------------------------------


@query("SELECT vec_id, i::INT AS pos, round(embedding[i + 1]::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS value FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings), range(0, len(embedding)) AS r(i)")
def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(retrieve.unit(F.col("embedding"))).alias("pos", "value"))
    return rows.withColumn("value", F.round("value", 6))


_UNIT = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_DENSE = f"SELECT q.vec_id AS qid, e.vec_id AS id, list_dot_product(q.v, e.v) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, e.v), 9) DESC, e.vec_id) AS rank FROM {_UNIT} q, {_UNIT} e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20"


@query(f"SELECT qid, id, rank::INT AS rank, round(score, 6) AS score FROM ({_DENSE})")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    found = retrieve.vector_topk(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), rows, "vec_id", "embedding")
    return found.withColumn("score", F.round("score", 6))


# The tables don't say which vector is whose: an item's is that of the same place, and so is a document's. Documents beyond the last
# vector have none and are found by words only.
_DOC_TOKENS = f"SELECT doc_id AS id, {_words_of('text')} AS tokens FROM documents"
_HYBRID = f"""WITH {_bm25_sql(_DOC_TOKENS)}, base AS (SELECT min(doc_id) AS least FROM documents), many AS (SELECT count(*) AS m FROM embeddings),
mine AS (SELECT item_id AS qid, (item_id - (SELECT min(item_id) FROM eval_items)) % m AS vec_id FROM eval_items, many),
dense AS (SELECT qid, e.vec_id + least AS id, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(q.v, e.v), 9) DESC, e.vec_id) AS rank FROM mine JOIN {_UNIT} q USING (vec_id), {_UNIT} e, base QUALIFY rank <= 20),
fused AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.id, l.id) AS id, d.rank AS vector_rank, l.rank AS bm25_rank, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS rrf FROM dense d FULL OUTER JOIN lexical l ON d.qid = l.qid AND d.id = l.id),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, id) AS rank FROM fused QUALIFY rank <= 8)"""


def _both_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents, vectors, asked = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "embeddings"), _asked(spark, folder)
    many, first = vectors.agg(F.count("*").alias("m")), asked.agg(F.min("qid").alias("first"))  # one row each
    mine = asked.join(F.broadcast(many)).join(F.broadcast(first)).select("qid", ((F.col("qid") - F.col("first")) % F.col("m")).alias("vec_id"))
    queries = mine.join(vectors, "vec_id").select("qid", F.col("embedding").alias("v"))
    dense = retrieve.vector_topk(queries, vectors, "vec_id", "embedding").join(F.broadcast(documents.agg(F.min("doc_id").alias("least"))))  # one row
    index = retrieve.write_index(spread_out(documents), "doc_id", "text", shared_folder(spark, "index"))
    return dense.withColumn("id", F.col("id") + F.col("least")).drop("least"), retrieve.bm25_topk(asked, index)


@query(_HYBRID + " SELECT qid, id AS doc_id, vector_rank::INT AS vector_rank, bm25_rank::INT AS bm25_rank, round(rrf, 6) AS rrf, rank::INT AS rank FROM best")
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieve.fuse(*_both_lists(spark, folder))
    return rows.select("qid", F.col("id").alias("doc_id"), "vector_rank", "bm25_rank", F.round("rrf", 6).alias("rrf"), "rank")


@query(_HYBRID + " SELECT qid, count(vector_rank)::BIGINT AS n_vector, count(bm25_rank)::BIGINT AS n_bm25, count(*)::BIGINT AS n_either FROM fused GROUP BY qid")
def hybrid_candidate_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieve.fused(*_both_lists(spark, folder))
    return rows.groupBy("qid").agg(F.count("vector_rank").alias("n_vector"), F.count("bm25_rank").alias("n_bm25"), F.count("*").alias("n_either"))


_HITS = f"SELECT result_id, c.company AS company, c.chunk_id AS chunk_id, c.rrf_score AS score FROM (SELECT result_id, unnest(chunks) AS c FROM {_ONE_RESULT})"


@query(f"WITH h AS ({_HITS}), g AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY result_id, company ORDER BY round(score, 9) DESC, chunk_id DESC) = 1) SELECT result_id, company, chunk_id, row_number() OVER (PARTITION BY result_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS place FROM g")
def group_top1_then_rank(spark: SparkSession, folder: str) -> DataFrame:
    hits = F.transform("chunks", lambda c: F.struct(c["company"].alias("company"), c["chunk_id"].alias("chunk_id"), c["rrf_score"].alias("score")))
    rows = _results(spark, folder, hits.alias("hits")).select("result_id", F.explode("hits").alias("c")).select("result_id", "c.*")
    return retrieve.group_best(rows, ["result_id", "company"], "score", "chunk_id").select("result_id", "company", "chunk_id", "place")


@query(
    f"SELECT result_id, md5(string_agg('[' || c.idx || '] ' || c.company || '（' || split_part(c.chunk_id, '-', 1) || '） ' || CASE WHEN coalesce(c.section, '') = '' THEN '未标注' ELSE c.section END || ' 第' || c.page || '页 ' || c.kind || chr(10) || coalesce(c.snippet, ''), chr(10) || chr(10) ORDER BY c.idx)) AS prompt FROM (SELECT result_id, unnest(chunks) AS c FROM {_ONE_RESULT}) GROUP BY result_id"
)
def prompt_blocks(spark: SparkSession, folder: str) -> DataFrame:
    def block(c):
        return retrieve.prompt_block(c["idx"], c["company"], F.split_part(c["chunk_id"], F.lit("-"), F.lit(1)), c["section"], c["page"], c["kind"], c["snippet"])

    ordered = F.array_sort("chunks", lambda a, b: a["idx"] - b["idx"])
    made = F.when(F.size("chunks") > 0, F.md5(F.array_join(F.transform(ordered, block), "\n\n")))
    return _results(spark, folder, made.alias("prompt")).where("prompt is not null")


@query("WITH d AS (SELECT doc_id - (SELECT min(doc_id) FROM documents) AS id FROM documents) SELECT count(*)::BIGINT AS n_docs, count(vec_id)::BIGINT AS n_matched, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM d))::BIGINT AS n_orphans, count(DISTINCT len(embedding))::BIGINT AS n_dimensions FROM d LEFT JOIN embeddings ON id = vec_id")
def vector_alignment_guard(spark: SparkSession, folder: str) -> DataFrame:
    documents, vectors = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "embeddings").select("vec_id", F.size("embedding").alias("dims"))
    least = documents.agg(F.min("doc_id").alias("least"))
    ids = documents.join(F.broadcast(least)).select((F.col("doc_id") - F.col("least")).alias("id"))
    both = ids.join(vectors, F.col("id") == F.col("vec_id"), "full_outer")
    return both.agg(
        F.count("id").alias("n_docs"),
        F.count_if(F.col("id").isNotNull() & F.col("vec_id").isNotNull()).alias("n_matched"),
        F.count_if(F.col("id").isNull()).alias("n_orphans"),
        F.countDistinct(F.when(F.col("id").isNotNull(), F.col("dims"))).alias("n_dimensions"),
    )


# --- structure --------------------------------------------------------------------------------------------------------

_MARKS = f"SELECT code, section, min(page) AS page FROM {_ONE_PAGE} WHERE section <> '' GROUP BY code, section"


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, "code", "section", "page").where("section <> ''").groupBy("code", "section").agg(F.min("page").alias("page"))


@query(f"WITH m AS ({_MARKS}), last AS (SELECT code, page, max(section) AS section FROM m GROUP BY code, page) SELECT p.page_id, coalesce(m.section, '') AS section FROM {_ONE_PAGE} p ASOF LEFT JOIN last m ON p.code = m.code AND p.page >= m.page")
def section_asof(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.as_of(_pages(spark, folder, "code", "page"), _marks(spark, folder), "code", "page", "section")
    return rows.select("page_id", "section")


@query(f"WITH m AS ({_MARKS}), u AS (SELECT code, page, max(section) AS section FROM m GROUP BY code, page), t AS (SELECT code, max(page) AS pages FROM {_ONE_PAGE} GROUP BY code) SELECT code, section, page, (coalesce(lead(page) OVER (PARTITION BY code ORDER BY page), pages + 1) - page)::INT AS span FROM u JOIN t USING (code)")
def section_span(spark: SparkSession, folder: str) -> DataFrame:
    marks = _marks(spark, folder).groupBy("code", "page").agg(F.max("section").alias("section"))
    total = table(spark, folder, "page_records").groupBy("code").agg(F.max("page").alias("pages"))
    return layout.spans(marks, "code", "page", total, "pages").select("code", "section", "page", "span")


_TABULAR = r"""len(list_filter(r, lambda c: trim(c) <> '')) >= 2 AND len(list_filter(r, lambda c: trim(c) <> '' AND regexp_matches(c, '^[0-9,.()\-—/%．，（） ]+$'))) >= greatest(1, len(list_filter(r, lambda c: trim(c) <> '')) // 2)"""
_ROWS = f"SELECT page_id, t::INT AS table_no, j::INT AS row_no, tables[t + 1].rows[j + 1] AS r FROM {_ONE_PAGE}, range(0, len(tables)) AS a(t), range(0, len(tables[t + 1].rows)) AS b(j)"


def _table_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _wide(spark, folder, "page_records", "page_id", "tables").select("page_id", F.posexplode("tables").alias("table_no", "t"))
    return rows.select("page_id", "table_no", F.posexplode("t.rows").alias("row_no", "r"))


@query(
    f"WITH f AS (SELECT *, coalesce({_TABULAR}, false) AS ok, row_number() OVER (PARTITION BY page_id, table_no ORDER BY row_no) AS rn FROM ({_ROWS})), g AS (SELECT *, rn - row_number() OVER (PARTITION BY page_id, table_no ORDER BY row_no) AS island FROM f WHERE ok) SELECT page_id, table_no, min(row_no)::INT AS first, max(row_no)::INT AS last, count(*)::BIGINT AS n FROM g GROUP BY page_id, table_no, island HAVING count(*) >= 3"
)
def table_islands(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table_rows(spark, folder).withColumn("ok", F.coalesce(layout.tabular_row(F.col("r")), F.lit(False)))
    return layout.islands(rows, ["page_id", "table_no"], ["row_no"], "ok", 3)


@query(
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) SELECT user_id, event_type, count(*)::BIGINT AS n, min(ts) AS began FROM e GROUP BY user_id, event_type, island HAVING count(*) >= 3"
)
def event_islands(spark: SparkSession, folder: str) -> DataFrame:
    # Numbers are counted day by day, so that a user with most events isn't one task.
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts", F.to_date("ts").alias("day"))
    rows = segment.running_number(rows, "user_id", "day", ["ts", "event_id"], "among_all")
    rows = segment.running_number(rows, ["user_id", "event_type"], "day", ["ts", "event_id"], "among_same")
    rows = rows.withColumn("island", F.col("among_all") - F.col("among_same"))
    return rows.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), F.min("ts").alias("began")).where("n >= 3").drop("island")


@query(
    f"WITH t AS (SELECT page_id, unnest(range(0, len(tables))) AS k, tables FROM {_ONE_PAGE}), c AS (SELECT page_id, k, list_filter(list_transform(tables[k + 1].rows, lambda r: list_filter(r, lambda c: trim(c) <> '')), lambda r: len(r) > 0) AS r FROM t) SELECT page_id, k::INT AS table_no FROM c WHERE len(r) >= 3 AND list_max(list_transform(r, lambda x: len(x))) BETWEEN 2 AND 12 AND list_sum(list_transform(flatten(r), lambda x: length(x))) / len(flatten(r)) <= 24"
)
def fit_tables(spark: SparkSession, folder: str) -> DataFrame:
    rows = _wide(spark, folder, "page_records", "page_id", "tables").select("page_id", F.posexplode("tables").alias("table_no", "t"))
    return rows.where(layout.fit_table(F.col("t"))).select("page_id", "table_no")


@query(f"WITH t AS (SELECT page_id, unnest(range(0, len(tables))) AS k, tables FROM {_ONE_PAGE}), d AS (SELECT page_id, k, coalesce(tables[k + 1].degraded, false) AS degraded FROM t WHERE tables[k + 1] IS NOT NULL) SELECT page_id, k::INT AS table_no, degraded FROM d WHERE NOT degraded OR page_id NOT IN (SELECT page_id FROM d WHERE NOT degraded)")
def primary_or_fallback_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables as they were found, and tables put together from items only on pages without such tables."""
    flags = F.transform("tables", lambda t: F.when(t.isNotNull(), F.coalesce(t["degraded"], F.lit(False))))
    rows = _pages(spark, folder, flags.alias("flags")).select("page_id", F.posexplode("flags").alias("table_no", "degraded")).where("degraded is not null")
    primary = rows.where("not degraded")
    return primary.unionByName(rows.where("degraded").join(primary.select("page_id").distinct(), "page_id", "left_anti"))


_CONTENTS = f"SELECT code, section, min(page) AS page FROM {_ONE_CHUNK} WHERE section <> '' GROUP BY code, section"
_OFFSETS = f"""WITH b AS ({_MARKS}), c AS ({_CONTENTS}),
  x AS (SELECT b.code, b.page - c.page AS d FROM b JOIN c ON b.code = c.code AND (contains(b.section, c.section) OR contains(c.section, b.section)) QUALIFY row_number() OVER (PARTITION BY b.code, b.section ORDER BY c.page, c.section) = 1),
  y AS (SELECT code, d, count(*) AS n FROM x GROUP BY code, d)
SELECT code, CASE WHEN sum(n) >= 2 THEN arg_max(d, (n, -d)) ELSE 0 END::INT AS page_offset FROM y GROUP BY code"""


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and their first pages by the chunks, in the place of a table of contents."""
    return _chunks(spark, folder, "code", "section", "page").where("section <> ''").groupBy("code", "section").agg(F.min("page").alias("page"))


@query(_OFFSETS)
def offset_mode(spark: SparkSession, folder: str) -> DataFrame:
    return layout.page_offset(_marks(spark, folder), _contents(spark, folder))


@query(
    f"WITH o AS ({_OFFSETS}), b AS ({_MARKS}), c AS ({_CONTENTS}), t AS (SELECT code, max(page) AS pages FROM {_ONE_PAGE} GROUP BY code), m AS (SELECT code, section, least(pages, greatest(1, page + coalesce(page_offset, 0))) AS moved FROM c LEFT JOIN o USING (code) JOIN t USING (code)) SELECT code, section, coalesce(b.page, moved)::INT AS page FROM m FULL OUTER JOIN b USING (code, section)"
)
def section_map(spark: SparkSession, folder: str) -> DataFrame:
    body, contents = _marks(spark, folder), _contents(spark, folder)
    pages = table(spark, folder, "page_records").groupBy("code").agg(F.max("page").alias("pages"))
    return layout.merged_sections(body, contents, layout.page_offset(body, contents), pages)


@query(f"SELECT code, section, min(origin) AS origin, min_by(page, (origin, page))::INT AS page FROM (SELECT code, section, page, 1 AS origin FROM ({_MARKS}) UNION ALL SELECT code, section, page, 2 FROM ({_CONTENTS})) GROUP BY code, section")
def section_union(spark: SparkSession, folder: str) -> DataFrame:
    """Sections that pages or chunks know, each once; what the pages say goes first."""
    both = _marks(spark, folder).withColumn("origin", F.lit(1)).unionByName(_contents(spark, folder).withColumn("origin", F.lit(2)))
    return both.groupBy("code", "section").agg(F.min("origin").alias("origin"), F.min_by("page", F.struct("origin", "page")).alias("page"))


@query(f"SELECT p.page_id, coalesce(t.ids, []) AS table_chunks FROM (SELECT DISTINCT page_id, code, page FROM page_records) p LEFT JOIN (SELECT code, page, list_sort(list(DISTINCT chunk_id)) AS ids FROM chunks WHERE kind = 'table' GROUP BY code, page) t USING (code, page)")
def page_table_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each page with its table chunks, an empty list where it has none."""
    ids = table(spark, folder, "chunks").where("kind = 'table'").groupBy("code", "page").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))  # a page's chunks are few
    rows = _pages(spark, folder, "code", "page").join(ids, ["code", "page"], "left")
    return rows.select("page_id", F.coalesce("ids", F.array().cast("array<string>")).alias("table_chunks"))


@query(f"SELECT DISTINCT page_id, code FROM page_records WHERE code IN (SELECT code FROM {{}} WHERE status IS NOT NULL AND status NOT IN ('failed', 'no_report'))".format("(SELECT DISTINCT * FROM manifest QUALIFY row_number() OVER (PARTITION BY code ORDER BY updated_at DESC NULLS LAST, url DESC NULLS LAST, size DESC NULLS LAST, title DESC NULLS LAST) = 1)"))
def usable_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of companies whose last attempt brought a report."""
    latest = tables.latest(table(spark, folder, "manifest"), "code", "updated_at", "url", "size", "title").where("status is not null and status not in ('failed', 'no_report')")
    return tables.of_companies(_pages(spark, folder, "code"), latest).select("page_id", "code")


@query(f"SELECT chunk_id, md5(text) AS body FROM {_ONE_CHUNK} WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY chunk_id) = 1")
def first_occurrence_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").where("text is not null").select("chunk_id", F.md5("text").alias("body"))
    return rows.groupBy("body").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id", "body")


_NOISE = "^(" + "|".join(NOISE) + ")"


@query(f"SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, chr(160), ' '), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '{_NOISE}')), chr(10))) AS cleaned FROM {_ONE_PAGE}")
def noise_line_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, F.md5(clean_lines(F.col("text"))).alias("cleaned"))


@query(f"SELECT page_id, (i - 1)::INT AS pos, l[i] AS line FROM (SELECT page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')[1:8] AS l FROM {_ONE_PAGE}), range(1, len(l) + 1) AS r(i)")
def head_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, layout.head_lines(F.col("text")).alias("x")).select("page_id", F.posexplode("x").alias("pos", "line"))


_FREE = r"NOT regexp_matches(x, '[0-9，,。、；;：:（）()【】\[\]｜|/\\%#@]') AND regexp_matches(x, '[一-鿿]')"
_SECTION_WORD = rf"length(x) BETWEEN 2 AND 24 AND NOT regexp_matches(x, '{layout.BARE_HEADING}') AND (regexp_matches(x, '{layout.HEADING}') OR ({_FREE}))"
_CONTENTS_NAME = rf"x <> '' AND NOT regexp_matches(x, '^({'|'.join(layout.NO_SECTION)})') AND NOT regexp_matches(x, '{_NOISE}') AND length(x) <= 30 AND NOT regexp_matches(x, '[。；]$') AND (regexp_matches(x, '{layout.HEADING}') OR NOT regexp_matches(x, '[，,、；;：:（）()【】]'))"


@query(f"WITH l AS (SELECT source, {_strip('unnest(string_split(text, chr(10)))')} AS x FROM documents) SELECT source, count(*)::BIGINT AS n, count_if({_SECTION_WORD})::BIGINT AS n_section_words, count_if({_CONTENTS_NAME})::BIGINT AS n_contents_names FROM l WHERE x <> '' GROUP BY source")
def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each source, and how many could be names of sections or names in a list of contents."""
    lines = F.filter(F.transform(F.split("text", "\n"), stripped), lambda x: x != "")
    kinds = F.struct(F.size(lines).alias("n"), *[F.size(F.filter(lines, f)).alias(n) for n, f in (("n_section_words", layout.section_word), ("n_contents_names", lambda x: layout.contents_name(x)))])
    rows = table(spark, folder, "documents").where("text is not null").select("source", kinds.alias("x")).select("source", "x.*")
    return rows.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "n_section_words", "n_contents_names")]).where("n > 0")


_HEADING = "^[一二三四五六七八九十]{1,3}、(.{2,24})$"


@query(f"WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT source, regexp_extract(line, '{_HEADING}', 1) AS heading, min(doc_id) AS first_doc, count(DISTINCT doc_id)::BIGINT AS docs FROM l WHERE regexp_matches(line, '{_HEADING}') GROUP BY ALL")
def heading_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_HEADING))
    rows = rows.groupBy("source", F.regexp_extract("line", _HEADING, 1).alias("heading"), "doc_id").agg(F.lit(1).alias("x"))
    return rows.groupBy("source", "heading").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("docs"))


def _trusted_sql() -> str:
    known, organisations = "|".join(layout.KNOWN_SECTIONS), "|".join(layout.ORG_NAMES)
    clean = r"length(section) BETWEEN 3 AND 20 AND NOT regexp_matches(section, '[，,。、；;：:（）()【】\[\]｜|/\\%#@]') AND NOT regexp_matches(section, '[0-9]') AND NOT regexp_matches(section, '[A-Za-z]{2,}') AND han > 1"
    return f"""WITH m AS ({_MARKS}), u AS (SELECT code, page, max(section) AS section FROM m GROUP BY code, page), t AS (SELECT code, max(page) AS pages FROM {_ONE_PAGE} GROUP BY code),
s AS (SELECT code, section, page, coalesce(lead(page) OVER (PARTITION BY code ORDER BY page), pages + 1) - page AS span, len(regexp_extract_all(section, '[一-鿿]')) AS han FROM u JOIN t USING (code)),
k AS (SELECT code, section, page, span FROM s WHERE NOT regexp_matches(section, '[\x00-\x1f\x7f]') AND NOT regexp_matches(section, '{organisations}') AND han >= 2 AND section NOT IN {layout.GROUP_TITLES} AND (regexp_matches(section, '{known}') OR ({clean} AND span >= 5)))
SELECT code, section FROM k QUALIFY count(*) OVER (PARTITION BY code) <= 30 OR row_number() OVER (PARTITION BY code ORDER BY span DESC, page, section) <= 15"""


@query(_trusted_sql())
def trusted_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections with known names and clean names of at least five pages; of more than 30 the widest 15 of each company."""
    return layout.trusted(section_span(spark, folder)).select("code", "section")


@query(f"SELECT count(*)::BIGINT AS n, count_if(embed_text IS NULL)::BIGINT AS n_missing, count_if(embed_text = company || '（' || code || '） ' || coalesce(section, '') || chr(10) || text)::BIGINT AS n_equal FROM {_ONE_CHUNK}")
def embed_text_check(spark: SparkSession, folder: str) -> DataFrame:
    made = F.concat("company", F.lit("（"), "code", F.lit("） "), F.coalesce("section", F.lit("")), F.lit("\n"), "text")
    rows = _chunks(spark, folder, F.col("embed_text").isNull().alias("missing"), (F.col("embed_text") == made).alias("equal"))
    return rows.agg(F.count("*").alias("n"), F.count_if("missing").alias("n_missing"), F.count_if("equal").alias("n_equal"))


@query("WITH done AS (SELECT DISTINCT sha256(coalesce(embed_text, '')) AS content FROM chunks WHERE ingested_at < TIMESTAMP '2026-03-05') SELECT DISTINCT chunk_id, sha256(coalesce(embed_text, '')) AS content FROM chunks WHERE sha256(coalesce(embed_text, '')) NOT IN (SELECT content FROM done)")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """What a run that is taken up again has still to embed."""
    rows = table(spark, folder, "chunks")
    done = rows.where(F.col("ingested_at") < F.lit("2026-03-05").cast("timestamp")).select(F.sha2(F.coalesce("embed_text", F.lit("")), 256).alias("content")).distinct()
    return ports.pending(rows.select("chunk_id", "embed_text"), "embed_text", done).select("chunk_id", "content").distinct()


# --- evidence and evaluation ------------------------------------------------------------------------------------------


@query(f"SELECT page_id, replace(substring(text, greatest(instr(text, '复核') - 60, 1), 320), chr(10), ' ') AS snippet FROM {_ONE_PAGE} WHERE contains(text, '复核') AND contains(text, '准备金')")
def keyword_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return _keyword_evidence(spark, folder).select("page_id", "snippet")


def _keyword_evidence(spark: SparkSession, folder: str) -> DataFrame:
    both = F.contains("text", F.lit("复核")) & F.contains("text", F.lit("准备金"))
    snippet = F.replace(F.substring("text", F.greatest(F.instr("text", "复核") - 60, F.lit(1)), F.lit(320)), F.lit("\n"), F.lit(" "))
    return fresh(table(spark, folder, "page_records").where(both).select("page_id", "code", "page", snippet.alias("snippet")), "page_id")


@query(f"SELECT code, page, replace(substring(text, greatest(instr(text, '复核') - 60, 1), 320), chr(10), ' ') AS snippet FROM {_ONE_PAGE} WHERE contains(text, '复核') AND contains(text, '准备金') QUALIFY row_number() OVER (PARTITION BY code ORDER BY page) <= 3")
def keyword_evidence_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first three pieces of evidence of each company."""
    place = F.row_number().over(Window.partitionBy("code").orderBy("page"))
    return _keyword_evidence(spark, folder).withColumn("place", place).where("place <= 3").select("code", "page", "snippet")


@query(f"WITH m AS (SELECT page_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substring(text, i::INT, 4) = '营业收入')) AS spot FROM {_ONE_PAGE}) SELECT page_id, spot::INT AS spot, md5(substring(text, spot::INT, 60)) AS evidence FROM m")
def regex_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "page_records").where(F.contains("text", F.lit("营业收入")))
    # Tails may overlap, so each match is found by its place: the lengths of what stands before it.
    parts = F.transform(F.split("text", "营业收入"), F.length)
    places = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), (i - 1) * 4 + 1, lambda s, n: s + n))
    found = F.transform(places, lambda spot: F.struct(spot.alias("spot"), F.md5(F.col("text").substr(spot, F.lit(60))).alias("evidence")))
    return fresh(rows.select("page_id", found.alias("found")), "page_id").select("page_id", F.explode("found").alias("x")).select("page_id", "x.*")


@query("WITH n AS (SELECT DISTINCT name FROM manifest WHERE name IS NOT NULL) SELECT question_id, name FROM questions, n WHERE contains(q, name)")
def alias_match(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "manifest").where("name is not null").select("name").distinct()
    return evaluate.spotted(table(spark, folder, "questions").select("question_id", "q"), "question_id", "q", names)


@query(f"SELECT result_id, company FROM (SELECT result_id, companies_recalled, unnest(list_distinct(need_companies)) AS company FROM {_ONE_RESULT}) WHERE NOT coalesce(list_contains(companies_recalled, company), false)")
def missed_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _results(spark, folder, "need_companies", "companies_recalled")
    missed = F.array_except("need_companies", F.coalesce("companies_recalled", F.array().cast("array<string>")))
    return rows.select("result_id", F.explode(missed).alias("company"))


_CITED = r"list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d{1,2})\]', 1), lambda x: x::INT)"


@query(
    f"WITH r AS (SELECT result_id, chunks, list_filter(list_distinct({_CITED}), lambda x: x >= 1 AND x <= coalesce(len(chunks), 0)) AS used, unnest(list_distinct(need_companies)) AS company FROM {_ONE_RESULT}), k AS (SELECT result_id, company, used, list_sort(list_transform(list_filter(coalesce(chunks, []), lambda c: c.company = company), lambda c: c.idx)) AS idxs FROM r) SELECT result_id, company, len(idxs) > 0 AS covered, len(idxs)::INT AS n_chunks, idxs AS chunk_idxs, len(list_intersect(idxs, used)) > 0 AS cited FROM k"
)
def coverage_matrix(spark: SparkSession, folder: str) -> DataFrame:
    slim = F.transform("chunks", lambda c: F.struct(c["idx"].alias("idx"), c["company"].alias("company")))
    return evaluate.coverage(_wide(spark, folder, "eval_results", "result_id", "answer", slim.alias("chunks"), "need_companies"))


@query(f"SELECT result_id, company FROM (SELECT result_id, coalesce(need_companies, []) AS need, unnest(list_distinct(companies_recalled)) AS company FROM {_ONE_RESULT}) WHERE NOT list_contains(need, company)")
def not_targeted(spark: SparkSession, folder: str) -> DataFrame:
    """Companies that were recalled without being asked for."""
    return evaluate.not_targeted(_results(spark, folder, "need_companies", "companies_recalled"))


@query(f"SELECT result_id, list_sort(list_filter(list_distinct({_CITED}), lambda x: x >= 1 AND x <= coalesce(len(chunks), 0))) AS used, list_sort(list_filter(list_distinct({_CITED}), lambda x: x < 1 OR x > coalesce(len(chunks), 0))) AS hallucinated FROM {_ONE_RESULT}")
def citation_check(spark: SparkSession, folder: str) -> DataFrame:
    used, missing = evaluate.checked_citations(F.col("answer"), F.col("chunks"))
    return _results(spark, folder, used.alias("used"), missing.alias("hallucinated"))


_GRADED = f"""WITH r AS (SELECT e.result_id, e.kind, e.no, e.question, e.answer, e.evidence, e.companies_recalled, e.chunks, coalesce(e.recall_ok, false) AS recall_ok, coalesce(q.expect_reject, false) AS reject, coalesce(q.expect, []) AS any_of, coalesce(q.expect_all, []) AS all_of
  FROM {_ONE_RESULT} e JOIN questions q USING (question_id)),
w AS (SELECT *, len(all_of) > 0 AS strict, CASE WHEN len(all_of) > 0 THEN all_of ELSE any_of END AS wanted FROM r),
h AS (SELECT *, list_filter(wanted, lambda x: contains({_form_of("coalesce(answer, '')")}, {_form_of("x")})) AS hits FROM w),
g AS (SELECT *, CASE WHEN trim(coalesce(answer, '')) = '' THEN '错误'
  WHEN reject THEN CASE WHEN regexp_matches(regexp_replace(answer, '[,，\\s　]', '', 'g'), '{"|".join(evaluate.SAID_NO)}') AND NOT regexp_matches(answer, '[0-9]+\\.?[0-9]*\\s*亿') THEN '正确' ELSE '错误' END
  WHEN strict THEN CASE WHEN len(list_distinct(wanted)) = len(list_distinct(hits)) THEN '正确' WHEN len(hits) > 0 AND recall_ok THEN '部分正确' ELSE '错误' END
  WHEN len(hits) > 0 THEN '正确' ELSE '错误' END AS grade FROM h)"""


def _graded(spark: SparkSession, folder: str, *columns) -> DataFrame:
    rows = _wide(spark, folder, "eval_results", "result_id", "question_id", "kind", "answer", "recall_ok", *columns)
    asked = table(spark, folder, "questions").select("question_id", "expect", "expect_all", "expect_reject")
    return evaluate.grade(rows.join(asked, "question_id"))


@query(_GRADED + " SELECT result_id, grade, len(hits)::INT AS n_hits FROM g")
def grade_answers(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder).select("result_id", "grade", F.size("hits").alias("n_hits"))


@query(_GRADED + " SELECT kind, count(*)::BIGINT AS n, count_if(grade = '正确')::BIGINT AS n_right, count_if(grade = '部分正确')::BIGINT AS n_partly, round(count_if(grade = '正确') / count(*), 6) AS accuracy, round(count_if(recall_ok) / count(*), 6) AS recall FROM g GROUP BY ROLLUP (kind)")
def grade_summary_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    rows = _graded(spark, folder)
    right, partly = F.count_if(F.col("grade") == "正确"), F.count_if(F.col("grade") == "部分正确")
    ok = F.count_if(F.coalesce("recall_ok", F.lit(False)))
    return rows.rollup("kind").agg(F.count("*").alias("n"), right.alias("n_right"), partly.alias("n_partly"), F.round(right / F.count("*"), 6).alias("accuracy"), F.round(ok / F.count("*"), 6).alias("recall"))


@query(
    f"WITH r AS (SELECT kind, len(list_distinct(need_companies)) AS need, len(list_intersect(list_distinct(need_companies), coalesce(list_transform(chunks, lambda c: c.company), []))) AS got FROM {_ONE_RESULT}) SELECT kind, count(*)::BIGINT AS n, sum(need)::BIGINT AS needed, sum(got)::BIGINT AS recalled, count_if(need = got)::BIGINT AS n_full FROM r GROUP BY kind"
)
def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array().cast("array<string>")
    need, there = F.array_distinct(F.coalesce("need_companies", none)), F.coalesce(F.transform("chunks", lambda c: c["company"]), none)
    rows = _results(spark, folder, "kind", F.size(need).alias("need"), F.size(F.array_intersect(need, there)).alias("got"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("need").alias("needed"), F.sum("got").alias("recalled"), F.count_if(F.col("need") == F.col("got")).alias("n_full"))


@query(f"SELECT result_id, CASE WHEN len(need_companies) > 8 THEN 'more targets than slots' WHEN len(list_distinct(list_filter(need_companies, lambda x: list_contains(coalesce(list_transform(chunks, lambda c: c.company), []), x)))) < len(list_distinct(need_companies)) THEN 'covered in part' ELSE 'covered' END AS note FROM {_ONE_RESULT} WHERE len(need_companies) > 0")
def slot_sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array().cast("array<string>")
    there = F.coalesce(F.transform("chunks", lambda c: c["company"]), none)
    got, need = F.size(F.array_intersect("need_companies", there)), F.size(F.array_distinct("need_companies"))
    note = F.when(F.size("need_companies") > 8, "more targets than slots").when(got < need, "covered in part").otherwise("covered")
    return _results(spark, folder, F.when(F.size("need_companies") > 0, note).alias("note")).where("note is not null")


_PIPES = "replace(replace({}, '|', '丨'), chr(10), ' ')"


@query(
    _GRADED
    + """, f AS (SELECT kind, result_id, ['**第 ' || no || ' 题 ' || grade || '** ' || substring(question, 1, 36), '检索层 ' || CASE WHEN recall_ok THEN '通过' ELSE '失败' END || '（召回 ' || CASE WHEN len(coalesce(companies_recalled, [])) > 0 THEN array_to_string(companies_recalled, '、') ELSE '无' END || '）'] || list_transform(coalesce(evidence, [])[1:2], lambda e: '- ' || e) AS lines FROM g WHERE grade <> '正确')
SELECT kind, result_id, (i - 1)::INT AS line_no, lines[i] AS line FROM f, range(1, len(lines) + 1) AS r(i)"""
)
def failure_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The failed questions of a one-page conclusion, a few lines each, to be ordered by kind, result and line."""
    rows = _graded(spark, folder, "no", "question", "evidence", "companies_recalled").where("grade <> '正确'")
    none = F.array().cast("array<string>")
    named = F.when(F.size(F.coalesce("companies_recalled", none)) > 0, F.array_join("companies_recalled", "、")).otherwise("无")
    first = F.concat(F.lit("**第 "), "no", F.lit(" 题 "), "grade", F.lit("** "), F.substring("question", 1, 36))
    layer = F.concat(F.lit("检索层 "), F.when(F.coalesce("recall_ok", F.lit(False)), "通过").otherwise("失败"), F.lit("（召回 "), named, F.lit("）"))
    told = F.transform(F.slice(F.coalesce("evidence", none), 1, 2), lambda e: F.concat(F.lit("- "), e))
    return rows.select("kind", "result_id", F.posexplode(F.concat(F.array(first, layer), told)).alias("line_no", "line"))


@query(
    _GRADED
    + f""", f AS (SELECT kind, result_id, grade <> '正确' AS failed, ['### 第 ' || no || ' 题 ' || grade || ' ' || {_PIPES.format("question")}, '> ' || {_PIPES.format("substring(coalesce(answer, ''), 1, 260)")}] || list_transform(coalesce(chunks, [])[1:8], lambda c: '| ' || c.idx || ' | ' || c.company || ' | ' || CASE WHEN coalesce(c.section, '') = '' THEN '—' ELSE c.section END || ' | ' || c.page || ' | ' || CASE WHEN c.kind = 'table' THEN '表' ELSE '文' END || ' | ' || coalesce(c.vector_rank::VARCHAR, '—') || ' | ' || coalesce(c.bm25_rank::VARCHAR, '—') || ' | ' || {_PIPES.format("substring(coalesce(c.snippet, ''), 1, 130)")} || ' |') AS lines FROM g)
SELECT kind, failed, result_id, (i - 1)::INT AS line_no, md5(lines[i]) AS line FROM f, range(1, len(lines) + 1) AS r(i)"""
)
def record_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the record of an evaluation, to be ordered by kind, failures first, result and line: no group is put together in one task."""

    def flat(x):
        return F.replace(F.replace(x, F.lit("|"), F.lit("丨")), F.lit("\n"), F.lit(" "))

    def hit(c):
        dash = [F.coalesce(c[r].cast("string"), F.lit("—")) for r in ("vector_rank", "bm25_rank")]
        section = F.when(F.coalesce(c["section"], F.lit("")) == "", "—").otherwise(c["section"])
        cells = (c["idx"].cast("string"), c["company"], section, c["page"].cast("string"), F.when(c["kind"] == "table", "表").otherwise("文"), *dash, flat(F.substring(F.coalesce(c["snippet"], F.lit("")), 1, 130)))
        return F.concat(F.lit("| "), *[x for cell in cells[:-1] for x in (cell, F.lit(" | "))], cells[-1], F.lit(" |"))

    rows = _graded(spark, folder, "no", "question", F.slice("chunks", 1, 8).alias("chunks"))
    head = F.concat(F.lit("### 第 "), "no", F.lit(" 题 "), "grade", F.lit(" "), flat(F.col("question")))
    said = F.concat(F.lit("> "), flat(F.substring(F.coalesce("answer", F.lit("")), 1, 260)))
    hits = F.coalesce(F.transform("chunks", hit), F.array().cast("array<string>"))
    rows = rows.select("kind", (F.col("grade") != "正确").alias("failed"), "result_id", F.posexplode(F.concat(F.array(head, said), hits)).alias("line_no", "line"))
    return rows.withColumn("line", F.md5("line"))


@query(_GRADED + " SELECT result_id, list_sort(hits) AS hits, list_sort(list_filter(list_distinct(wanted), lambda x: NOT list_contains(hits, x))) AS misses FROM g")
def expected_values(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder).select("result_id", F.array_sort("hits").alias("hits"), F.array_sort("misses").alias("misses"))


@query(_GRADED + " SELECT kind, '| ' || coalesce(kind, '') || ' | ' || count(*) || ' | ' || count_if(grade = '正确') || ' | ' || count_if(grade = '错误') || ' |' AS line FROM g GROUP BY kind")
def conclusion_table(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a table in Markdown, one for each kind of question."""
    rows = _graded(spark, folder).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("grade") == "正确").alias("good"), F.count_if(F.col("grade") == "错误").alias("bad"))
    return rows.select("kind", F.concat(F.lit("| "), F.coalesce("kind", F.lit("")), F.lit(" | "), "n", F.lit(" | "), "good", F.lit(" | "), "bad", F.lit(" |")).alias("line"))


@query(f"SELECT run_id, count(*)::BIGINT AS n, count_if(llm_error IS NOT NULL AND llm_error <> '')::BIGINT AS n_errors, round(sum(elapsed_s), 4) AS seconds, round(max(elapsed_s), 4) AS slowest, count(DISTINCT question_id)::BIGINT AS questions FROM {_ONE_RESULT} GROUP BY run_id")
def run_accounting(spark: SparkSession, folder: str) -> DataFrame:
    rows = _results(spark, folder, "run_id", "llm_error", "elapsed_s", "question_id")
    bad = F.count_if(F.col("llm_error").isNotNull() & (F.col("llm_error") != ""))
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), bad.alias("n_errors"), F.round(F.sum("elapsed_s"), 4).alias("seconds"), F.round(F.max("elapsed_s"), 4).alias("slowest"), F.countDistinct("question_id").alias("questions"))


# --- manifest, reports, lookups ---------------------------------------------------------------------------------------

_LATEST = "(SELECT DISTINCT * FROM manifest QUALIFY row_number() OVER (PARTITION BY code ORDER BY updated_at DESC NULLS LAST, url DESC NULLS LAST, size DESC NULLS LAST, title DESC NULLS LAST) = 1)"


@query(f"SELECT code, status, url, size FROM {_LATEST}")
def manifest_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest")
    return tables.latest(rows, "code", "updated_at", "url", "size", "title").select("code", "status", "url", "size")


@query(
    "WITH m AS (SELECT code, url, report_year, trim(regexp_replace(title, '</?em>', '', 'g')) AS title FROM manifest), p AS (SELECT DISTINCT code, title, url, CASE WHEN (contains(title, report_year || '年年度报告') OR contains(title, report_year || '年度报告')) AND NOT regexp_matches(title, '" + "|".join(tables.BANNED) + "') THEN CASE WHEN ends_with(title, '年年度报告') OR ends_with(title, '年度报告') THEN 0 ELSE 1 END END AS priority FROM m WHERE title IS NOT NULL) SELECT code, title, url FROM p WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY priority, title, url) = 1"
)
def report_title_pick(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest").where("title is not null").withColumn("title", tables.plain_title(F.col("title")))
    rows = rows.withColumn("priority", tables.report_priority(F.col("title"), F.col("report_year"))).where("priority is not null")
    order = Window.partitionBy("code").orderBy("priority", "title", F.col("url").asc_nulls_last())
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("code", "title", "url")


_SECTIONS = f"SELECT code, section, count(*) AS n, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, section) AS place FROM {_ONE_PAGE} GROUP BY code, section QUALIFY place <= 6"


def _top_sections(spark: SparkSession, folder: str) -> DataFrame:
    counts = _pages(spark, folder, "code", "section").groupBy("code", "section").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.col("n").desc(), "section"))
    return counts.withColumn("place", place).where("place <= 6")


@query(f"SELECT code, section, n::BIGINT AS n, place::INT AS place FROM ({_SECTIONS}) WHERE section <> ''")
def source_top_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _top_sections(spark, folder).where("section <> ''").select("code", "section", "n", "place")


@query(
    f"WITH s AS (SELECT code, string_agg(section, '、' ORDER BY place) AS sections FROM ({_SECTIONS}) WHERE section <> '' GROUP BY code), p AS (SELECT code, count(*) AS pages, sum(length(text)) AS chars, sum(coalesce(len(tables), 0)) AS n_tables FROM {_ONE_PAGE} GROUP BY code) SELECT m.code, regexp_extract(m.url, 'finalpage/([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/', 1) AS published, p.pages::BIGINT AS pages, p.chars::BIGINT AS chars, p.n_tables::BIGINT AS n_tables, s.sections FROM {_LATEST} m LEFT JOIN p USING (code) LEFT JOIN s USING (code) WHERE m.status IN ('downloaded', 'skipped')"
)
def provenance(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder, "code", F.length("text").alias("n"), F.coalesce(F.when(F.col("tables").isNotNull(), F.size("tables")), F.lit(0)).alias("t"))
    pages = pages.groupBy("code").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"), F.sum("t").alias("n_tables"))
    sections = _top_sections(spark, folder).where("section <> ''").groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]), "、").alias("sections"))
    latest = tables.latest(table(spark, folder, "manifest"), "code", "updated_at", "url", "size", "title").where("status in ('downloaded', 'skipped')")
    rows = latest.join(pages, "code", "left").join(sections, "code", "left")
    return rows.select("code", F.regexp_extract("url", "finalpage/([0-9]{4}-[0-9]{2}-[0-9]{2})/", 1).alias("published"), "pages", "chars", "n_tables", "sections")


@query("SELECT DISTINCT page_id, code, page, section, md5(text) AS body FROM page_records WHERE code = '700001' AND page = 1")
def page_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return tables.page(table(spark, folder, "page_records"), "700001", 1).select("page_id", "code", "page", "section", F.md5("text").alias("body"))


@query(
    f"WITH s AS (SELECT m.code, m.size, (SELECT count(*) FROM {_ONE_PAGE} p WHERE p.code = m.code) AS pages, (SELECT count(DISTINCT chunk_id) FROM chunks c WHERE c.code = m.code) AS chunks FROM {_LATEST} m WHERE m.status IN ('downloaded', 'skipped')) SELECT count(*)::BIGINT AS companies, sum(pages)::BIGINT AS pages, sum(chunks)::BIGINT AS chunks, sum(size)::BIGINT AS bytes FROM s"
)
def provenance_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Companies, pages, chunks and bytes of all sources that are there."""
    latest = tables.latest(table(spark, folder, "manifest"), "code", "updated_at", "url", "size", "title").where("status in ('downloaded', 'skipped')").select("code", "size")
    pages = _pages(spark, folder, "code").groupBy("code").agg(F.count("*").alias("pages"))
    chunks = _chunks(spark, folder, "code").groupBy("code").agg(F.count("*").alias("chunks"))
    rows = latest.join(pages, "code", "left").join(chunks, "code", "left")
    return rows.agg(F.count("*").alias("companies"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"), F.sum("size").alias("bytes"))


@query(
    f"WITH p AS (SELECT code, page, sha256(string_agg(chunk_id || ':' || sha256(coalesce(embed_text, text)), '|' ORDER BY chunk_id)) AS mark FROM {_ONE_CHUNK} GROUP BY code, page), b AS (SELECT code, page // 256 AS block, count(*) AS n, sha256(string_agg(page || ':' || mark, '|' ORDER BY page)) AS mark FROM p GROUP BY ALL) SELECT code, sum(n)::BIGINT AS pages, substring(sha256(string_agg(block || ':' || mark, '|' ORDER BY block)), 1, 16) AS mark FROM b GROUP BY code"
)
def content_signature(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of ids and contents by page, of pages by blocks of 256, then of blocks by company: no task holds a company's pages."""

    def hashed(rows: DataFrame, by: list[str], place: str) -> DataFrame:
        inner = F.array_sort(F.collect_list(F.struct(place, "mark")))
        joined = F.array_join(F.transform(inner, lambda p: F.concat(p[place].cast("string"), F.lit(":"), p["mark"])), "|")
        return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("mark"))

    rows = _chunks(spark, folder, "code", "page", F.sha2(F.coalesce("embed_text", "text"), 256).alias("mark")).withColumn("n", F.lit(0))
    pages = hashed(rows, ["code", "page"], "chunk_id").withColumn("n", F.lit(1)).withColumn("block", F.floor(F.col("page") / 256))
    whole = hashed(hashed(pages, ["code", "block"], "page"), ["code"], "block")
    return whole.select("code", F.col("n").alias("pages"), F.substring("mark", 1, 16).alias("mark"))


@query("SELECT sha256(coalesce(embed_text, '')) AS content, CASE WHEN min(ingested_at) < TIMESTAMP '2026-03-05' THEN 1 ELSE 2 END::INT AS run, max(length(embed_text))::INT AS chars FROM chunks GROUP BY coalesce(embed_text, '')")
def incremental_index(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of a stream over landed files on one folder: the second brings only contents that the first hasn't brought."""
    place = shared_folder(spark, "stream")
    rows = table(spark, folder, "chunks").select("chunk_id", "code", "embed_text", "ingested_at")
    late = ~F.coalesce(F.col("ingested_at") < F.lit("2026-03-05").cast("timestamp"), F.lit(False))
    last = -1
    for part in (~late, late):
        rows.where(part).write.mode("append").parquet(f"{place}/landed")
        index = incremental.run(spark, f"{place}/landed", "*.parquet", rows.schema, f"{place}/taken")
        if last < 0:
            last = index.agg(F.max("epoch")).first()[0]
    return index.select("content", F.when(F.col("epoch") <= last, 1).otherwise(2).alias("run"), "chars")
