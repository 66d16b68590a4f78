import json

from loamgrid import session
from loamgrid.operators import nested

TABLES = "page_id bigint, tables array<struct<title:string,rows:array<array<string>>,degraded:boolean>>"
CHUNKS = "result_id bigint, chunks array<struct<idx:int,chunk_id:string>>"


def leaves(spark, pages=(), results=(), raw=()):
    nodes = nested.all_nodes(spark.createDataFrame(list(pages), TABLES), spark.createDataFrame(list(results), CHUNKS), spark.createDataFrame(list(raw), "raw_id bigint, payload string"))
    folder = session.shared_folder(spark, "nested")
    nested.write_tables(nodes, folder)
    return sorted(tuple(r) for r in nested.found_leaves(spark, folder).collect())


def test_cells_keep_their_place(spark):
    page = (1, [("t", [["a", None], None, []], None), None, ("u", None, False), ("v", [["", "b"]], True)])
    assert leaves(spark, [page, page, (2, None), (3, [])]) == [
        ("page_records.tables", "1", "0/0/0", "a"), ("page_records.tables", "1", "3/0/0", ""), ("page_records.tables", "1", "3/0/1", "b"),
    ]


def test_uneven_payloads(spark):
    one = {"result": {"no": "7", "chunks": {"1": {"meta": {"chunk_id": "x"}}, "2": {"chunk_id": "y"}}, "per_company_coverage": {"coverage": [{"company": "A"}, {"company": None}]}}}
    many = {"results": [{"no": 1, "chunks": {"idx": 3, "meta": {"chunk_id": "z"}}}, {"no": 2, "chunks": None}, {"no": 3, "chunks": [{"idx": 1, "chunk_id": "w"}, None]}]}
    raw = [(1, json.dumps(one)), (1, json.dumps(one)), (2, json.dumps(many)), (3, None), (4, ""), (5, "[1]"), (6, '{"results": [{"no": 1,'), (7, '"text"'), (8, "{}")]
    assert leaves(spark, raw=raw) == [
        ("raw_results.chunks", "1", "7/1", "x"), ("raw_results.chunks", "1", "7/2", "y"), ("raw_results.chunks", "2", "1/3", "z"),
        ("raw_results.chunks", "2", "3/1", "w"), ("raw_results.coverage", "1", "7/0", "A"),
    ]


def test_structs_and_empty_tables(spark):
    assert leaves(spark, results=[(1, [(1, "a"), None, (2, None)]), (2, None), (1, [(1, "a"), None, (2, None)])]) == [("eval_results.chunks", "1", "0", "a")]
    assert leaves(spark) == []


def test_tables_are_written_by_tag_and_read_with_their_schema(spark, tmp_path):
    chunk = {"idx": 1, "chunk_id": "c", "page": "9", "retrieval": {"vector_rank": 2, "rrf_score": 0.5}, "meta": {"section": "s", "kind": "text"}, "more": [1]}
    cover = {"targets": ["A", "B"], "covered": 1, "missing": ["B"], "coverage": [{"company": "A", "covered": True, "chunk_idxs": [1]}, {"company": "B"}]}
    run = {"run": {"id": "r", "config": {"topk": 8}}, "results": [{"no": 2, "question": "q", "recall": {"n_vector": 4}, "chunks": [chunk], "per_company_coverage": cover}, {"chunks": {"chunk_id": "d"}}]}
    rows = spark.createDataFrame([(5, json.dumps(run), "x")], "raw_id bigint, payload string, tag string")
    nodes = nested.all_nodes(spark.createDataFrame([(1, [("t", [["a"]], True)])], TABLES), spark.createDataFrame([(1, [(1, "a")])], CHUNKS), rows)
    nested.write_tables(nodes, str(tmp_path / "t"))

    def read(tag, src="raw_results"):
        return nested.read_table(spark, str(tmp_path / "t"), src, tag).orderBy("pk").collect()

    first, second = read("chunk")
    assert (first.pk, first.parent, first.path, first.chunk_id, first.page, first.vector_rank, first.bm25_rank) == ("5/0/c0", "5/0", "2/1", "c", "9", 2, None)
    # No field is lost, and a number by place that another result bears itself leaves the keys apart.
    assert (first.section, first.kind, first.rrf_score) == ("s", "text", 0.5) and (second.pk, second.path) == ("5/1/c0", "2/1")
    assert json.loads(nodes.where("pk = '5/0/c0'").first().payload)["more"] == [1]
    assert read("result")[0].recall.n_vector == 4 and read("run")[0].parent == "" and read("run")[0].run.config.topk == 8
    assert (read("cover")[0].targets, read("cover")[0].covered, read("cover")[0].missing) == (["A", "B"], 1, ["B"])
    assert [(r.company, r.parent, r.path, r.chunk_idxs) for r in read("coverage")] == [("A", "5/0/p", "2/0", [1]), ("B", "5/0/p", "2/1", None)]
    assert [(r.pk, r.leaf) for r in read("cell", "page_records")] == [("1/0/0/0", "a")] and read("table", "page_records")[0].degraded
    keys = [(r.src, r.pk) for r in nodes.collect()]
    assert len(keys) == len(set(keys)) and {(r.src, r.parent) for r in nodes.collect() if r.parent not in ("", r.key)} <= set(keys)
