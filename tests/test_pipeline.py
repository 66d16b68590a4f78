import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from loamgrid.functions.text import citations, sentences, words
from loamgrid.operators import evaluate, layout, retrieve, segment
from loamgrid.params import Params
from loamgrid.sources import tables


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_sentences_and_words(spark):
    assert one(spark, "a。 b！c", sentences) == ["a。", "b！", "c"]
    assert one(spark, "", sentences) == []
    assert one(spark, "公司 营收 up5 A 7。", words) == ["营收", "up5", "7"]
    assert one(spark, "一二三", words) == ["一二", "二三"]
    assert one(spark, "the sum of 3", lambda c: words(c, ("the", "of"))) == ["sum", "3"]
    assert one(spark, "a[1] b[9] c[1][2]", citations) == [1, 2, 9]


def plain_chunks(parts, p):
    """The definition, sentence by sentence."""
    out, cur = [], []
    for s in parts:
        cur.append(s)
        if sum(map(len, cur)) >= p.chunk_size:
            out.append("".join(cur))
            keep = []
            for x in reversed(cur):
                if sum(map(len, keep)) >= p.chunk_overlap:
                    break
                keep.insert(0, x)
            cur = keep
    rest = "".join(cur)
    return [*out, rest] if len(rest) > p.tail_over else out


def pieces(spark, text, p, copies=True):
    rows = segment.chunk_text(spark.createDataFrame([(1, text)], "id int, text string"), "text", copies, p)
    return [r.piece for r in rows.orderBy("piece_no").collect()]


def test_pieces(spark):
    small = Params(chunk_size=10, chunk_overlap=4)
    assert pieces(spark, "aaaa。bbbb。cccc。dd。", small) == ["aaaa。bbbb。", "bbbb。cccc。"]
    assert pieces(spark, "x" * 900, Params()) == ["x" * 900] * 2
    assert pieces(spark, "x" * 900, Params(), copies=False) == ["x" * 900]
    assert pieces(spark, None, small) == [] and pieces(spark, "", small) == []
    rng = random.Random(5)
    for _ in range(5):
        parts = ["字" * rng.randint(1, 30) + "。" for _ in range(rng.randint(1, 40))]
        p = Params(chunk_size=60, chunk_overlap=15, tail_over=8)
        assert pieces(spark, "".join(parts), p) == plain_chunks(parts, p)


def test_table_pieces_and_catalogue(spark):
    rows = [["行", str(k)] for k in range(15)]
    kind = "code string, name string, section string, page int, text string, tables array<struct<title:string,rows:array<array<string>>,degraded:boolean>>"
    pages = [("c", "n", "s", 2, "句" * 60 + "。", [("题", rows, None)]), ("c", "n", None, 1, "短。", None), ("d", None, "", 1, None, [])]
    got = segment.chunk_catalog(spark.createDataFrame(pages, kind)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.kind, r.page) for r in got] == [("c-T00001", "text", 2), ("c-T00002", "table", 2)]
    assert got[1].text.split("\n")[0] == "【表】题" and len(got[1].text.split("\n")) == 14
    assert got[0].embed_text.startswith("n（c） s\n")


def test_running_number_matches_a_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(1, 5), k) for k in range(60)]
    got = segment.running_number(spark.createDataFrame(rows, "g string, b int, k int"), "g", "b", ["k"], "n").collect()
    want = {(g, b, k): i for grp in "ab" for i, (g, b, k) in enumerate(sorted(r for r in rows if r[0] == grp), 1)}
    assert {(r.g, r.b, r.k): r.n for r in got} == want


def test_bm25_by_hand(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa aa cc"), (3, "")], "id int, text string")
    asked = spark.createDataFrame([(9, "aa aa"), (8, "zz")], "qid bigint, q string")
    index = retrieve.write_index(docs, "id", "text", str(tmp_path / "i"))
    got = {r.id: r.score for r in retrieve.bm25_topk(asked, index).collect()}
    assert got.keys() == {1, 2} and math.isclose(got[1], 0.431196, abs_tol=1e-6) and math.isclose(got[2], 0.534095, abs_tol=1e-6)
    assert math.isclose(index.vocabulary.where("term = 'aa'").first().idf, math.log(1.6)) and index.stats.first().n == 3
    empty = retrieve.write_index(docs.limit(0), "id", "text", str(tmp_path / "e"))
    assert retrieve.bm25_topk(asked, empty).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_vectors_in_blocks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieve, "BLOCK", block)
    rng = random.Random(block)
    data = [(k, [float(rng.randint(-2, 2)) for _ in range(3)]) for k in range(40)] + [(90, None)]
    v = spark.createDataFrame(data, "id bigint, v array<float>")
    got = retrieve.vector_topk(v.where("id % 3 = 0").select(F.col("id").alias("qid"), "v"), v, "id", "v", 5).collect()

    def form(x):
        n = math.sqrt(sum(a * a for a in x)) or 1.0
        return [a / n for a in x]

    forms = {k: form(x) for k, x in data if x}
    for q in (k for k in forms if k % 3 == 0):
        want = sorted((-round(sum(a * b for a, b in zip(forms[q], forms[k], strict=True)), 9), k) for k in forms)[:5]
        assert [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == [k for _, k in want]


def test_vectors_and_fusion(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [4.0, 3.0]), (4, [3.0, 4.0]), (5, None)], "id bigint, v array<float>")
    assert [r.u for r in v.where("id < 3").select(retrieve.unit(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    found = retrieve.vector_topk(v.where("id = 2").select(F.col("id").alias("qid"), "v"), v, "id", "v", 2).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in found] == [(2, 1.0), (4, 1.0)]
    stored = retrieve.write_vectors(v, "id", "v", str(tmp_path / "v"))
    again = retrieve.vector_topk(v.where("id = 2").select(F.col("id").alias("qid"), "v"), stored, "id", "v", 2).orderBy("rank").collect()
    assert stored.count() == 4 and [(r.id, r["rank"]) for r in again] == [(r.id, r["rank"]) for r in found]
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid int, id string, rank int")
    b = spark.createDataFrame([(1, "c", 1), (1, "d", 2)], "qid int, id string, rank int")
    fused = retrieve.fuse(a, b).orderBy("rank").collect()
    assert [(r.id, round(r.rrf, 6)) for r in fused] == [("c", 0.032266), ("a", 0.016393), ("b", 0.016129), ("d", 0.016129)]


def test_grades(spark):
    kind = "answer string, expect array<string>, expect_all array<string>, expect_reject boolean, recall_ok boolean"
    rows = [
        ("营收1,958.71亿元", None, ["1958.71", "99"], False, True), ("营收1,958.71亿元", None, ["1958.71", "99"], False, False),
        ("未提及", None, None, True, None), ("未提及，约 3 亿", None, None, True, None), (" ", ["x"], None, None, None), ("Abc", ["b"], [], None, None), (None, None, None, None, None),
    ]
    got = evaluate.grade(spark.createDataFrame(rows, kind))
    assert [r.grade for r in got.collect()] == ["部分正确", "错误", "正确", "错误", "错误", "正确", "错误"]


def test_citations_and_names(spark):
    rows = spark.createDataFrame([("a[1] b[9] c[1][2]", [(1,), (2,)]), (None, None)], "answer string, chunks array<struct<idx:int>>")
    used, missing = evaluate.checked_citations(F.col("answer"), F.col("chunks"))
    assert [tuple(r) for r in rows.select(used.alias("u"), missing.alias("m")).collect()] == [([1, 2], [9]), ([], [])]
    names = spark.createDataFrame([("甲公司",), ("乙",), ("甲公司",)], "name string")
    texts = spark.createDataFrame([(1, "问甲公司和乙"), (2, "无"), (3, None)], "id int, q string")
    assert sorted(tuple(r) for r in evaluate.spotted(texts, "id", "q", names).collect()) == [(1, "乙"), (1, "甲公司")]


def test_sections_as_of_a_page(spark):
    marks = spark.createDataFrame([("d", 3, "A"), ("d", 7, "B"), ("d", 7, "C")], "doc string, page int, section string")
    rows = spark.createDataFrame([("d", p) for p in (2, 3, 6, 7)] + [("e", 1)], "doc string, page int")
    got = layout.as_of(rows, marks, "doc", "page", "section").orderBy("doc", "page").collect()
    assert [r.section for r in got] == ["", "A", "A", "C", ""]


def test_layout_of_words(spark):
    kind = "doc string, page int, x0 double, y0 double, x1 double, word string"
    placed = [("d", 1, x, 10.0 + k, x + 3, f"w{k}") for k, x in enumerate((0.0, 5.0, 100.0, 200.0))]
    rows = layout.row_clusters(spark.createDataFrame(placed, kind))
    assert {r.row_no for r in rows.collect()} == {0}
    assert layout.cells(rows).first().cells == ["w0 w1", "w2", "w3"]
    far = [("d", 1, 0.0, 10.0, 3.0, "a"), ("d", 1, 0.0, 12.9, 3.0, "b"), ("d", 1, 0.0, 15.0, 3.0, "c")]
    assert [(r.row_no, r.word) for r in layout.row_clusters(spark.createDataFrame(far, kind)).orderBy("row_no", "in_row").collect()] == [(0, "a"), (0, "b"), (1, "c")]


def test_islands(spark):
    rows = spark.createDataFrame([(1, k, f) for k, f in enumerate((True, True, False, True, True, True))], "g int, k int, ok boolean")
    assert [tuple(r) for r in layout.islands(rows, ["g"], ["k"], "ok", 3).select("first", "last", "n").collect()] == [(3, 5, 3)]


def test_sources(spark, tmp_path):
    assert tables.read_jsonl(spark, str(tmp_path / "none"), tables.PAGE).count() == 0
    page = spark.createDataFrame([("c", "n", 1, "", "t", [])], tables.PAGE)
    tables.write_jsonl(page, str(tmp_path / "j"))
    assert tables.read_jsonl(spark, str(tmp_path / "j"), tables.PAGE).first().text == "t"
    tables.write_by_company(page, str(tmp_path / "p"))
    assert tables.page(spark.read.parquet(str(tmp_path / "p")), "c", 1).count() == 1
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "code string, at int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 4, "w"), ("c", None, "n")], "code string, at int, v string")
    assert sorted((r.code, r.v) for r in tables.upsert(old, new, "code", "at", "v").collect()) == [("a", "z"), ("b", "y"), ("c", "n")]
    files = spark.createDataFrame([(bytearray(b"%PDF" + b"0" * 20_000 + b"%%EOF"),), (bytearray(b"%PDF" + b"0" * 20_000),)], "content binary")
    assert [r.ok for r in files.select(tables.whole_pdf(F.col("content"), F.length("content")).alias("ok")).collect()] == [True, False]


def test_titles(spark):
    rows = spark.createDataFrame([("2025年年度报告摘要", 2025), ("2025年年度报告", 2025), ("2025年度报告全文", 2025), ("季报", 2025), ("关于2025年年度报告", 2025), ("2024年年度报告", 2025)], "t string, y int")
    assert [r.p for r in rows.select(tables.report_priority(F.col("t"), F.col("y")).alias("p")).collect()] == [None, 0, 1, None, None, None]


def test_sections_of_pages(spark):
    pages = [("c", 1, "第一节\n公司简介\n正文"), ("c", 2, "页眉\n第二节 管理层讨论与分析\n第三节 公司治理"), ("c", 5, "第二节 管理层讨论与分析（续）"), ("c", 9, "第四节\n1，2\n"), ("c", 10, None), ("d", 3, "\n" * 3 + "一\n" * 8 + "第五节 重要事项")]
    got = layout.body_headings(spark.createDataFrame(pages, "code string, page int, text string"))
    assert {(r.code, r.section, r.page) for r in got.collect()} == {("c", "公司简介", 1), ("c", "管理层讨论与分析", 2)}
    spans = [("c", n, k, span) for k, (n, span) in enumerate((("释义", 1), ("业务回顾总览", 5), ("业务回顾", 4), ("2025年回顾", 9), ("中国证监会公告", 9), ("经营业绩", 9), ("们", 9), ("Board回顾", 9), ("第三节 公司治理", 1)))]
    spans += [("m", "甲乙" + chr(0x4E00 + k), k, 5 + k) for k in range(31)] + [("n", "甲乙" + chr(0x4E00 + k), k, 5 + k) for k in range(30)]
    kept = layout.trusted(spark.createDataFrame(spans, "code string, section string, page int, span int")).collect()
    assert {r.section for r in kept if r.code == "c"} == {"释义", "业务回顾总览", "第三节 公司治理"}
    assert sorted(r.span for r in kept if r.code == "m") == list(range(21, 36)) and sum(r.code == "n" for r in kept) == 30


def test_offsets_and_merged_sections(spark):
    kind = "code string, section string, page int"
    body = spark.createDataFrame([("c", "释义", 7), ("c", "公司治理", 25), ("c", "风险", 33), ("d", "释义", 9)], kind)
    contents = spark.createDataFrame([("c", "释义", 2), ("c", "公司治理与社会", 20), ("c", "风险管理", 30), ("c", "附录", 98), ("d", "释义", 5)], kind)
    offsets = layout.page_offset(body, contents)
    assert {r.code: r.page_offset for r in offsets.collect()} == {"c": 5, "d": 0}
    pages = spark.createDataFrame([("c", 100), ("d", 50)], "code string, pages int")
    got = {(r.code, r.section): r.page for r in layout.merged_sections(body, contents, offsets, pages).collect()}
    assert got == {("c", "释义"): 7, ("c", "公司治理"): 25, ("c", "风险"): 33, ("c", "公司治理与社会"): 25, ("c", "风险管理"): 35, ("c", "附录"): 100, ("d", "释义"): 9}


def test_tables_that_fit(spark):
    kind = "t struct<rows: array<array<string>>>"
    cases = [([["a", "b"]] * 3,), ([["a", "b"], [" ", ""], ["a", "b"]],), ([["a", " "]] * 3,), ([["a"] * 13] * 3,), ([["长" * 25, "长" * 24]] * 3,), (None,), ([["a", "b"], None, ["c"], ["d"]],)]
    rows = spark.createDataFrame([(c,) for c in cases], kind)
    assert [bool(r.x) for r in rows.select(layout.fit_table(F.col("t")).alias("x")).collect()] == [True, False, False, False, False, False, True]


def test_predicates_and_names_of_sections(spark):
    lines = ["第一节", "第一节 释义、目录", "公司治理", "a" * 5, "治", "公司，治理", "第3页", "目录", "报告期内", "公司" * 16, "结束。", ""]
    rows = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [x for x in lines if x and one(spark, x, layout.section_word)] == ["第一节 释义、目录", "公司治理", "目录", "报告期内"]
    assert [r.t for r in rows.where(layout.contents_name(F.col("t"))).collect()] == ["第一节 释义、目录", "公司治理", "aaaaa", "治"]
    assert [r.t for r in rows.where(layout.contents_name(F.col("t"), loose=True)).collect()][-1] == "公司" * 16
    names = {"总裁致辞公司治理与债券相关情况": "总裁致辞", "公司简介和主要财务指标": "公司简介和主要财务指标", "第三节 公司治理/12": "公司治理", "03 释义": "释义", "风险管理": "风险管理", "公司治理情况": "公司治理情况"}
    assert {n: one(spark, n, layout.section_name) for n in names} == names


def test_tables_from_items(spark):
    text = "合并资产负债表\n货币资金：\n存货\n存货\n商誉\n股本\n净利润 12\n其他"
    kind = "code string, page int, text string, tables array<struct<title:string>>"
    pages = [("a", 1, text, None), ("a", 2, text.replace("合并资产负债表", "附表"), []), ("a", 3, text, [("t",)]), ("b", 1, text, []), ("b", 2, "", [("t",)] * 21)]
    got = layout.item_tables(spark.createDataFrame(pages, kind)).collect()
    assert [(r.code, r.page, r.title, r.rows) for r in got] == [("a", 1, "合并资产负债表", [["货币资金"], ["存货"], ["商誉"], ["股本"], ["净利润 12"]])]


def test_reports_and_files(spark, tmp_path):
    lines = spark.createDataFrame([("b", 1, "三"), ("a", 2, "二"), ("a", 1, "一")], "k string, n int, line string")
    tables.write_report(lines, str(tmp_path / "r"), ["k", "n"])
    assert "".join(x.read_text() for x in sorted((tmp_path / "r").glob("part-*"))) == "一\n二\n三\n"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"a" * (1 << 20) + b"tail")
    mark = spark.read.format("binaryFile").load(str(tmp_path / "f")).select(tables.file_mark(F.col("content")).alias("m")).first().m
    assert mark == hashlib.sha256(b"a" * (1 << 20)).hexdigest()[:16]
    pages = spark.createDataFrame([(c, "n", p, "", "t", []) for c in "ba" for p in (2, 1)], tables.PAGE)
    tables.write_by_company(pages, str(tmp_path / "p"))
    assert [(r.code, r.page) for r in tables.read_by_company(spark, str(tmp_path / "p")).collect()] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert one(spark, " <em>2025</em>年度报告 ", tables.plain_title) == "2025年度报告"


@pytest.mark.parametrize("seed", [1, 2])
def test_fusion_depends_on_ranks_only(spark, seed):
    rng = random.Random(seed)
    lists = [[(1, k, r) for r, k in enumerate(rng.sample(range(12), 6), 1)] for _ in range(2)]
    a, b = (spark.createDataFrame(x, "qid int, id int, rank int") for x in lists)
    score = {k: sum(1 / (60 + r) for x in lists for _, i, r in x if i == k) for k in range(12)}
    for r in retrieve.fuse(a, b, k=20).collect():
        assert math.isclose(r.rrf, score[r.id])
