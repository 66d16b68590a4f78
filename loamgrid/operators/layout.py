"""Structure of pages: tabular rows and their islands, sections as of a page, row clusters and cells of placed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.text import NOISE, stripped
from loamgrid.session import durable, fitting

NUMERIC = r"^[0-9,.()\-—/%．，（） ]+$"


def numeric_cell(cell: Column) -> Column:
    return cell.rlike(NUMERIC)


def tabular_row(cells: Column) -> Column:
    """At least two filled cells, half of them numbers and one at least."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    numbers = F.size(F.filter(filled, numeric_cell))
    return (F.size(filled) >= 2) & (numbers >= F.greatest(F.lit(1), F.floor(F.size(filled) / 2)))


def fit_table(table: Column) -> Column:
    """Without blank cells and rows: at least three rows, 2 to 12 columns and cells of 24 characters at the mean."""
    none = F.array().cast("array<array<string>>")
    filled = F.transform(F.coalesce(table["rows"], none), lambda r: F.filter(r, lambda c: F.trim(c) != ""))
    rows = F.filter(filled, lambda r: F.size(r) > 0)
    total = F.aggregate(F.flatten(rows), F.lit(0), lambda s, c: s + F.length(c))
    return (F.size(rows) >= 3) & F.array_max(F.transform(rows, F.size)).between(2, 12) & (total <= 24 * F.size(F.flatten(rows)))


def islands(df: DataFrame, group: list[str], order: list[str], flag: str, least: int) -> DataFrame:
    """Runs of at least `least` flagged rows: group, first and last position of the order, and length. Positions are order[-1]."""
    by = Window.partitionBy(*group).orderBy(*order)
    df = df.withColumn("_rn", F.row_number().over(by)).where(F.col(flag))
    df = df.withColumn("_island", F.col("_rn") - F.row_number().over(by))
    runs = df.groupBy(*group, "_island").agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("_island")


def as_of(rows: DataFrame, marks: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """Each row with the value of the last mark at or before it; "" before the first.

    Marks are few per group: they are laid out as one sorted array per group. Lists of few groups are broadcast, so that rows, of
    which one group may have most, are neither sorted nor moved.
    """
    lists = durable(marks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("_marks")))
    met = rows.join(fitting(lists, 20_000), group, "left")
    last = F.element_at(F.filter("_marks", lambda m: m[at] <= F.col(at)), -1)
    found = F.when(F.exists(F.col("_marks"), lambda m: m[at] <= F.col(at)), last[value])
    return met.withColumn(value, F.coalesce(found, F.lit(""))).drop("_marks")


def spans(marks: DataFrame, group: str, at: str, total: DataFrame, whole: str) -> DataFrame:
    """Adds span: from each mark to the next one, or to the end of the group."""
    nxt = F.lead(at).over(Window.partitionBy(group).orderBy(at))
    return marks.join(total, group).withColumn("span", F.coalesce(nxt, F.col(whole) + 1) - F.col(at)).drop(whole)


def row_clusters(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Adds row_no and in_row to placed words (doc, page, x0, y0, x1, word).

    Words in the order of (y0 to a tenth, x0) join the first row whose first word lies within the tolerance; rows are ordered by
    that first word. A fold over each page's words; a page's words fit one task.
    """
    page = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("k"), "x0", "y0", "x1", "word"))).alias("w"))
    kind = "array<struct<anchor:double,words:array<struct<k:double,x0:double,y0:double,x1:double,word:string>>>>"

    def step(rows: Column, w: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), lambda i: F.coalesce(F.abs(F.try_element_at(rows, i)["anchor"] - w["y0"]) <= tolerance, F.lit(False)))
        new = F.array(F.named_struct(F.lit("anchor"), w["y0"], F.lit("words"), F.array(w)))
        put = F.transform(rows, lambda r, i: F.when(i + 1 == F.get(fits, F.lit(0)), F.named_struct(F.lit("anchor"), r["anchor"], F.lit("words"), F.concat(r["words"], F.array(w)))).otherwise(r))
        return F.when(F.size(fits) > 0, put).otherwise(F.concat(rows, new))

    rows = F.array_sort(F.aggregate("w", F.array().cast(kind), step))
    out = page.select("doc", "page", F.posexplode(rows).alias("row_no", "r"))
    return out.select("doc", "page", "row_no", F.posexplode("r.words").alias("in_row", "w")).select("doc", "page", "row_no", "in_row", "w.x0", "w.x1", "w.y0", "w.word")


def cells(words: DataFrame, least: float = 18.0) -> DataFrame:
    """doc, page, row_no, cells: words of a row joined where the gap is small.

    The mean of the gaps above 20 tells what a wide gap is; without any, every word is a cell.
    """
    row = words.groupBy("doc", "page", "row_no").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "word"))).alias("w"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.get("w", i)["x0"] - F.get("w", i - 1)["x0"])
    row = row.withColumn("g", F.when(F.size("w") > 1, F.filter(gaps, lambda g: g > 20)).otherwise(F.array().cast("array<double>")))
    mean = F.aggregate("g", F.lit(0.0), lambda s, g: s + g) / F.size("g")
    row = row.withColumn("cut", F.when(F.size("g") > 0, F.greatest(F.lit(least), 0.6 * mean)).otherwise(F.lit(-1.0)))

    def step(s: Column, w: Column) -> Column:
        wide = F.when(F.size(s["out"]) == 0, F.lit(True)).otherwise(w["x0"] - s["x"] > F.col("cut"))
        last = F.concat(F.element_at(s["out"], -1), F.lit(" "), w["word"])
        joined = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(last))
        out = F.when(wide, F.concat(s["out"], F.array(w["word"]))).otherwise(joined)
        return F.named_struct(F.lit("x"), w["x0"], F.lit("out"), out)

    start = F.named_struct(F.lit("x"), F.lit(0.0), F.lit("out"), F.array().cast("array<string>"))
    return row.select("doc", "page", "row_no", F.aggregate("w", start, step, lambda s: s["out"]).alias("cells"))


# --- sections ---------------------------------------------------------------------------------------------------------

#: Names of sections that are known, of groups of sections, and of bodies that are no section.
KNOWN_SECTIONS = (
    *("释义", "公司简介", "公司信息", "公司概况", "公司基本信息", "公司业务概要", "核心竞争力分析", "经营情况讨论与分析", "管理层讨论与分析", "经营分析与战略"),
    *("重要事项", "股份变动及股东情况", "普通股股份变动及股东情况", "债券相关情况", "财务报告", "财务报告及备查文件", "公司治理", "环境与社会责任", "环境和社会"),
    *("审计报告", "年度财务报告", "补充资料", "备查文件目录", "信息披露索引", "董事长致辞", "总裁致辞", "首席执行官致辞", "经营亮点", "财务摘要", "风险因素"),
    *("业务概要", "业务综述", "经营概览", "经营业绩", "利润表", "资产负债表", "现金流量表", "财务报表", "股东情况", "关联交易", "募集资金", "重大关联交易"),
    *("董事、高级管理人员和员工情况", "企业管治报告", "董事会报告", "合并财务报表", "综合金融", "医疗养老", "业绩综述", "内含价值", "内含价值分析", "利源分析"),
    *("风险管理", "流动性及资本资源", "主要财务指标", "致股东函", "致股东报告", "备查文件目录及信息披露索引", "其他信息", "关于公司", "经营情况"),
)
GROUP_TITLES = ("公司治理与债券相关情况", "财务报告及备查文件", "经营业绩", "其他信息", "关于公司", "经营情况", "释义项", "释义内容", "关于我们", "经营分析", "财务报告及其他", "战略与经营分析")
ORG_NAMES = ("中国证监会", "上交所", "深交所", "中证协", "证券时报", "上海证券报", "公司登记机关", "会计师事务所", "律师事务所", "保荐机构", "国家外汇管理局", "深圳证监局", "海南证监局", "北京证监局")
#: A heading with its name on the line, one without, and what a continued page adds.
HEADING, BARE_HEADING, CONTINUED = r"^第[一二三四五六七八九十]+\s*节\s*(\S.*)$", r"^第[一二三四五六七八九十]+\s*节$", r"[（(]续[）)]\s*$"


#: Lines on pages of contents that are no section; names of statements; names of accounts that begin a line of a statement.
NO_SECTION = (
    *("目录", "备查文件目录", "释义$", "contents", "CONTENTS", "前导信息", "载有", "在公司", "报告期", "年度报告摘要", "图片索引"),
    *(r"[0-9]{4}\s*年年度报告$", "年年度报告$", r"第\s*[0-9]+\s*页", "第[一二三四五六七八九十]+节$"),
)
STATEMENTS = (
    *("合并资产负债表", "合并利润表", "合并现金流量表", "母公司资产负债表", "母公司利润表", "母公司现金流量表", "合并所有者权益变动表"),
    *("利润表", "资产负债表", "现金流量表", "财务报表", "主要会计数据"),
)
ACCOUNTS = (
    *("货币资金", "结算备付金", "拆出资金", "交易性金融资产", "衍生金融资产", "买入返售金融资产", "应收账款", "应收款项", "预付款项", "其他应收款", "存货"),
    *("发放贷款和垫款", "债权投资", "其他债权投资", "长期股权投资", "投资性房地产", "固定资产", "在建工程", "无形资产", "商誉", "递延所得税资产", "其他资产"),
    *("资产总计", "负债合计", "所有者权益", "股本", "资本公积", "未分配利润", "营业收入", "营业成本", "营业支出", "营业总成本", "利息收入", "手续费及佣金收入"),
    *("投资收益", "公允价值变动收益", "业务及管理费", "营业利润", "利润总额", "所得税费用", "净利润", "归属于母公司", "基本每股收益", "稀释每股收益"),
    *("经营活动产生的现金流量净额", "投资活动产生的现金流量净额", "筹资活动产生的现金流量净额", "现金及现金等价物净增加额", "期末现金余额"),
)


def section_word(line: Column) -> Column:
    """A line that may be the name of a section: a heading with its name, or 2 to 24 characters with a Chinese one and without digits and signs."""
    free = ~line.rlike(r"[0-9，,。、；;：:（）()【】\[\]｜|/\\%#@]") & line.rlike("[一-鿿]")
    return F.length(line).between(2, 24) & ~line.rlike(BARE_HEADING) & (line.rlike(HEADING) | free)


def contents_name(line: Column, loose: bool = False) -> Column:
    """A line that may be a name in a list of contents: no noise, short, no end of a sentence, and without signs unless it is a heading."""
    noise = line.rlike("^(" + "|".join(NO_SECTION) + ")") | line.rlike("^(" + "|".join(NOISE) + ")")
    fine = (line != "") & ~noise & (F.length(line) <= (40 if loose else 30)) & ~line.rlike("[。；]$")
    return fine & (line.rlike(HEADING) | ~line.rlike("[，,、；;：:（）()【】]"))


def section_name(name: Column) -> Column:
    """A section's name without its number and a page stuck to it; of two whole names run into one the first."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"^[0-9]{1,2}\s+", ""), r"^第[一二三四五六七八九十]+\s*节\s*", "")
    bare = F.trim(F.regexp_replace(bare, r"[/／]\s*[0-9]{1,4}\s*$", ""))
    known = sorted({*KNOWN_SECTIONS, *GROUP_TITLES}, key=lambda k: (-len(k), k))
    # The first known name, the longest at its place, is taken as it is (an atomic group); a whole name must follow.
    return F.regexp_replace(bare, f"^((?>.*?(?:{'|'.join(known)})))(?:{'|'.join(k for k in known if len(k) >= 3)}).*$", "$1")


def statement_title(text: Column) -> Column:
    """The first of a page's eight head lines that names a statement in at most 30 characters; null for none."""
    return F.get(F.filter(head_lines(text), lambda x: x.rlike("|".join(STATEMENTS)) & (F.length(x) <= 30)), F.lit(0))


def item_tables(pages: DataFrame, group: str = "code", few: int = 20, least: int = 5) -> DataFrame:
    """Pages with a table put together from lines that begin with an account, where figures couldn't be read: group, page, title and rows.

    Only in documents with at most `few` tables, on pages without one that are headed by a statement and have at least `least` such lines. pages has
    group, page, text and tables.
    """
    total = pages.groupBy(group).agg(F.sum(F.when(F.col("tables").isNull(), 0).otherwise(F.size("tables"))).alias("_total")).where(F.col("_total") <= few)
    lines = F.transform(F.split("text", "\n"), lambda x: stripped(F.regexp_replace(stripped(x), "[：:]+$", "")))
    items = F.array_distinct(F.filter(lines, lambda x: x.rlike("^(" + "|".join(ACCOUNTS) + ")") & F.length(x).between(2, 20)))
    rows = pages.where(F.col("tables").isNull() | (F.size("tables") == 0)).select(group, "page", statement_title(F.col("text")).alias("title"), items.alias("_items"))
    rows = rows.where(F.col("title").isNotNull() & (F.size("_items") >= least)).join(total, group, "left_semi")
    return rows.select(group, "page", "title", F.transform("_items", lambda x: F.array(x)).alias("rows"))


def head_lines(text: Column, n: int | None = 8) -> Column:
    """The first filled lines of a page, stripped."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
    return F.slice(lines, 1, n) if n else lines


def body_headings(pages: DataFrame, group: str = "code", page: str = "page", text: str = "text") -> DataFrame:
    """group, section and page: names of sections in headings, at the first page of each.

    Of the first eight lines of a page the first heading with a usable name counts: 2 to 24 characters on its line, or on the next line without
    digits and stops where the heading has no name.
    """
    lines = pages.select(group, page, head_lines(F.col(text), None).alias("x"))
    heads = F.slice("x", 1, 8)

    def named(line: Column, i: Column) -> Column:
        own = stripped(F.regexp_extract(line, HEADING, 1))
        nxt = F.coalesce(F.get("x", i + 1), F.lit(""))
        below = F.when(line.rlike(BARE_HEADING) & F.length(nxt).between(2, 24) & ~nxt.rlike(r"[0-9，,。、；;：:]"), nxt)
        return F.when(line.rlike(HEADING), F.when(F.length(own).between(2, 24), own)).otherwise(below)

    found = F.get(F.filter(F.transform(heads, named), lambda n: n.isNotNull()), F.lit(0))
    lines = lines.select(group, page, stripped(F.regexp_replace(found, CONTINUED, "")).alias("section")).where("section <> ''")
    return lines.groupBy(group, "section").agg(F.min(page).alias(page))


def trusted(spans: DataFrame, group: str = "code", widest: int = 15, many: int = 30) -> DataFrame:
    """Sections that can be trusted: known names, or clean names of at least five pages; where more than `many` are left, the widest only.

    spans has group, section, page and span.
    """
    name = F.col("section")
    bare = F.regexp_replace(F.regexp_replace(name, r"^第[一二三四五六七八九十]+\s*节\s*", ""), r"^[0-9]{1,2}\s+", "")
    known = name.rlike("|".join(KNOWN_SECTIONS)) | bare.rlike("|".join(KNOWN_SECTIONS))
    han = F.regexp_count(name, F.lit("[一-鿿]"))
    clean = F.length(name).between(3, 20) & ~name.rlike(r"[，,。、；;：:（）()【】\[\]｜|/\\%#@]") & ~name.rlike("[0-9]") & ~name.rlike("[A-Za-z]{2,}") & (han > 1)
    fine = ~name.rlike(r"[\x00-\x1f\x7f]") & ~name.rlike("|".join(ORG_NAMES)) & (han >= 2) & ~name.isin(*GROUP_TITLES)
    kept = spans.where(fine & (known | (clean & (F.col("span") >= 5))))
    by = Window.partitionBy(group)
    kept = kept.withColumn("_n", F.count("*").over(by)).withColumn("_place", F.row_number().over(by.orderBy(F.col("span").desc(), "page", "section")))
    return kept.where((F.col("_n") <= many) | (F.col("_place") <= widest)).drop("_n", "_place")


def page_offset(body: DataFrame, contents: DataFrame, group: str = "code") -> DataFrame:
    """group and page_offset: the most frequent difference of pages of sections that both know, the smallest of ties; 0 for fewer than two.

    Each section of the body meets the first one of the contents that is equal to it, holds it or is held by it. Both lists are short
    for each group.
    """
    lists = contents.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("page", "section"))).alias("_c"))
    met = body.join(lists, group)
    first = F.get(F.filter("_c", lambda c: F.contains(c["section"], F.col("section")) | F.contains(F.col("section"), c["section"])), F.lit(0))
    rows = met.select(group, (F.col("page") - first["page"]).alias("d")).where("d is not null")
    return rows.groupBy(group).agg(F.when(F.count("*") >= 2, F.mode("d", True)).otherwise(0).cast("int").alias("page_offset"))


def merged_sections(body: DataFrame, contents: DataFrame, offsets: DataFrame, pages: DataFrame, group: str = "code") -> DataFrame:
    """group, section and page: sections of the contents moved by the offset and kept within the document, those of the body instead where both know one.

    pages has group and pages, the last page.
    """
    moved = contents.join(offsets, group, "left").join(pages, group)
    moved = moved.select(group, "section", F.least("pages", F.greatest(F.lit(1), F.col("page") + F.coalesce("page_offset", F.lit(0)))).alias("moved"))
    both = moved.join(body.select(group, "section", "page"), [group, "section"], "full_outer")
    return both.select(group, "section", F.coalesce("page", "moved").alias("page"))
