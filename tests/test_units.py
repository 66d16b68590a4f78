from fractions import Fraction

from loamgrid.operators import units

METRICS = "metric_id int, name_zh string, name_en string, dimension string, base_unit string, aliases array<string>"
PAGES = "page_id bigint, tables array<struct<title:string,rows:array<array<string>>,degraded:boolean>>, text string, around string, label string"
CHUNKS = "chunk_id string, kind string, text string, rec_key string, x int"


def metric_table(spark):
    rows = [
        (1, "营业收入", "revenue", "money", "元", ["营收"]),
        (2, "归母净利润", "net profit", "money", "元", None),
        (7, "员工总数", "headcount", "persons", "人", []),
        (8, "充足率", "solvency ratio", "ratio", "基点", []),
        (12, "办公面积", "office floor area", "area", "平方米", []),
        (13, "每股收益", "earnings per share", "pershare", "厘/股", []),
        (15, "取水量", "water withdrawal", "volume", "升", []),
    ]
    return spark.createDataFrame(rows, METRICS)


def test_units_are_products_of_atoms():
    assert units.parse_unit("元/股").powers == (1, -1, 0, 0, 0, 0, 0, 0)
    assert units.parse_unit("元/股").scale / units.parse_unit("厘/股").scale == 1000
    assert units.parse_unit("m²").powers == units.parse_unit("平方米").powers == (0, 0, 0, 0, 0, 2, 0, 0)
    assert units.parse_unit("tonnes of co2e").scale == 1000
    assert units.parse_unit("per cent").scale == Fraction(1, 100)


def test_unit_expressions_are_read_with_their_denominators():
    def powers(text, whole=False):
        unit = units.quantity(text, whole)[1]
        return unit and {d: p for d, p in zip(units.DIMENSIONS, unit.powers, strict=False) if p}

    assert powers("5元/千瓦时") == powers("RMB 5 per kWh") == powers("5元每度") == {"money": 1, "energy": -1}
    assert powers("3 kWh/m²", True) == {"energy": 1, "length": -2} and powers("1 kg/m³") == {"mass": 1, "length": -3}
    assert powers("3吨/人同比增长") == {"mass": 1, "person": -1} and powers("2元/吨") == {"money": 1, "mass": -1}
    assert units.quantity("5元/万股")[1].scale == Fraction(1, 10_000) and units.quantity("3 yuan per MWh")[1].scale == Fraction(1, 1000)
    for text in ("3吨/套", "5元/户", "RMB 5 million per year", "2 tonnes per widget", "3吨每套"):
        assert units.quantity(text)[1] is units.UNREADABLE
    assert powers("5元/6元") == {"money": 1} and powers("5 per cent") == {} and units.quantity("5 per share")[1] is None
    assert units.quantity("5分")[1] is None and units.quantity("5分", whole=True) is None and units.stated_unit("(分)") is None
    assert units.stated_unit("(元/套)") is units.UNREADABLE


def test_offsets_and_denominators_in_levels(spark):
    table = spark.createDataFrame([(1, "机房温度", "room temperature", "temperature", "开尔文", []), (2, "用水强度", None, "intensity", "千克/平方米", None), (3, "电价", None, "price", "分/千瓦时", []), (4, "总资产", "total assets", "money", "元", [])], METRICS)
    texts = {"a": "机房温度为26.85℃。", "b": "Room temperature was 80.33°F.", "c": "用水强度为0.5吨/m²,电价为0.62元/千瓦时。", "d": "总资产为5元/千瓦时。总资产达3亿元/户。", "e": "总资产为5亿元/年。"}
    rows = units.found_levels(spark.createDataFrame([], PAGES), spark.createDataFrame([(k, "text", t, "z", 1) for k, t in texts.items()], CHUNKS), table)
    assert {(r.rec_key, r.metric_id, r.value_base) for r in rows.collect()} == {("a", 1, 300), ("b", 1, 300), ("c", 2, 500), ("c", 3, 62)}


def test_numbers():
    assert units.chinese_number("三百六十九亿") == 369 * 10**8
    assert units.chinese_number("两千零五万") == 2005 * 10**4
    assert units.quantity("795亿2,663万元")[0] * units.quantity("795亿2,663万元")[1].scale == 79526630000
    assert units.quantity("(574,583.5)", whole=True)[0] == Fraction("-574583.5")
    assert units.quantity("亏损人民币3.66亿元")[0] == Fraction("-3.66")
    assert units.quantity("195 096平方米")[0] == 195096
    assert units.quantity("不适用", whole=True) is None
    assert units.quantity("9百万元")[1].scale == 10**6


def levels(spark, pages=(), chunks=()):
    rows = units.found_levels(spark.createDataFrame(list(pages), PAGES), spark.createDataFrame(list(chunks), CHUNKS), metric_table(spark))
    return {tuple(r) for r in rows.collect()}


def test_nearest_unit_in_tables(spark):
    rows = [["项目", "本年(千元)", "同比增减(%)"], ["营业收入 / 万元", "5", "3"], ["归母净利润", "(7)", "1"], ["营收", "2百万元", None], ["员工总数（千人）", "１．５", ""], ["每股收益(分/股)", "2.5"], ["充足率", "—"], None, []]
    page = (1, [("表 (RMB million)", rows, None), None, ("x", None, False), (None, [["项目", "期末"], ["营业收入", "3"]], None)], "本段数字以元计。\n本页表格金额单位均为人民币亿元。", "a", "b")
    assert levels(spark, [page, page]) == {
        ("tables", "1", 1, 50_000), ("tables", "1", 2, -7000), ("tables", "1", 1, 2_000_000), ("tables", "1", 7, 1500), ("tables", "1", 13, 25), ("tables", "1", 1, 300_000_000),
    }


def test_levels_in_text(spark):
    texts = {
        "a": "除特别注明外，以下金额单位均为人民币百万元。营业收入由上年的3变为4.5，同比增长5%。归母净利润为-2；上年同期为1亿元。",
        "b": "Revenue reached RMB1.5 million, compared with CNY 2 mn a year earlier. Solvency ratio was 143.2% in 2025, up 3% year on year.",
        "c": "营业收入的口径说明见释义部分，客户满意度提高25.5个百分点。另存有6亿港元境外存款。",
        "d": "Оffice floоr аrea amounted to 2 hectares. 办公⾯积达97,628㎡。取水量为2.5万吨。",
        "e": "", "f": None, "g": "营业收入为5",
    }
    found = levels(spark, chunks=[(k, "text", t, "z", 1) for k, t in texts.items()] * 2)
    assert found == {
        ("chunks", "a", 1, 3_000_000), ("chunks", "a", 1, 4_500_000), ("chunks", "a", 2, -2_000_000), ("chunks", "a", 2, 10**8),
        ("chunks", "b", 1, 1_500_000), ("chunks", "b", 1, 2_000_000), ("chunks", "b", 8, 14_320),
        ("chunks", "d", 12, 20_000), ("chunks", "d", 12, 97_628), ("chunks", "d", 15, 25_000_000),
    }


def test_tables_in_text(spark):
    text = "【表】指标（人民币万元）\n项目 | 本年 | 期初\n营业收入 | 8,575 | -\n取水量（升） | 6 | 7\n备注"
    assert levels(spark, chunks=[("t", "table", text, "z", 1), ("u", "table", "", None, None)]) == {("chunks", "t", 1, 85_750_000), ("chunks", "t", 15, 6), ("chunks", "t", 15, 7)}


def test_long_text_and_empty_tables(spark):
    long = "合规总部稳步优化产品结构。" * 20_000 + "营业收入为3亿元。"
    assert levels(spark, chunks=[("l", "text", long, "z", 1)]) == {("chunks", "l", 1, 3 * 10**8)}
    assert levels(spark) == set()
