"""Quantities recorded in different units: levels of known metrics as whole numbers of each metric's base unit.

The JVM brings text to one form, takes tables apart and cuts the statements of a level out of running text. The grammar of
numbers (groups of digits, Chinese numerals, compound amounts such as 3亿2,000万) and of unit expressions (千元, 元/股, MWh,
kg/m³, 元每千瓦时) then reads these short pieces in Arrow batches. A unit is a product of atoms with exponents; each atom has a vector of
dimensions, a scale and an offset. An amount is converted only if its vector is that of the metric, with exact fractions. An
offset counts where a unit is one atom by itself; a denominator that isn't known makes an amount unreadable.

Defined results: null and empty tables, rows, cells and texts give nothing; a cell without a number gives nothing; an amount
without any unit in reach gives nothing; an amount that isn't a whole number of base units, or is beyond a bigint, gives
nothing; repeated rows give the same row again and are made distinct at the end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.glyphs import plain
from loamgrid.session import small

#: The places of a dimension vector.
DIMENSIONS = ("money", "share", "person", "energy", "mass", "length", "time", "temperature")


@dataclass(frozen=True)
class Unit:
    """value in canonical units = value * scale + offset."""

    powers: tuple[int, ...]
    scale: Fraction
    offset: Fraction = Fraction(0)


def _powers(**kinds: int) -> tuple[int, ...]:
    return tuple(kinds.get(d, 0) for d in DIMENSIONS)


_YUAN, _SHARE, _PERSON = _powers(money=1), _powers(share=1), _powers(person=1)
_KWH, _KG, _M, _MINUTE, _KELVIN, _ONE = _powers(energy=1), _powers(mass=1), _powers(length=1), _powers(time=1), _powers(temperature=1), _powers()
#: An amount that has a unit which can't be read; it fits nothing.
UNREADABLE = Unit((), Fraction(1))

#: Atoms of unit expressions in the canonical units yuan, share, person, kWh, kg, m, minute, kelvin.
ATOMS = {
    **{w: Unit(_YUAN, Fraction(1)) for w in ("元", "yuan", "rmb", "cny", "人民币")},
    **{w: Unit(_YUAN, Fraction(1, 10)) for w in ("角", "jiao")},
    **{w: Unit(_YUAN, Fraction(1, 100)) for w in ("分", "fen")},
    "厘": Unit(_YUAN, Fraction(1, 1000)),
    **{w: Unit(_SHARE, Fraction(1)) for w in ("股", "share")},
    **{w: Unit(_PERSON, Fraction(1)) for w in ("人", "名", "位", "people", "person", "persons", "employees", "employee", "staff")},
    **{w: Unit(_ONE, Fraction(1, 10_000)) for w in ("基点", "个基点", "bps", "bp", "basis points")},
    **{w: Unit(_ONE, Fraction(1, 100)) for w in ("%", "per cent", "percent")},
    **{w: Unit(_ONE, Fraction(1)) for w in ("倍", "times")},
    **{w: Unit(_KWH, Fraction(1)) for w in ("千瓦时", "度", "kwh")},
    **{w: Unit(_KWH, Fraction(1000)) for w in ("兆瓦时", "mwh")},
    **{w: Unit(_KWH, Fraction(1_000_000)) for w in ("吉瓦时", "gwh")},
    **{w: Unit(_KG, Fraction(1)) for w in ("千克", "公斤", "kg")},
    **{w: Unit(_KG, Fraction(1000)) for w in ("吨", "t", "tonnes", "tonne", "tons", "tco2e")},
    **{w: Unit(_KG, Fraction(1_000_000)) for w in ("kt", "kilotonnes", "ktco2e")},
    **{w: Unit(_M, Fraction(1)) for w in ("米", "m", "metre", "metres")},
    **{w: Unit(_powers(length=2), Fraction(1)) for w in ("平方米", "sqm", "square metres", "square meters")},
    **{w: Unit(_powers(length=2), Fraction(10_000)) for w in ("公顷", "hectares", "hectare", "ha")},
    **{w: Unit(_powers(length=2), Fraction(1_000_000)) for w in ("平方公里", "平方千米")},
    **{w: Unit(_powers(length=3), Fraction(1)) for w in ("立方米", "cubic metres", "cubic meters")},
    **{w: Unit(_powers(length=3), Fraction(1, 1000)) for w in ("升", "litres", "liters")},
    **{w: Unit(_powers(length=3), Fraction(1000)) for w in ("megalitres", "megaliters")},
    **{w: Unit(_MINUTE, Fraction(1)) for w in ("分钟", "minutes", "minute")},
    **{w: Unit(_MINUTE, Fraction(60)) for w in ("小时", "hours", "hour")},
    **{w: Unit(_MINUTE, Fraction(1440)) for w in ("天", "日", "days", "day")},
    **{w: Unit(_KELVIN, Fraction(1), Fraction(27315, 100)) for w in ("℃", "°c", "摄氏度", "degrees celsius")},
    **{w: Unit(_KELVIN, Fraction(5, 9), Fraction(45967, 180)) for w in ("℉", "°f", "华氏度", "degrees fahrenheit")},
    **{w: Unit(_KELVIN, Fraction(1)) for w in ("开尔文", "kelvin")},
}
#: Atoms that are a unit only where a denominator follows.
NOT_ALONE = ("角", "jiao", "分", "厘", "股", "share", "人民币", "rmb", "cny", "米", "metre", "metres")
#: Words for powers of ten before a unit.
SCALES = {"thousand": 10**3, "'000": 10**3, "million": 10**6, "mn": 10**6, "billion": 10**9, "bn": 10**9, "十": 10, "百": 100, "千": 1000, "万": 10**4, "亿": 10**8}
#: What may stand after a mass of greenhouse gas without changing it.
_GAS = r"(?:二氧化碳当量|\s?(?:of\s)?co2e)"
_PER = r"(?:\s?/\s?|\sper\s(?!cent)|每)"


def _factor(text: str, scaled: bool) -> Unit | None:
    """An atom with its exponent, behind a scale if there may be one."""
    text = re.sub(f"{_GAS}$", "", text.strip())
    power = {"²": 2, "³": 3}.get(text[-1:], 1)
    name = text.rstrip("²³").strip()
    if atom := ATOMS.get(name):
        alone = atom.offset if power == 1 else Fraction(0)
        return Unit(tuple(power * x for x in atom.powers), atom.scale**power, alone)
    found = re.match(f"({_SCALE})\\s?(.+)", name) if scaled else None
    inner = _factor(found.group(2) + text[len(text.rstrip("²³")) :], False) if found else None
    return inner and Unit(inner.powers, inner.scale * scale_of(found.group(1)))


@lru_cache(maxsize=100_000)
def read_unit(text: str) -> Unit:
    """The unit that an expression means: factors behind `/`, `per` or 每 divide. What isn't known makes it unreadable."""
    first, *behind = re.split(_PER, text.strip().lower())
    out = _factor(first, False)
    for part in behind:
        factor = _factor(part, True)
        if out is None or factor is None:
            return UNREADABLE
        out = Unit(tuple(a - b for a, b in zip(out.powers, factor.powers, strict=True)), out.scale / factor.scale)
    return out or UNREADABLE


def parse_unit(text: str) -> Unit:
    """The unit of an expression that must be known."""
    if (found := read_unit(text)) is UNREADABLE:
        raise ValueError(f"unknown unit: {text}")
    return found


# --- the grammar ------------------------------------------------------------------------------------------------------

_NUMBER = r"\d{1,3}(?:[, ]\d{3})+(?![\d])(?:\.\d+)?|\d+(?:\.\d+)?"
_CHINESE = r"[零〇一二两三四五六七八九十][零〇一二两三四五六七八九十百千万亿]*"
_SCALE = r"[十百千万亿]+|(?:thousand|million|billion|mn|bn)(?![a-z])"


def _words(words) -> str:
    """Alternatives, longest first; a word of letters ends at a word's end, since `m` begins `million`."""
    return "|".join(re.escape(w).replace(r"\ ", r"\s") + ("(?![a-z])" if w[-1].isascii() and w[-1].isalpha() else "") for w in sorted(words, key=len, reverse=True))


_ATOM = rf"(?:(?:{_words(ATOMS)})[²³]?{_GAS}?)"
#: Factors with their denominators, of which those behind a slash, `per` or 每 may be words that aren't known.
_UNIT = rf"{_ATOM}(?:{_PER}(?:{_ATOM}|(?:{_SCALE})\s?{_ATOM}|[^\W\d_]+))*|per\s(?!cent)(?:{_ATOM}|[a-z]+)"
#: The same to cut statements out of text: a denominator is any word there.
_UNIT_CUT = rf"{_ATOM}(?:{_PER}\p{{L}}{{1,12}}[²³]?)*|per\s(?!cent)\p{{L}}+"
_MONEY = r"人民币|rmb|cny|[¥￥]"
#: 1 loss, 2 sign, 3 currency, 4 sign, 5 number, 6 second number of a compound, 7 scale, 8 unit, 9 scale without unit
QUANTITY = (
    rf"((?:净?亏损|a?\s?loss\sof\s?))?\s?([-(])?\s?({_MONEY})?\s?([-(])?\s?({_NUMBER}|{_CHINESE})(?!\s?年)\s?\)?"
    rf"(?:\s?亿\s?({_NUMBER})(?=\s?万))?(?:\s?({_SCALE})?\s?({_UNIT})|\s?({_SCALE}))?"
)
#: The same without groups, to stand inside another expression.
_Q = re.sub(r"\((?!\?)(?![^\[\]]*\])", "(?:", QUANTITY.replace(_UNIT, _UNIT_CUT))
_ABOUT = r"(?:\s?(?:为|达到|达|约|:|实现|是|合计|共计|近|仅|总计))*"
_ENGLISH = r"\s(?:was|were|is|reached|amounted\sto|stood\sat|totalled|came\sto|of)\s(?:about\s|approximately\s|around\s|nearly\s)?"
_STATED = r"(?:单位|数字|金额|amounts?|figures?)[^。;.\n0-9]{0,34}?(?:以|为|均为|:|\sin)\s?(?:人民币|rmb|cny)?\s?((?:[十百千万亿]*元)|(?:million|billion|thousand|'000))"


def _plain_stated() -> str:
    return _STATED.replace("((?:[十百千万亿]*元)|", "(?:(?:[十百千万亿]*元)|")


def level_pattern(names: str) -> str:
    """Statements of a level with one or two amounts, or a statement of the unit of a passage."""
    return (
        rf"(?i)(?:{names})(?:由上年的{_Q}变为{_Q}"
        rf"|{_ABOUT}{_Q}(?:;\s?上年同期(?:为|:)?\s?{_Q})?"
        rf"|\s(?:rose\s|fell\s|changed\s|increased\s|decreased\s)?from\s{_Q}\sto\s{_Q}"
        rf"|{_ENGLISH}{_Q}(?:(?:\sin\s\d{{4}})?,?\scompared\swith\s{_Q})?)"
        rf"|{_plain_stated()}"
    )


@lru_cache(maxsize=1)
def _expressions() -> tuple[re.Pattern, ...]:
    """Amount, nothing but an amount, an unadorned unit, and a statement of the unit of a passage."""
    alone = rf"(?i)^(?:.*?(?:[(/:]|单位|\s))??\s?({_MONEY})?\s?(?:({_SCALE}|'000)?\s?({_UNIT})|({_SCALE}|'000))\s?\)?\s*$"
    return tuple(re.compile(x) for x in (rf"(?i){QUANTITY}", rf"(?i)^\s*{QUANTITY}\s*\)?\s*$", alone, rf"(?i){_STATED}"))


def chinese_number(text: str) -> int:
    """The whole number a Chinese numeral means."""
    total = section = digit = 0
    for char in text:
        if char == "亿":
            total, section, digit = (total + section + digit) * 10**8, 0, 0
        elif char == "万":
            total, section, digit = total + (section + digit) * 10**4, 0, 0
        elif char in "十百千":
            section, digit = section + max(digit, 1) * SCALES[char], 0
        else:
            digit = 2 if char == "两" else 0 if char == "〇" else "零一二三四五六七八九".index(char)
    return total + section + digit


def scale_of(word: str) -> int:
    """The power of ten of scale words; 百万 is a product."""
    word = word.lower()
    if word in SCALES:
        return SCALES[word]
    out = 1
    for char in word:
        out *= SCALES[char]
    return out


@lru_cache(maxsize=100_000)
def scaled_unit(scale: str, unit: str, money: bool) -> Unit | None:
    """The unit that a scale and a unit expression mean; `money` says that a currency stands before. None without a unit."""
    word = re.sub(r"\s", " ", unit.lower())
    if word.startswith("per ") and word != "per cent":
        found = read_unit("元 " + word)
        # Without a currency the numerator is open: that of shares stands elsewhere, and a word that isn't known is none.
        if not money:
            return None if word == "per share" or found is UNREADABLE else UNREADABLE
        word = "元 " + word
    elif not word:
        if not money:
            return None
        word = "元"
    found = read_unit(word)
    return found if found is UNREADABLE else Unit(found.powers, found.scale * scale_of(scale), found.offset if scale_of(scale) == 1 else Fraction(0))


def quantity(text: str, whole: bool = False) -> tuple[Fraction, Unit | None] | None:
    """The first amount in a text, or a text that is nothing else, with its unit if it has one."""
    match = _expressions()[1].match(text) if whole else _expressions()[0].search(text)
    if not match:
        return None
    loss, sign, money, second_sign, number, more, scale, unit, scale_alone = (x or "" for x in match.groups())
    if unit.lower() in NOT_ALONE:
        if whole:
            return None
        scale, unit, scale_alone = "", "", scale
    value = Fraction(re.sub("[, ]", "", number)) if number[0].isdigit() and number[0].isascii() else Fraction(chinese_number(number))
    if more:  # a compound is counted in 万: 795亿2,663万 is 7950000 + 2663
        value = value * 10**4 + Fraction(re.sub("[, ]", "", more))
    scale = scale or scale_alone
    return -value if loss or sign or second_sign else value, scaled_unit(scale, unit, bool(money or (scale and not unit)))


@lru_cache(maxsize=100_000)
def stated_unit(text: str | None) -> Unit | None:
    """The unit an unadorned expression names: `(RMB million)`, `单位:千元`, `(元)`, `/ 千人`."""
    match = text and _expressions()[2].match(text)
    if not match:
        return None
    money, scale, unit, alone = (x or "" for x in match.groups())
    if unit.lower() in NOT_ALONE:
        return None
    return scaled_unit(scale or alone, unit, bool(money or alone))


@lru_cache(maxsize=100_000)
def passage_unit(text: str | None) -> Unit | None:
    """The unit of money that a sentence states for its surroundings."""
    match = text and _expressions()[3].search(text)
    return scaled_unit(match.group(1).removesuffix("元"), "元", True) if match else None


@dataclass(frozen=True)
class Metric:
    metric_id: int
    base: Unit
    water: bool

    def fits(self, unit: Unit | None) -> bool:
        return unit is not None and (unit.powers == self.base.powers or (self.water and unit.powers == _KG))

    def in_base(self, value: Fraction, unit: Unit | None) -> int | None:
        """The amount as a whole number of base units within a bigint, else nothing."""
        if not self.fits(unit):
            return None
        out = value * unit.scale + unit.offset
        if unit.powers != self.base.powers:
            out /= 1000  # a kilogram of water is a litre, a thousandth of a cubic metre
        out = (out - self.base.offset) / self.base.scale
        return out.numerator if out.denominator == 1 and abs(out.numerator) < 2**63 else None


@dataclass(frozen=True)
class Metrics:
    """The known metrics: their names as one pattern, and each by its names."""

    names: str
    by_name: dict[str, Metric]

    def named(self, name: str) -> Metric | None:
        return self.by_name.get(re.sub(r"\s", " ", name.lower()))


def metrics(table: DataFrame) -> Metrics:
    """Reads the table of metrics: a dictionary, bounded by its meaning."""
    by_name = {}
    for row in small(table.select("metric_id", "name_zh", "name_en", "dimension", "base_unit", "aliases"), 10_000, "metrics"):
        for name in (row.name_zh, row.name_en, *(row.aliases or [])):
            if name:
                by_name[name.lower()] = Metric(row.metric_id, parse_unit(row.base_unit), row.dimension == "volume")
    return Metrics("|".join(re.escape(w).replace(r"\ ", r"\s") for w in sorted(by_name, key=len, reverse=True)), by_name)


_CHANGE = "增|减|变动|同比|环比|幅|change|growth|yoy"
_LEVEL = "struct<metric_id: int, value_base: bigint>"


def _cell_reader(known: Metrics):
    """A column function from label, cell, head, title and what is said around to a level."""
    label_pattern = rf"(?i)^\s*({known.names})\s*(?:[(/]\s*(.*?)\s*\)?)?\s*$"

    def labelled(label: str) -> tuple[Metric | None, Unit | None]:
        match = re.match(label_pattern, label)
        return (known.named(match.group(1)), stated_unit(match.group(2))) if match else (None, None)

    @F.arrow_udf(_LEVEL)
    def read(label: pa.Array, cell: pa.Array, head: pa.Array, title: pa.Array, around: pa.Array) -> pa.Array:
        ids, values, labels = [], [], {}
        for a, c, h, t, s in zip(*(x.to_pylist() for x in (label, cell, head, title, around)), strict=True):
            if a not in labels:  # a few labels stand before most cells
                labels[a] = labelled(a) if a else (None, None)
            metric, unit_of_label = labels[a]
            amount = quantity(c, whole=True) if metric and c else None
            value = None
            if amount:
                number, unit = amount
                if unit is None:
                    near = (unit_of_label, stated_unit(h), stated_unit(t), passage_unit(s))
                    unit = next((u for u in near if u is UNREADABLE or metric.fits(u)), None)
                value = metric.in_base(number, unit)
            ids.append(None if value is None else metric.metric_id)
            values.append(value)
        return pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(values, pa.int64())], names=["metric_id", "value_base"])

    return read.asNondeterministic()  # so that a filter on its result doesn't run it a second time


def _levels(rows: DataFrame, level: Column) -> DataFrame:
    return rows.select("rec_key", level.alias("x")).select("rec_key", "x.metric_id", "x.value_base").where("value_base is not null")


def table_levels(pages: DataFrame, known: Metrics, key: str = "page_id", tables: str = "tables", text: str = "text") -> DataFrame:
    """Levels in nested tables of pages: rec_key, metric_id, value_base."""
    # Only what is said of tables counts; what is said of a paragraph doesn't.
    said = F.regexp_extract(plain(F.col(text)), rf"(?i)(?:表|tables?)[^。\n]{{0,20}}?{_plain_stated()}", 0)
    one = pages.where(F.size(tables) > 0).select(F.col(key).cast("string").alias("rec_key"), said.alias("around"), F.explode(tables).alias("t")).where("size(t.rows) > 0")
    heads = F.transform(F.get("t.rows", F.lit(0)), plain)
    rows = one.select("rec_key", "around", plain(F.col("t.title")).alias("title"), heads.alias("heads"), F.posexplode("t.rows").alias("row_no", "r")).where("size(r) > 1")
    rows = rows.withColumn("label", plain(F.col("r")[0])).where(F.col("label").rlike(rf"(?i)^\s*(?:{known.names})"))
    body = rows.select("rec_key", "around", "title", "heads", "row_no", "label", F.posexplode("r").alias("cell_no", "cell")).where("cell_no > 0")
    return _read_cells(body.withColumn("cell", plain(F.col("cell"))), known)


def _read_cells(body: DataFrame, known: Metrics) -> DataFrame:
    """Cells with a number, unless their column is one of changes."""
    head = F.when(F.col("row_no") > 0, F.get("heads", F.col("cell_no")))
    body = body.where(F.col("cell").rlike(r"[0-9零〇一二两三四五六七八九十]")).withColumn("head", head)
    body = body.where(~F.coalesce(F.col("head").rlike(f"(?i){_CHANGE}"), F.lit(False)))
    return _levels(body, _cell_reader(known)("label", "cell", "head", "title", "around"))


def table_text_levels(chunks: DataFrame, known: Metrics, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Levels in tables written as lines of cells between bars, with an optional title line."""
    lines = chunks.select(F.col(key).cast("string").alias("rec_key"), F.split(plain(F.col(text)), "\n").alias("lines")).where("lines is not null")
    titled = F.get("lines", F.lit(0)).startswith("【表】")
    lines = lines.select(
        "rec_key",
        F.when(titled, F.regexp_replace(F.get("lines", F.lit(0)), "^【表】", "")).alias("title"),
        F.when(titled, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines")).alias("body"),
    )
    rows = lines.select("rec_key", "title", F.split(F.get("body", F.lit(0)), r" \| ").alias("heads"), F.posexplode("body").alias("row_no", "line"))
    rows = rows.where(F.col("line").contains(" | ") & F.col("line").rlike(rf"(?i)^\s*(?:{known.names})"))
    body = rows.select("rec_key", "title", "heads", "row_no", F.substring_index("line", " | ", 1).alias("label"), F.posexplode(F.split("line", r" \| ")).alias("cell_no", "cell"))
    return _read_cells(body.where("cell_no > 0").withColumn("around", F.lit(None).cast("string")), known)


#: Between the two amounts of "from A to B", "由上年的A变为B", "A;上年同期为B" and "A, compared with B".
_BETWEEN = re.compile(r"(?i)变为|;\s?上年同期(?:为|:)?|(?:\sin\s\d{4})?,?\scompared\swith\s|(?<=[\da-z%])\sto\s(?=[\d¥￥(-]|rmb|cny)")
_STATEMENT = re.compile("(?i)^(?:单位|数字|金额|amounts?|figures?)")


def _part_reader(known: Metrics):
    """A column function from the parts cut out of a text, in their order, to its levels."""
    begins = re.compile(f"(?i)^({known.names})")

    def levels(parts: list[str]) -> list[tuple[int, int]]:
        # The unit stated last holds; before the first statement, the first one holds.
        around = next((x for x in parts if _STATEMENT.match(x)), None)
        out = []
        for part in parts:
            if _STATEMENT.match(part):
                around = part
                continue
            name = begins.match(part)
            metric = known.named(name.group(1)) if name else None
            for piece in _BETWEEN.split(part[name.end() :]) if metric else ():
                if amount := quantity(piece):
                    number, unit = amount
                    value = metric.in_base(number, passage_unit(around) if unit is None else unit)
                    if value is not None:
                        out.append((metric.metric_id, value))
        return out

    @F.arrow_udf(f"array<{_LEVEL}>")
    def read(parts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("metric_id", pa.int32()), ("value_base", pa.int64())]))
        return pa.array([[{"metric_id": m, "value_base": v} for m, v in levels(x)] for x in parts.to_pylist()], kind)

    return read.asNondeterministic()  # so that a filter on its result doesn't run it a second time


def text_levels(chunks: DataFrame, known: Metrics, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Levels in running text. An amount without a unit takes the one stated last before it, else first after it."""
    parts = F.regexp_extract_all(plain(F.col(text)), F.lit(level_pattern(known.names)), F.lit(0))
    found = chunks.select(F.col(key).cast("string").alias("rec_key"), _part_reader(known)(F.coalesce(parts, F.array().cast("array<string>"))).alias("levels"))
    return found.select("rec_key", F.explode("levels").alias("x")).select("rec_key", "x.metric_id", "x.value_base")


def found_levels(pages: DataFrame, chunks: DataFrame, metric_table: DataFrame) -> DataFrame:
    """All levels of the known metrics in nested tables, tables in text and running text: src, rec_key, metric_id, value_base."""
    known = metrics(metric_table)
    parts = [
        table_levels(pages.select("page_id", "tables", "text"), known).withColumn("src", F.lit("tables")),
        table_text_levels(chunks.where("kind = 'table'").select("chunk_id", "text"), known).withColumn("src", F.lit("chunks")),
        text_levels(chunks.where("kind <> 'table' or kind is null").select("chunk_id", "text"), known).withColumn("src", F.lit("chunks")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("src", "rec_key", "metric_id", "value_base").distinct()
