"""Column builders for text: sentences, lines, words, citations and number forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that end a sentence; the ASCII full stop doesn't.
SENTENCE_ENDS = "。！？；!?;"
#: White space that is stripped, named so that all engines strip the same.
BLANKS = " \\t\\r\\n\\x0B\\x0C\\u00A0\\u3000"
#: Lines that begin so are noise.
NOISE = ("证券代码", "证券简称", "股票代码", "股票简称", "年度报告", "半年度报告", r"第\s*\d+\s*页", "©", "www\\.", "http", "本公司不保证", "请务必阅读")
#: Words that say nothing in a search.
STOPWORDS = (
    *("的", "了", "和", "是", "在", "有", "为", "与", "及", "或", "等", "公司", "本", "该", "其", "之", "以", "上", "以下", "包括"),
    *("报告", "年度", "报告期", "期末", "期初", "单位", "人民币", "元", "其中", "我们", "本公司", "集团", "合计", "小计", "其他"),
    *("一", "二", "三", "四", "五", "六", "七", "八", "九", "十"),
)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def sentences(text: Column, ends: str = SENTENCE_ENDS) -> Column:
    """Sentences with their ends, stripped, without empty ones."""
    parts = F.regexp_extract_all(text, F.lit(f"([^{ends}]*[{ends}]|[^{ends}]+)"), F.lit(1))
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def clean_lines(text: Column) -> Column:
    """Stripped lines without empty ones and noise, joined again."""
    lines = F.transform(F.split(F.replace(text, F.lit(" "), F.lit(" ")), "\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike("^(" + "|".join(NOISE) + ")")), "\n")


def words(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of letters or digits as they stand; a run of Chinese characters gives its overlapping pairs.

    One letter alone is no word, one digit is. Repeated words are kept; those of `stop` are left out.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{IsHan}+|[A-Za-z0-9]+)"), F.lit(1))
    pairs = F.transform(
        runs,
        lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(r)).when(F.length(r) < 2, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))
        ),
    )
    kept = F.filter(F.flatten(pairs), lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$"))
    return F.filter(kept, lambda w: ~w.isin(*stop)) if stop else kept


def citations(answer: Column) -> Column:
    """Distinct numbers cited as [n], in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))))


def bare_number(text: Column) -> Column:
    """Without commas and blanks, so that amounts compare as substrings."""
    return F.regexp_replace(text, "[,，\\s　]", "")
