"""One form for characters that look alike: the table behind every comparison of texts.

The table is made by rule from the Unicode database of Python; only the look-alike letters of other scripts are listed.
Kept apart are characters that can be told apart on screen: superscripts, subscripts, circled numbers, fractions, dashes
longer than a hyphen and upper against lower case.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greek and Cyrillic letters and the Latin letters they look like.
LOOKALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϲϳ" "АВЕЅІЈКМНОРСТУХҮҺԌԚԜ" "аеорсухѕіјһԁԛԝѵӏ",
        "ABEZHIKMNOPTYXovicj" "ABESIJKMHOPCTYXYhGQW" "aeopcyxsijhdqwvl",
        strict=True,
    )
)
#: Hyphens and minus signs that look like the ASCII hyphen.
HYPHENS = "‐‑‒–−˗⁃﹣－"
#: Characters without a shape that are not in category Cf.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]
#: Decompositions of these kinds change what is seen.
VISIBLE_KINDS = {"<super>", "<sub>", "<circle>", "<fraction>"}
BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85"


@lru_cache(maxsize=None)
def spelled(char: str) -> str:
    """What a character is folded to, fully taken apart: may be empty or several characters."""
    code = ord(char)
    if char == "\n":
        return char
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in HYPHENS:
        return "-"
    if char in BLANKS or unicodedata.category(char) in ("Zs", "Zl", "Zp"):
        return " "
    if unicodedata.category(char) == "Cf" or code in INVISIBLE or 0xE0000 <= code < 0xE1000:
        return ""
    parts = unicodedata.decomposition(char).split()
    if not parts or parts[0] in VISIBLE_KINDS:
        return char
    codes = parts[1:] if parts[0].startswith("<") else parts
    if parts[0].startswith("<") and codes[0] == "0020" and len(codes) > 1:
        return char  # a spacing accent stays itself
    return "".join(spelled(chr(int(x, 16))) for x in codes)


@lru_cache(maxsize=1)
def foldings() -> dict[int, str]:
    """All characters that don't fold to themselves."""
    planes = (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000))
    return {c: s for c in planes if (s := spelled(chr(c))) != chr(c)}


@lru_cache(maxsize=1)
def compositions() -> dict[tuple[int, int], int]:
    """Base and mark that make one character."""
    out = {}
    for c in (*range(0xD800), *range(0x11000, 0x12000), *range(0x1D100, 0x1D200)):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(c)) == chr(c):
            out[int(parts[0], 16), int(parts[1], 16)] = c
    return out


@lru_cache(maxsize=1)
def _single() -> tuple[str, str, str]:
    """Characters folded to one other, those others, and characters that vanish; only these need no composing."""
    rows = [(chr(c), s) for c, s in foldings().items() if c < 0x10000 and len(s) <= 1]
    kept = [(a, b) for a, b in rows if b]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept), "".join(a for a, b in rows if not b)


#: Ligatures and squared units that `plain` opens; the canonical form of text corpora opens all.
OPENED = "㎡㎢㎥㎜㎝㎞㎎㎏㎘ﬀﬁﬂﬃﬄﬅﬆ…℃№"


def plain(text: Column) -> Column:
    """The folded text without leaving the JVM, for matching words, numbers and units.

    One pass of `translate` and one of `regexp_replace` for each ligature that stands in a text. Accents that are encoded
    apart from their letter stay apart; the operator that also joins these is in the subpackage for text corpora.
    """
    source, target, gone = _single()
    out = F.translate(text, source + gone, target)

    def opened(c: Column) -> Column:
        for char in OPENED:
            c = F.replace(c, F.lit(char), F.lit(spelled(char)))
        return c

    # Ranges, as a class of single characters is searched one by one.
    return F.when(out.rlike("[㌀-㏿ﬀ-ﬆ…℀-№]"), opened(out)).otherwise(out)
