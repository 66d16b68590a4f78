"""Visually identical text with different characters: every text in one form, by whole batches of code points.

A batch of Arrow text is copied to one array of code points. Table gathers give each code point its length and place in a
flat table of expansions, so one repeat and one gather fold the whole batch. Accents are then ordered and composed by
searches in a sorted table of pairs. No step calls a string function for a row.

Defined results: null stays null; empty text stays empty; text of invisible characters only becomes empty; "\\n" is kept
and never made from another character, so the number of lines stays.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamgrid.functions.glyphs import compositions, foldings
from loamgrid.session import durable

#: Bytes of text that are folded at once; bounds the memory of a task whatever the rows hold.
BLOCK_BYTES = 2_000_000
PLANES = 0x110000
HANGUL_L, HANGUL_V, HANGUL_T, HANGUL_S = 0x1100, 0x1161, 0x11A7, 0xAC00


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """By code point: length and start of its expansion, flat expansions, class of marks and single replacement; pairs, sorted."""
    import unicodedata

    length = np.ones(PLANES, np.uint8)
    start = np.zeros(PLANES, np.int32)
    flat: list[int] = []
    for code, text in foldings().items():
        length[code], start[code] = len(text), len(flat)
        flat.extend(map(ord, text))
    rank = np.zeros(PLANES, np.uint8)
    for code in range(0x300, 0x1F000):
        if kind := unicodedata.combining(chr(code)):
            rank[code] = kind
    alone = np.arange(PLANES, dtype=np.uint32)
    for code, text in foldings().items():
        if len(text) == 1:
            alone[code] = ord(text)
    joins = sorted((a << 21 | b, c) for (a, b), c in compositions().items())
    keys, made = np.array([k for k, _ in joins], np.int64), np.array([c for _, c in joins], np.uint32)
    second = np.zeros(PLANES, bool)
    second[[b for _, b in compositions()]] = True
    second[HANGUL_V : HANGUL_V + 21] = True
    second[HANGUL_T + 1 : HANGUL_T + 28] = True
    return length, start, np.array(flat, np.uint32), rank, alone, keys, made, second


def _composed(first: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """What each base and mark make, 0 for nothing."""
    keys, made = _tables()[5:7]
    wanted = first.astype(np.int64) << 21 | mark.astype(np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = np.where(keys[at] == wanted, made[at], 0).astype(np.int64)
    lead, vowel = first.astype(np.int64) - HANGUL_L, mark.astype(np.int64) - HANGUL_V
    out = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), HANGUL_S + (lead * 21 + vowel) * 28, out)
    block, tail = first.astype(np.int64) - HANGUL_S, mark.astype(np.int64) - HANGUL_T
    return np.where((block >= 0) & (block < 11172) & (block % 28 == 0) & (tail > 0) & (tail < 28), first + tail, out)


def _compose(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then rounds of joining the first free mark of each base."""
    rank, second = _tables()[3], _tables()[7]
    while True:
        kind = rank[codes]
        first = np.r_[True, row[1:] != row[:-1]]
        head = (kind == 0) | first
        if len(codes) > 1 and ((kind[1:] < kind[:-1]) & (kind[1:] > 0)).any():
            order = np.lexsort((np.arange(len(codes)), kind, np.cumsum(head)))
            codes, kind, row = codes[order], kind[order], row[order]
            head = (kind == 0) | first
        owner = np.maximum.accumulate(np.where(head, np.arange(len(codes), dtype=np.int32), 0))
        at = np.flatnonzero(second[codes] & ~first)
        # A mark joins its base if nothing of the same or a higher class stands between; a base joins the one before it.
        before = np.where(kind[at] == 0, at - 1, owner[at])
        free = (before == at - 1) | (kind[at - 1] < kind[at])
        free &= (rank[codes[before]] == 0) & (row[before] == row[at])
        at, before = at[free], before[free]
        new = _composed(codes[before], codes[at])
        at, before, new = at[new > 0], before[new > 0], new[new > 0]
        if not len(at):
            return codes, row
        before, one = np.unique(before, return_index=True)
        at, new = at[one], new[one]
        chained = np.isin(before, at)  # its base is itself being joined in this round: next round
        at, before, new = at[~chained], before[~chained], new[~chained]
        codes = codes.copy()
        codes[before] = new
        keep = np.ones(len(codes), bool)
        keep[at] = False
        codes, row = codes[keep], row[keep]


def fold_codes(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folds code points; row says to which text each belongs, in ascending order."""
    length, start, flat, _, alone, _, _, second = _tables()
    if not len(codes):
        return codes, row
    n = length[codes]
    odd = np.flatnonzero(n != 1)
    source = codes
    codes = alone[codes]
    if len(odd):
        codes, row = np.repeat(codes, n), np.repeat(row, n)
        # Where the k-th odd code point begins now: each odd one before it has moved it.
        moved = odd + np.cumsum(n[odd].astype(np.int64) - 1) - (n[odd].astype(np.int64) - 1)
        for width in np.unique(n[odd]):
            if width > 1:
                some = n[odd] == width
                for k in range(width):
                    codes[moved[some] + k] = flat[start[source[odd[some]]] + k]
    if len(codes) and second[codes].any():
        # Only rows with a joining character go through the composing rounds.
        some = np.zeros(int(row[-1]) + 1, bool)
        some[row[second[codes]]] = True
        some = some[row]
        done, rows = _compose(codes[some], row[some])
        codes, row = np.concatenate([codes[~some], done]), np.concatenate([row[~some], rows])
        order = np.argsort(row, kind="stable")
        codes, row = codes[order], row[order]
    return codes, row


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the row of each, and code points of each row. Nulls have none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    ends = heads[offsets - offsets[0]]
    sizes = np.diff(ends)
    return codes, np.repeat(np.arange(len(texts), dtype=np.int32), sizes), sizes


def encode(codes: np.ndarray, row: np.ndarray, rows: int, nulls: np.ndarray | None = None) -> pa.Array:
    """Arrow text of folded code points."""
    width = (codes >= 0x80).view(np.uint8) + (codes >= 0x800).view(np.uint8) + (codes >= 0x10000).view(np.uint8) + np.uint8(1)
    places = np.r_[0, np.cumsum(width, dtype=np.int32)].astype(np.int32)
    ends = places[np.r_[0, np.cumsum(np.bincount(row, minlength=rows))]]
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    valid = None
    if nulls is not None and nulls.any():
        valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), rows, [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def blocks(texts: pa.Array, most: int = BLOCK_BYTES):
    """The array cut so that no part has more than `most` bytes, but for a single longer text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def fold_array(texts: pa.Array) -> pa.Array:
    """All texts of an Arrow array in one form."""
    out = []
    for part in blocks(texts):
        codes, row, _ = decode(part)
        codes, row = fold_codes(codes, row)
        out.append(encode(codes, row, len(part), np.asarray(part.is_null())))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return fold_array(texts)


def canonical(text: Column) -> Column:
    """The one form of a text column."""
    return _folded(text)


def canonical_text(df: DataFrame, column: str = "text", to: str | None = None) -> DataFrame:
    """The table with its text column in one form; other columns, also one of the new name, keep their place."""
    return df.withColumn(to or column, canonical(F.col(column)))


def marked_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """k, 128 bits of the form (f1, f2) and of the string (r1, r2) of each text; stored, as texts are folded once only."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), canonical(F.col(text)).alias("f"))
    bits = [F.xxhash64(x, *salt).alias(n) for n, x, salt in (("f1", "f", ()), ("f2", "f", (F.lit("salt"),)), ("r1", "t", ()), ("r2", "t", (F.lit("salt"),)))]
    return durable(rows.select("k", *bits))


def lookalike_classes(df: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key and class (its smallest key) of each row whose text has the form of a different string, with the class's strings and rows."""
    marked = marked_rows(df, key, text).distinct()
    strings = marked.groupBy("f1", "f2", "r1", "r2").agg(F.min("k").alias("least"), F.count("*").alias("n"))
    classes = strings.groupBy("f1", "f2").agg(F.min("least").alias("class"), F.count("*").alias("n_strings"), F.sum("n").alias("n_rows")).where("n_strings > 1")
    return marked.join(classes, ["f1", "f2"]).select(F.col("k").alias("key"), "class", "n_strings", "n_rows").distinct()


def lookalike_pairs(df: DataFrame, key: str = "key", text: str = "text", hot: int = 1_000, salts: int = 64) -> DataFrame:
    """Pairs of keys whose texts differ as strings but have one form: columns key_a < key_b.

    Only fingerprints are shuffled. A class of rows of one form takes part only if it holds two different strings. Rows of
    a class with more than `hot` members are salted on one side and repeated for each salt on the other, so that its pairs
    are made by many tasks. Null texts take no part. A key that comes with several different texts is not paired with itself.
    """
    marked = marked_rows(df, key, text)
    classes = marked.groupBy("f1", "f2").agg(F.min("r1").alias("a"), F.max("r1").alias("b"), F.count("*").alias("n"))
    classes = classes.where("a <> b").select("f1", "f2", (F.col("n") > hot).alias("big"))
    rows = durable(marked.join(classes, ["f1", "f2"]).distinct())
    left = rows.withColumn("s", F.when(F.col("big"), F.pmod(F.xxhash64("k"), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    right = rows.withColumn("s", F.explode(F.when(F.col("big"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    a, b = left.alias("a"), right.alias("b")
    same = (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2")) & (F.col("a.s") == F.col("b.s"))
    differ = (F.col("a.r1") != F.col("b.r1")) | (F.col("a.r2") != F.col("b.r2"))
    return a.join(b, same & differ & (F.col("a.k") < F.col("b.k"))).select(F.col("a.k").alias("key_a"), F.col("b.k").alias("key_b")).distinct()
