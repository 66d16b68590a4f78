"""Evaluation texts leaking into training text: a distributed positional inverted index of the training corpus.

A term is a run of TERM letters and digits of a text in one form, in lower case and without anything else. Of each WINDOW terms
that follow each other the one with the least hash has a posting (term, doc, position), so that a text has postings by its
wording alone: any run that two texts share, of REACH letters or more, gives them the same postings, each at most WINDOW places from the next. The
index is built once from the whole corpus, whatever the test items are, and stored; items of any number are then looked up in it.

For each span of a test item as long as the wanted run the rarest of its terms in the corpus is the anchor, and a span with a term that the
corpus lacks is dropped. Postings of anchors give candidates (doc, item, offset); the other postings of the item, moved by the
offset, are intersected with those of the document, and neighbours form runs. An exact check against the letters of the candidate documents tells where each
run begins and ends. Runs close to each other give proximity matches.

Defined results: null and empty texts have no terms; items shorter than the run can't leak; repeated documents give the same
pairs again and are made distinct; a term twice in one text gives a posting each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamgrid.llm.canon import PLANES, blocks, decode, encode, fold_codes
from loamgrid.session import durable, fitting, shared_folder

#: Letters and digits in a term, terms of which one has a posting, and the least length of a run that is sure to have one.
TERM, WINDOW = 10, 10
REACH = TERM + WINDOW - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter or digit of each code point, 0 for anything else."""
    out = np.zeros(PLANES, np.uint32)
    for code in (*range(0xD800), *range(0xE000, 0x33480)):
        char = chr(code)
        if char.isalnum():
            low = char.casefold()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a block of texts as code points, and the row of each."""
    codes, row, _ = decode(texts)
    codes, row = fold_codes(codes, row)
    codes = _letters()[codes]
    return codes[codes > 0], row[codes > 0]


def _slid(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` values that follow each other."""
    done = 1
    while 2 * done <= width:
        x, done = f(x[:-done], x[done:]), 2 * done
    return f(x[: done - width], x[width - done :]) if done < width else x


def _hashed(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the term at each letter, the least hash of each window, and whether the window lies in one text."""
    n = len(codes) - TERM + 1
    value, codes = np.zeros(n, np.uint64), codes.astype(np.uint64)
    for k in range(TERM):
        value *= np.uint64(0x100000001B3)
        value += codes[k : k + n]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0x9E3779B97F4A7C15)
    term = (value >> np.uint64(32)).astype(np.uint32)
    return term, _slid(term, WINDOW, np.minimum), row[: n - WINDOW + 1] == row[REACH - 1 :]


def _places(row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """The place in its text of each letter."""
    return at - np.searchsorted(row, np.arange(rows))[row[at]]


def postings_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and place of each posting of a block of texts."""
    codes, row = letters_of(texts)
    if len(codes) < REACH:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    term, least, inside = _hashed(codes, row)
    edge = np.zeros(WINDOW - 1, np.uint32)
    # A term has a posting if it is the least of any window that holds it; windows over the end of a text are none.
    most = _slid(np.concatenate((edge, np.where(inside, least, 0).astype(np.uint32), edge)), WINDOW, np.maximum)
    at = np.flatnonzero((most == term) & (row[: len(term)] == row[TERM - 1 :]))
    return term[at].view(np.int32), row[at], _places(row, at, len(texts))


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, row, place of the window and place of the posting for each window of a block of texts; of equal terms the first."""
    codes, row = letters_of(texts)
    if len(codes) < REACH:
        none = np.zeros(0, np.int64)
        return none.astype(np.int32), none, none, none
    term, least, inside = _hashed(codes, row)
    at = np.flatnonzero(inside)
    least, place = least[at], at + WINDOW - 1
    for k in range(WINDOW - 2, -1, -1):
        place = np.where(term[at + k] == least, at + k, place)
    return least.view(np.int32), row[at], _places(row, at, len(texts)), _places(row, place, len(texts))


def _rows(df: DataFrame, key: str, text: str, made, schema: str) -> DataFrame:
    """What a function of blocks of texts makes: its first array, the keys of its rows, and its other arrays."""
    names = [x.split()[0] for x in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, at = part.column(0), 0
            for texts in blocks(part.column(1)):
                term, row, *places = made(texts)
                yield pa.RecordBatch.from_arrays([pa.array(term), ids.slice(at, len(texts)).take(pa.array(row)), *(pa.array(p.astype(np.int32)) for p in places)], names=names)
                at += len(texts)

    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(batches, schema)


def build_index(documents: DataFrame, folder: str, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the postings (term, doc_id, dpos) of all documents in a folder that all executors share, and reads them from there."""
    _rows(documents, doc_key, text, postings_of, "term int, doc_id bigint, dpos int").write.mode("overwrite").parquet(folder)
    return documents.sparkSession.read.parquet(folder)


@F.arrow_udf(StringType())
def _letters_only(texts: pa.Array) -> pa.Array:
    out = []
    for part in blocks(texts):
        codes, row = letters_of(part)
        out.append(encode(codes, row, len(part)))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _equal_runs(a: Column, b: Column, run: int) -> Column:
    """array<struct<first, last>>: places at which two texts are equal for at least `run` letters."""

    @F.arrow_udf("array<struct<first: int, last: int>>")
    def find(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
            n = min(len(x), len(y))
            x, y = (np.frombuffer(t[:n].encode("utf-32-le"), np.uint32) for t in (x, y))
            same = np.concatenate(([False], x == y, [False]))
            begins, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(~same[1:] & same[:-1])
            out.append([{"first": p, "last": q - 1} for p, q in zip(begins.tolist(), ends.tolist(), strict=True) if q - p >= run])
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))

    return find(a, b)


def candidate_runs(index: DataFrame, items: DataFrame, run: int, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, offset, first and last letter in the item of what the postings say is shared; a run's ends may be
    WINDOW - 1 letters further out."""
    asked = durable(_rows(items, item_key, text, windows_of, "term int, item_id bigint, at int, ipos int").distinct())
    mine = asked.select("item_id", "term", "ipos").distinct()
    hits = durable(index.join(asked.select("term").distinct(), "term"))
    frequency = hits.groupBy("term").agg(F.count("*").alias("n"))
    width = run - REACH + 1
    ahead = Window.partitionBy("item_id").orderBy("at").rowsBetween(0, width - 1)
    known = asked.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = known.select("item_id", F.min(F.struct("n", "ipos", "term")).over(ahead).alias("rare"), F.count("*").over(ahead).alias("wide"))
    anchors = known.where((F.col("wide") >= width) & (F.col("rare.n") > 0)).select("item_id", "rare.ipos", "rare.term").distinct()
    candidates = hits.join(anchors, "term").select("doc_id", "item_id", (F.col("dpos") - F.col("ipos")).alias("offset")).distinct()
    # Each posting of the item says where the document should have it: the two are joined on equality.
    wanted = candidates.join(mine, "item_id").withColumn("dpos", F.col("ipos") + F.col("offset"))
    met = wanted.join(hits.distinct(), ["term", "doc_id", "dpos"]).select("doc_id", "item_id", "offset", "ipos")
    order = Window.partitionBy("doc_id", "item_id", "offset").orderBy("ipos")
    island = met.withColumn("new", F.coalesce(F.col("ipos") - F.lag("ipos").over(order) > WINDOW, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    found = island.groupBy("doc_id", "item_id", "offset", "island").agg(F.min("ipos").alias("first"), (F.max("ipos") + TERM - 1).alias("last"))
    return found.where(F.col("last") - F.col("first") + 1 + 2 * (WINDOW - 1) >= run).drop("island")


def shared_runs(documents: DataFrame, items: DataFrame, run: int = 40, index: DataFrame | None = None, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """All runs of at least `run` letters and digits that a document shares with an item: doc_id, item_id, offset, first and last.

    Without an index one is built and stored in the shared folder. Only letters of candidate documents are read for the exact check.
    """
    if run < REACH:
        raise ValueError(f"runs shorter than {REACH} letters may have no posting")
    if index is None:
        index = build_index(documents, shared_folder(documents.sparkSession, "postings"), doc_key, text)
    found = durable(candidate_runs(index, items, run, item_key, text))
    whole = documents.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("doc_id"), F.col(text).alias("text"))
    affected = durable(found.select("doc_id").distinct())
    whole = whole.join(fitting(affected), "doc_id", "left_semi").select("doc_id", _letters_only("text").alias("letters"))
    parts = items.where(F.col(text).isNotNull()).select(F.col(item_key).alias("item_id"), _letters_only(F.col(text)).alias("wording"))
    begin = F.greatest(F.col("first") - (WINDOW - 1), F.lit(0), -F.col("offset"))
    rows = found.withColumn("begin", begin).withColumn("n", F.col("last") + WINDOW - F.col("begin")).join(parts, "item_id").join(whole, "doc_id")
    rows = rows.withColumn("mine", F.col("wording").substr(F.col("begin") + 1, F.col("n"))).withColumn("theirs", F.col("letters").substr(F.col("begin") + F.col("offset") + 1, F.col("n")))
    rows = rows.select("doc_id", "item_id", "offset", "begin", F.explode(_equal_runs(F.col("mine"), F.col("theirs"), run)).alias("x"))
    return rows.select("doc_id", "item_id", "offset", (F.col("begin") + F.col("x.first")).alias("first"), (F.col("begin") + F.col("x.last")).alias("last")).distinct()


def leaked(documents: DataFrame, items: DataFrame, run: int = 40, index: DataFrame | None = None) -> DataFrame:
    """doc_id and item_id of every document with a run of an item."""
    return shared_runs(documents, items, run, index).select("doc_id", "item_id").distinct()


def proximity(documents: DataFrame, items: DataFrame, piece: int = 20, near: int = 12, whole: int = 40, index: DataFrame | None = None) -> DataFrame:
    """doc_id, item_id and letters of passages kept in pieces: runs of at least `piece`, each at most `near` from the last.

    Runs are parted by steps of the offset first, so that copies of a passage in one document don't break each other's chains,
    then by gaps in the item. Both are done again within the parts, as a run of another part may have bridged a step. A
    letter of the item counts once in a chain.
    """
    runs = shared_runs(documents, items, piece, index)
    parts = ["doc_id", "item_id"]
    for again in ("1", "2"):
        moved = Window.partitionBy(*parts).orderBy("offset")
        step = F.coalesce(F.col("offset") - F.lag("offset").over(moved) > near, F.lit(True))
        runs = runs.withColumn("step", step.cast("int")).withColumn("side" + again, F.sum("step").over(moved))
        order = Window.partitionBy(*parts, "side" + again).orderBy("first", "last", "offset")
        runs = runs.withColumn("reached", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        gap = F.coalesce(F.col("first") - F.col("reached") > near, F.lit(True))
        runs = runs.withColumn("gap", gap.cast("int")).withColumn("chain" + again, F.sum("gap").over(order))
        parts += ["side" + again, "chain" + again]
    new = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, F.coalesce("reached", F.lit(-1))), F.lit(0))
    sums = runs.groupBy(*parts).agg(F.sum(new).cast("int").alias("letters"), F.count("*").alias("pieces"))
    return sums.where(F.col("letters") >= whole).groupBy("doc_id", "item_id").agg(F.max("letters").alias("letters"), F.max("pieces").alias("pieces"))
