"""Splitting oversized texts at natural boundaries: agglomerative merging of atomic segments.

A block of texts is tokenized once; every span is then sized by its tokens. Atoms are sentences; one that is too large is cut at clauses,
then at blanks, and only then between two characters. The weakest boundaries between adjacent atoms are merged first (a clause before
a sentence before a line before a paragraph, smaller results first) while the merged size plus the overlap fits. Each piece but the first
begins with the last tokens of the text before it.

A pair that doesn't fit never will, so strengths are taken one after the other. Neighbours at boundaries of one strength that fit all together
become one piece whatever the order; those that don't are held in a heap of adjacent pairs. Only a text's first piece, which has no overlap,
may later take up a neighbour that didn't fit before. Places are told in tokens of the block.

Pieces begin and end between tokens of the whole text, so by themselves they have those very tokens: pairs that were merged inside a
piece don't depend on what stands outside, and the tokenizer cuts a text without looking back. Only white space at
the end of a piece, which the tokenizer parts by what follows, is tokenized again to count exactly.

Defined results: null and empty texts give no piece; a text within the limit is one piece; pieces without their overlaps make the
text again; an overlap is never larger than the piece before and begins between two characters, so it may have up to three
tokens more; an overlap that leaves no room is cut down to half of the limit; a single character of more tokens than the limit
stays whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.canon import blocks
from loamgrid.llm.tokens import TOKENIZER, Tokenized, tokenized, tokens_in
from loamgrid.session import small

#: Strength of boundaries; nothing is merged over the end of a text.
HARD, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH, EDGE = range(7)
_CLOSING = (b"\xe2\x80\x9d", b"\xef\xbc\x89", b'"', b")")
#: Kinds of signs: a line end, an end of a sentence, a full stop that counts before a blank, a comma.
_LINE, _END, _STOP, _COMMA, _LEAD = range(1, 6)
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"\n")], _KIND[list(b"!?")], _KIND[list(b".")], _KIND[list(b",;:|")], _KIND[[0xE3, 0xEF]] = _LINE, _END, _STOP, _COMMA, _LEAD
#: Kinds by the last two bytes of a sign that begins with E3 or EF.
_WIDE = np.zeros((2, 1 << 16), np.uint8)
for _chars, _kind in (("。！？", _END), ("，；、：", _COMMA)):
    for _char in _chars:
        _a, _b, _c = _char.encode()
        _WIDE[int(_a == 0xEF), _b << 8 | _c] = _kind


def boundaries(data: bytes, raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes behind sentences, the strength of each boundary, and bytes behind commas and the like. edge says where texts begin and end.

    Signs of an end that follow each other at once are one boundary, behind the last: a line if there is a line end, a paragraph if
    there are several. Closing quotes and brackets go with the sentence. An English full stop counts before a blank.
    """
    n = len(raw)
    at = np.flatnonzero(_KIND[raw])
    kind = _KIND[raw[at]]
    lead = np.flatnonzero(kind == _LEAD)
    place = at[lead]
    low, high = raw[np.minimum(place + 2, n - 1)], raw[np.minimum(place + 1, n - 1)].astype(np.int64)
    kind[lead] = _WIDE[(raw[place] == 0xEF).view(np.uint8), high << 8 | low]
    width = np.ones(len(at), np.int64)
    width[lead] = 3
    stop = np.flatnonzero(kind == _STOP)
    behind = raw[np.minimum(at[stop] + 1, n - 1)]
    kind[stop] = np.where(~edge[at[stop] + 1] & ((behind == 32) | (behind == 10)), _END, 0)
    at += width
    commas = at[kind == _COMMA]
    ends = (kind == _END) | (kind == _LINE)
    at, width, lines = at[ends], width[ends], (kind[ends] == _LINE).astype(np.int64)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] - width[1:] != at[:-1]) | edge[at[:-1]]
        begins = np.flatnonzero(new)
        lines = np.add.reduceat(lines, begins)
        at = at[np.append(begins[1:] - 1, len(at) - 1)]
        follows = raw[np.minimum(at, n - 1)]
        quoted = (follows == 0x22) | (follows == 0x29) | (follows == 0xE2) | (follows == 0xEF)
        for k in np.flatnonzero((lines == 0) & ~edge[at] & quoted).tolist():
            end = int(at[k])
            while not edge[end] and (sign := next((c for c in _CLOSING if data.startswith(c, end)), None)):
                end += len(sign)
            at[k] = min(end, int(at[k + 1])) if k + 1 < len(at) else end
    return at, np.minimum(lines, 2) + SENTENCE, commas


class Places:
    """Where a block of texts may be cut, counted in tokens from the start of the block."""

    def __init__(self, block: Tokenized):
        self.block = block
        data, bounds, n = block.data, block.bounds, len(block.data)
        raw = np.frombuffer(data, np.uint8)
        edge = np.zeros(n + 1, bool)
        edge[block.rows] = True
        #: Ends of tokens that are ends of characters, and the last and the next such place of each place.
        valid = np.ones(len(bounds), bool)
        valid[:-1] = raw[bounds[:-1]] & 0xC0 != 0x80
        every = np.arange(len(bounds))
        self.back = np.maximum.accumulate(np.where(valid, every, 0))
        self.forth = np.minimum.accumulate(np.where(valid, every, len(bounds) - 1)[::-1])[::-1]
        at, strength, commas = boundaries(data, raw, edge)
        texts = np.unique(block.first[1:])
        texts = texts[texts > 0]
        at = np.append(self.of(at), texts)
        strength = np.append(strength, np.full(len(texts), EDGE))
        # Of boundaries that fall together the last counts, and the end of a text is last.
        order = np.argsort(at, kind="stable")
        at, strength = at[order], strength[order]
        keep = np.append(at[1:] > at[:-1], True)
        self.sentences, self.strengths = at[keep], strength[keep]
        self.clauses = np.unique(self.of(commas))
        blank = (raw == 32) | (raw == 9)
        runs = np.flatnonzero(blank & ~np.append(blank[1:], False)) + 1
        wide = np.flatnonzero(raw[:-2] == 0xE3) if n > 2 else np.zeros(0, np.int64)
        wide = wide[(raw[wide + 1] == 0x80) & (raw[wide + 2] == 0x80)] + 3
        wide = wide[np.append(wide[1:] - 3 != wide[:-1], True)] if len(wide) else wide
        self.blanks = np.unique(self.of(np.append(runs, wide)))

    def of(self, at: np.ndarray) -> np.ndarray:
        """The first place at or behind each byte."""
        return self.forth[np.searchsorted(self.block.bounds, at)]

    def hard(self, a: int, b: int, most: int) -> Iterator[int]:
        """Places that cut a span of tokens into parts of at most so many."""
        while b - a > most:
            place = int(self.back[a + most])
            if place <= a:
                place = int(self.forth[a + 1])  # a single character of more tokens than the limit stays whole
            if place >= b:
                return
            yield place
            a = place

    def atoms(self, most: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and strengths of atoms of at most so many tokens; texts that begin in `whole` tokens are one atom."""
        ends, strengths = self.sentences, self.strengths
        inside = whole[ends - 1] & (strengths != EDGE)
        ends, strengths = ends[~inside], strengths[~inside]
        for finer, kind in ((self.clauses, CLAUSE), (self.blanks, BLANK), (None, HARD)):
            size = np.diff(ends, prepend=0)
            large = (size > most) & ~whole[ends - 1]
            if not large.any():
                break
            if finer is None:
                finer = np.array([p for k in np.flatnonzero(large).tolist() for p in self.hard(int(ends[k] - size[k]), int(ends[k]), most)], np.int64)
            else:
                owner = np.searchsorted(ends, finer)
                finer = finer[(owner < len(ends)) & large[np.minimum(owner, len(ends) - 1)]]
                finer = finer[ends[np.searchsorted(ends, finer)] != finer]
            at = np.searchsorted(ends, finer)
            ends, strengths = np.insert(ends, at, finer), np.insert(strengths, at, kind)
        return ends, strengths


def _by_heap(low: list[int], high: list[int], joined: list[bool], limit: list[int]) -> list[bool]:
    """Which pieces' ends stay. Adjacent pairs at joined boundaries are held in a heap; the smallest result that fits is merged first."""
    n = len(low)
    left, right, alive, stays = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n, [True] * n
    last = list(range(n))
    # A pair is one number: merged size, then place of its left piece. A number that no longer agrees is one of a pair that has changed.
    heap = [(high[i + 1] - low[i]) << 32 | i for i in range(n - 1) if joined[i] and high[i + 1] - low[i] <= limit[i]]
    heapq.heapify(heap)
    pop, push, bits = heapq.heappop, heapq.heappush, (1 << 32) - 1
    while heap:
        key = pop(heap)
        i = key & bits
        j = right[i]
        if not alive[i] or j >= n or not joined[i] or high[j] - low[i] != key >> 32:
            continue
        stays[last[i]], alive[j] = False, False
        last[i], high[i], joined[i] = last[j], high[j], joined[j]
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if joined[i]:
                size = high[k] - low[i]
                if size <= limit[i]:
                    push(heap, size << 32 | i)
        h = left[i]
        if h >= 0 and joined[h]:
            size = high[i] - low[h]
            if size <= limit[h]:
                push(heap, size << 32 | h)
    return stays


def merged(ends: np.ndarray, strengths: np.ndarray, heads: np.ndarray, first: int, rest: int) -> np.ndarray:
    """Ends of pieces: neighbours merged from the weakest boundary on, up to `first` tokens where a text begins, else `rest`."""
    low = np.concatenate(([0], ends[:-1]))
    for level in range(HARD, EDGE):
        joined = strengths == level
        if not joined.any():
            continue
        begins = np.ones(len(ends), bool)
        begins[1:] = ~joined[:-1]
        at = np.flatnonzero(begins)
        stop = np.append(at[1:], len(ends)) - 1
        limit = np.where(heads, first, rest)
        fits = (ends[stop] - low[at] <= limit[at])[np.cumsum(begins) - 1]
        stays = ~(joined & fits)
        some = np.flatnonzero(~fits & (joined | np.append(False, joined[:-1])))
        if len(some):
            stays[some] = _by_heap(low[some].tolist(), ends[some].tolist(), joined[some].tolist(), limit[some].tolist())
        while True:
            kept = np.flatnonzero(stays)
            begin = np.concatenate(([0], kept[:-1] + 1))
            low, heads, ends, strengths = low[begin], heads[begin], ends[kept], strengths[kept]
            stays = np.append(~(heads[:-1] & (strengths[:-1] <= level) & (ends[1:] - low[:-1] <= first)), True)
            if stays.all():
                break
    return ends


def cut(places: Places, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number in its text, first token with the overlap and without it, and end of each piece of all texts of a block."""
    first = places.block.first
    overlap = min(overlap, limit // 2)
    rest, most = max(limit - overlap - (3 if overlap else 0), 1), max(limit, 1)
    sizes = np.diff(first)
    ends, strengths = places.atoms(rest, np.repeat(sizes <= limit, sizes))
    heads = np.append(True, strengths[:-1] == EDGE)
    stops = merged(ends, strengths, heads, most, rest)
    starts = np.concatenate(([0], stops[:-1]))
    row = np.searchsorted(first, starts, "right") - 1
    head = starts == first[row]
    number = np.arange(len(row)) - np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
    if not overlap:
        return row, number, starts, starts, stops
    # The overlap begins so many tokens before, at a place, and not before the piece before it.
    backs = np.where(head, starts, places.back[np.maximum(starts - overlap, first[row])])
    return row, number, np.maximum.accumulate(backs), starts, stops


def block_pieces(block: Tokenized, profiles: list[tuple[str, int, int]], path: str = TOKENIZER) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """For each profile its name and text, number, bytes of overlap, tokens and UTF-8 of all pieces of a block."""
    if not block.data:
        return
    places, data, bounds = Places(block), block.data, block.bounds
    for name, limit, overlap in profiles:
        row, number, backs, starts, stops = cut(places, limit, overlap)
        a, b = bounds[backs], bounds[stops]
        parts = [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        sizes = stops - backs
        # A single blank at the end is the token that it was; only a run of them is tokenized again.
        behind = np.searchsorted(block.chars, b)
        run = block.white[behind - 1] & block.white[np.maximum(behind - 2, 0)] & (b < block.rows[row + 1])
        for k in np.flatnonzero(run).tolist():
            begin = end = int(behind[k])
            while begin and block.white[begin - 1] and block.chars[begin - 1] >= a[k]:
                begin -= 1
            if end - begin > 1:
                byte = int(block.chars[begin])
                sizes[k] += tokens_in(data[byte : int(b[k])].decode(), path) - (int(stops[k]) - int(np.searchsorted(bounds, byte, "right") - 1))
        yield name, row, number, bounds[starts] - a, sizes, parts


def pieces_of(texts: list[str], profiles: list[tuple[str, int, int]], path: str = TOKENIZER) -> list[tuple[int, str, int, int, int, str]]:
    """Row, profile, number, bytes of overlap, tokens and text of each piece."""
    block = tokenized(pa.array(texts, pa.string()), path)
    out = [(r, name, k, lap, n, p.decode()) for name, *columns, parts in block_pieces(block, profiles, path) for r, k, lap, n, p in zip(*(c.tolist() for c in columns), parts, strict=True)]
    return sorted(out, key=lambda x: x[0])


def split_texts(df: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """key, profile, piece_no, overlap_bytes, n_tokens and text of all pieces of all texts for each profile of limits."""
    profiles = [(r.profile, r.max_tokens, r.overlap_tokens or 0) for r in small(limits.select("profile", "max_tokens", "overlap_tokens"), 1000, "limits") if r.max_tokens and r.max_tokens > 0]
    names = ["key", "profile", "piece_no", "overlap_bytes", "n_tokens", "text"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, at = part.column(0), 0
            for texts in blocks(part.column(1)):  # few texts at a time bound the memory
                own = ids.slice(at, len(texts))
                at += len(texts)
                for name, row, number, lap, size, found in block_pieces(tokenized(texts, path), profiles, path):
                    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))).astype(np.int32)
                    pieces = pa.Array.from_buffers(pa.string(), len(found), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(found))])
                    numbers = [pa.array(x.astype(np.int32)) for x in (number, lap, size)]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(row)), pa.repeat(name, len(found)), *numbers, pieces], names=names)

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(batches, "key bigint, profile string, piece_no int, overlap_bytes int, n_tokens int, text string")
    return out.withColumnRenamed("key", key)
