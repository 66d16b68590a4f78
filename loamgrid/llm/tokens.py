"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file stays where it is: its path is a parameter.

A block of Arrow text is cut into the tokenizer's words by whole arrays of code points. Words are then encoded once each: the
array of words becomes a dictionary, and only words that no block before had go to the tokenizer.
"""

from __future__ import annotations

import base64
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.llm.canon import PLANES, blocks

#: A vocabulary file of ranks for byte-level pairs. Another path must be one whose texts are cut by PATTERN, too.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how that vocabulary's tokenizer cuts a text before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker remembers; beyond that it forgets them all and starts anew.
REMEMBERED = 300_000
#: Kinds of characters.
OTHER, LETTER, NUMBER, WHITE = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.zeros(PLANES, np.uint8)
    for code in range(0x33480):  # no letter or number stands further on
        out[code] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(code))[0], OTHER)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return out


@lru_cache(maxsize=4)
def tokenizer(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def piece_bytes(path: str = TOKENIZER) -> np.ndarray:
    """Bytes of text that each token stands for; they make up the text again."""
    model = tokenizer(path)
    out = np.zeros(model.max_token_value + 1, np.int32)
    for data in model.token_byte_values():
        out[model.encode_single_token(data)] = len(data)
    return out


class _Words(dict):
    """The sizes of the tokens of words that came before, as bytes of an int32 array."""

    def __init__(self, path: str):
        self.path = path

    def __missing__(self, word: str) -> bytes:
        sizes = piece_bytes(self.path)[tokenizer(self.path).encode_ordinary(word)].tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) < 64:
            self[word] = sizes
        return sizes


_words = lru_cache(maxsize=4)(_Words)


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a word of PATTERN begins at each code point; first says where a text begins."""
    kind = _kinds()[codes]
    white = kind == WHITE
    begins = first.copy()
    # A run of one kind is a word; a space goes with the run behind it, so the last white sign of a run stands by itself.
    begins[1:] |= (kind[1:] != kind[:-1]) & (codes[:-1] != 0x20)
    begins[:-1] |= white[:-1] & ~white[1:] & ~first[1:]
    # An apostrophe that begins a word and one or two letters make up a contraction.
    at = np.flatnonzero((codes == ord("'")) & begins)
    if len(at):
        padded, edge = np.append(codes, [0, 0]), np.append(first, [True, True])
        one = np.where(edge[at + 1], 0, padded[at + 1])
        two = np.where(edge[at + 1] | edge[at + 2], 0, padded[at + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        found = short | long
        begins[at[found] + 1] = False
        ends = at[found] + np.where(short[found], 2, 3)
        begins[ends[ends < len(begins)]] = True
    return begins


@dataclass(frozen=True)
class Tokenized:
    """A block of texts one behind the other. Bytes and tokens are counted from the start of the block."""

    data: bytes
    #: The byte at which each text begins, and the end of all.
    rows: np.ndarray
    #: The byte at which each token begins, and the end of all.
    bounds: np.ndarray
    #: The first token of each text, and the number of all.
    first: np.ndarray
    #: The byte at which each character begins, and whether it is white.
    chars: np.ndarray
    white: np.ndarray


def tokenized(texts: pa.Array, path: str = TOKENIZER) -> Tokenized:
    """The tokens of a block of texts; a null has none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = held[int(offsets[0]) : int(offsets[-1])].to_pybytes() if held is not None else b""
    rows = offsets - offsets[0]
    if not data:
        none = np.zeros(0, np.int64)
        return Tokenized(data, rows, np.zeros(1, np.int64), np.zeros(len(rows), np.int64), none, none.astype(bool))
    chars = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    first = np.zeros(len(codes), bool)
    at = np.searchsorted(chars, rows[:-1])
    first[at[at < len(codes)]] = True
    words = chars[word_starts(codes, first)]
    array = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(np.append(words, len(data)).astype(np.int32).tobytes()), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    sizes = list(map(_words(path).__getitem__, coded.dictionary.to_pylist()))
    many = np.fromiter(map(len, sizes), np.int64, len(sizes)) // 4
    flat, start = np.frombuffer(b"".join(sizes), np.int32), np.cumsum(many) - many
    word = np.asarray(coded.indices)
    count = many[word]
    before = np.cumsum(count) - count
    size = flat[np.repeat(start[word] - before, count) + np.arange(int(count.sum()))]
    bounds = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    return Tokenized(data, rows, bounds, np.searchsorted(bounds, rows), chars, _kinds()[codes] == WHITE)


@lru_cache(maxsize=10_000)
def tokens_in(text: str, path: str = TOKENIZER) -> int:
    """Tokens of one short text."""
    return len(tokenizer(path).encode_ordinary(text))


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; none for a null."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        counts = [np.diff(tokenized(part, path).first) for part in blocks(texts)]
        return pa.array(np.concatenate(counts) if counts else [], pa.int32())

    return count.asNondeterministic()(text)  # so that a filter on it doesn't count a second time
