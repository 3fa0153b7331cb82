"""Byte-level BPE over Spark tables: ``encode`` and ``decode``.

The merge loop is the contiguous rank array: a short word is a list of parts with the rank of
each adjacent pair beside it; the smallest rank is found by scanning, its right part deleted and
the one or two neighbouring ranks refreshed. Scanning is quadratic in the parts, so words beyond
``LONG_WORD`` bytes take the same merges from a heap over a linked list.

Edge cases: a null text encodes as the empty text (no ids); a null id array decodes to the empty
text; ids outside the vocabulary decode to nothing, broken UTF-8 to U+FFFD. Rows are never
dropped or joined, so repeated ids and extra columns pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG_WORD = 256
CACHED_WORDS = 400_000
CACHED_LENGTH = 48
NO_RANK = 1 << 62

# Letters (L) and numbers (N) of Unicode 16.0 that the interpreter's own table
# (15.1) does not have yet; the public tokenizer classifies by 16.0.
NEWER = [
    (0x1C89, 0x1C8A, "L"), (0xA7CB, 0xA7CD, "L"), (0xA7DA, 0xA7DC, "L"), (0x105C0, 0x105F3, "L"),
    (0x10D40, 0x10D49, "N"), (0x10D4A, 0x10D65, "L"), (0x10D6F, 0x10D85, "L"), (0x10EC2, 0x10EC4, "L"),
    (0x11380, 0x11389, "L"), (0x1138B, 0x1138B, "L"), (0x1138E, 0x1138E, "L"), (0x11390, 0x113B5, "L"),
    (0x113B7, 0x113B7, "L"), (0x113D1, 0x113D1, "L"), (0x113D3, 0x113D3, "L"), (0x116D0, 0x116E3, "N"),
    (0x11BC0, 0x11BE0, "L"), (0x11BF0, 0x11BF9, "N"), (0x13460, 0x143FA, "L"), (0x16100, 0x1611D, "L"),
    (0x16130, 0x16139, "N"), (0x16D40, 0x16D6C, "L"), (0x16D70, 0x16D79, "N"), (0x18CFF, 0x18CFF, "L"),
    (0x1CCF0, 0x1CCF9, "N"), (0x1E5D0, 0x1E5ED, "L"), (0x1E5F0, 0x1E5F0, "L"), (0x1E5F1, 0x1E5FA, "N"),
]
# White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=8)
def _ranges(kind: str, end: int) -> str:
    """Character-class body of all code points below ``end`` with a general category's first letter."""
    out, start = [], None
    newer = {c for a, b, k in NEWER if k == kind for c in range(a, b + 1)}
    for c in range(end + 1):
        inside = c < end and (unicodedata.category(chr(c))[0] == kind or c in newer)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=8)
def word_pattern(end: int) -> re.Pattern:
    """Splits a text of code points below ``end`` into the pieces that merges never cross."""
    letter, number = _ranges("L", end), _ranges("N", end)
    return re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


_BEYOND_LATIN, _BEYOND_BMP = re.compile("[^\\0-\u024f]"), re.compile("[^\\0-\uffff]")


def split_words(text: str) -> list[str]:
    """The pieces of a text; small character classes are faster, so the smallest that suffices is used."""
    end = 0x250 if _BEYOND_LATIN.search(text) is None else 0x10000 if _BEYOND_BMP.search(text) is None else 0x110000
    return word_pattern(end).findall(text)


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself, or one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file; memoises words up to a bound."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.byte_id = [ids[alphabet[b]] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        self.result = [merged for _, merged in self.merges.values()]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.rank = {pair: rank for pair, (rank, _) in self.merges.items()}.get
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.words = _Words(self)

    def merge(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        return self._merge_long(parts) if len(parts) > LONG_WORD else self._merge_short(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        rank, result = self.rank, self.result
        ranks = [rank(parts[i] << 32 | parts[i + 1], NO_RANK) for i in range(len(parts) - 1)]
        while ranks and (best := min(ranks)) != NO_RANK:
            i = ranks.index(best)
            parts[i] = result[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (r := rank(parts[i] << 32 | parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))

        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = self.result[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text are ids too."""
        out: list[bytes] = []
        pieces = self.special_pattern.split(text) if self.special_pattern else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(struct.pack("<I", self.special[piece]))
            elif piece:
                out.extend(map(self.words.__getitem__, split_words(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        n = len(self.token_bytes)
        token = self.token_bytes
        values = memoryview(ids).cast("I")
        try:
            return b"".join(map(token.__getitem__, values)).decode("utf-8", "replace")
        except IndexError:
            return b"".join(token[i] for i in values if i < n).decode("utf-8", "replace")


class _Words(dict):
    """Word to packed ids; cleared when full, so a worker's memory stays bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = self.vocabulary.merge(word.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = packed
        return packed


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _map_column(df: DataFrame, source: str, target: str, kind: T.DataType, arrow: pa.DataType, function) -> DataFrame:
    """Replace ``source`` by ``target`` = function(source), batch by batch, other columns untouched."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in (source, target)] + [T.StructField(target, kind)])

    def run(batches):
        apply = function()
        for batch in batches:
            keep = [n for n in batch.schema.names if n not in (source, target)]
            values = [apply(v) for v in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(values, arrow)], names=[*keep, target])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Column ``text`` becomes ``ids``, a binary of little-endian unsigned 32-bit token ids."""
    return _map_column(df, text, ids, T.BinaryType(), pa.binary(), lambda: lambda v, e=vocabulary(tokenizer).encode: e(v or ""))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Column ``ids`` becomes ``text``."""
    return _map_column(df, ids, text, T.StringType(), pa.string(), lambda: lambda v, d=vocabulary(tokenizer).decode: d(v or b""))
