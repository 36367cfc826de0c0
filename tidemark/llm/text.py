"""Array helpers on the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Bytes of a word, lower-cased; 0 elsewhere: digits, letters and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, np.uint8)
for _b in range(256):
    _c = _b + 32 if 0x41 <= _b <= 0x5A else _b
    if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80:
        WORD_BYTES[_b] = _c
#: The same for bytes.translate: separators become spaces.
WORD_TABLE = bytes(int(x) or 0x20 for x in WORD_BYTES)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: Column that holds the numbers of stored rows; no table of documents may have one of this name.
PLACE = "__tidemark_row"


def rows(docs: DataFrame, *columns: str, key: str = "doc_id") -> DataFrame:
    """The named columns and uid, a number of the row: the stored one of `numbered` rows; else one that holds for a single scan only, as it depends on how the scan is split."""
    uid = F.col(PLACE) if PLACE in docs.columns else F.monotonically_increasing_id()
    return docs.select(uid.alias("uid"), F.col(key).cast("bigint").alias("doc_id"), *[F.col(c) for c in columns])


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with their numbers, stored in the shared folder, so that all scans agree on them."""
    if PLACE in docs.columns:
        return docs
    return scratch.table(docs.withColumn(PLACE, F.monotonically_increasing_id()), "numbered")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; null where the key is null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and where each row starts (and the last ends). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = 1 << 20):
    """utf8() of runs of rows that hold about `most` bytes: (first row, end row, bytes, offsets)."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def segment(data: np.ndarray, at: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows: (mapped bytes, starts, ends, number of words before each row). No word crosses a row's end."""
    mapped = table[data]
    n = len(mapped)
    if not n:
        none = np.zeros(0, np.int64)
        return mapped, none, none, np.zeros(len(at), np.int64)
    inside = mapped != 0
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_or(~inside[:-1], cut[1:n], out=before[1:])
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_or(~inside[1:], cut[1:n], out=after[:-1])
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return mapped, starts, ends, np.searchsorted(starts, at)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: differences of prefix sums of byte * base**position."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        size = max(most, 1 << (b - a).bit_length())
        up, down = _powers(size)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(mapped[a:b].astype(np.uint64) * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each slice values[at[i]:at[i+1]]; 0 for an empty one."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
