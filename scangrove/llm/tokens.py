"""Words of whole texts as arrays: a batch of texts at a time, without a Python object per word.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, found on the UTF-8 bytes.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Words(NamedTuple):
    """The words of some texts, in order: byte ranges in ``data``, text number, 64-bit hash; ``first[i]:first[i+1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Ranges:
    """Hashes of ranges of values, by one cumulative polynomial over all values."""

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        up, self._down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = self._down[0] = 1
        up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(self._down)
        self._total = np.zeros(n, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._total[ends] - self._total[starts]) * self._down[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Ranges(values).hashes(starts, ends)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``limit`` bytes each; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts whose bytes are ``data[offsets[i]:offsets[i+1]]``."""
    lower, space = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    space[[9, 10, 11, 12, 13, 32]] = True
    data, offsets = lower[data[offsets[0]:offsets[-1]]], offsets - offsets[0]
    inside = ~space[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    after[edges[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets[1:], starts, "right")
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(text, minlength=len(offsets) - 1), out=first[1:])
    return Words(data, starts, ends, text, first, range_hashes(data, starts, ends))


def word_batches(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The words of a column, some texts at a time: the range of rows and their words."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, hi, words_of(data, offsets[lo:hi + 1])


def ragged(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array a row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else [], kind))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def remainder(column: Column | str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; -1 for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % divisor, F.lit(-1)).cast("int")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def one_row_an_id(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row for each id, that whose text has the smallest hash.

    Spark takes this limit inside each task before rows are moved, so an id that very many rows share comes to one row a task.
    """
    rest = [c for c in rows.columns if c not in (key, text)]
    order = Window.partitionBy(key).orderBy(F.xxhash64(text), *rest)
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns can't clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
