"""Benchmark decontamination with spaced seeds: masks that ignore some word positions propose places, substitution-tolerant overlaps confirm them.

A window of words is hashed at the positions that a mask keeps, so that words replaced elsewhere don't matter.  A seed that a
document shares with a benchmark item fixes an alignment; along it, every segment with enough equal words and a large enough share of
them is an overlap, and the longest one that begins and ends with an equal word is reported.  The benchmark is worked through in blocks of bounded size, each
of which goes to the tasks whole; documents are not shuffled.

Null and empty texts have no overlaps, on either side; an item of fewer than five words is never looked for, one of five to
eight words only as a whole.  Of equally good overlaps with an item the one of the earliest alignment counts.  In texts that repeat words very often every
alignment is looked at, which takes time in proportion to their lengths' product, but memory only in proportion to their sum.  Repeated rows give repeated results, repeated items one result each.  Nulls in other columns are carried along.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangrove.llm.tokens import mixed, picked, word_batches, word_count

MASKS = ("110110101", "101011011", "111001011")
SPAN = 9
LEAST_WORDS = 12        # equal words of an overlap; all but a fifth of the words of a shorter item
LEAST_SHARE = 0.75      # equal words among those of the overlap
SHORTEST = 5
BLOCK_WORDS = 400_000   # of benchmark text that goes to the tasks at a time
FILTER_BITS = 21
HITS = 1 << 20          # hits of seeds that are held at a time


class Seeds(NamedTuple):
    """Word hashes of the items of a block, and sorted seed hashes with the item and position of each."""

    ids: list
    first: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    lengths: list[int]
    maybe: np.ndarray


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of words, at the positions that the mask keeps."""
    n = max(0, len(words) - len(mask) + 1)
    h = np.full(n, int("1" + mask, 2), np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            h = mixed(h * np.uint64(0x9FB21C651E98DF25) + words[k:k + n])
    return h


def seeds_of(items: pa.Table) -> Seeds:
    column = items.column("text").combine_chunks()
    parts, sizes = [], []
    for _, _, words in word_batches(column):
        parts.append(words.hashes)
        sizes.append(np.diff(words.first))
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    first = np.append(0, np.cumsum(np.concatenate(sizes) if sizes else [])).astype(np.int64)
    found, lengths = [], set()
    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
        masks = MASKS if hi - lo >= SPAN else ("1" * int(hi - lo),) if hi - lo >= SHORTEST else ()
        lengths |= {int(hi - lo)} if len(masks) == 1 else set()
        for mask in masks:
            h = seed_hashes(words[lo:hi], mask)
            found.append((h, np.full(len(h), i), np.arange(len(h))))
    h, item, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
    order = np.argsort(h, kind="stable")
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Seeds(items.column("item_id").to_pylist(), first, words, h[order], item[order].astype(np.int64), at[order].astype(np.int64), sorted(lengths), maybe)


def overlap(equal: np.ndarray, least: int) -> tuple[int, int]:
    """The longest segment that begins and ends with an equal word, has ``least`` of them and the least share: its start and end, or (0, 0)."""
    at = np.flatnonzero(equal)
    if len(at) < max(1, least):
        return 0, 0
    # With +1 for an equal word and -3 for another: the share is large enough if the sum is 0 or more.
    below = LEAST_SHARE / (1 - LEAST_SHARE)
    total = np.append(0, np.cumsum(np.where(equal, 1, -below)))
    low = np.minimum.accumulate(total[at])
    # The first start that a sum allows; if too few equal words follow it, a later start has fewer.
    first = np.searchsorted(-low, -total[at + 1], "left")
    sizes = np.where(np.arange(len(at)) - first + 1 >= max(1, least), at + 1 - at[np.minimum(first, len(at) - 1)], 0)
    end = int(sizes.argmax())
    return (int(at[first[end]]), int(at[end]) + 1) if sizes[end] else (0, 0)


def overlaps(doc: np.ndarray, seeds: Seeds) -> list[tuple[int, int, int, int]]:
    """(item, start in the document, words, equal words): the best overlap of a document with each item that it shares one with."""
    lines = np.zeros(0, np.int64)   # item and shift of each alignment, as one number
    span = len(doc) + len(seeds.words) + 1
    for mask in (*MASKS, *("1" * n for n in seeds.lengths)):
        h = seed_hashes(doc, mask)
        spot = np.flatnonzero(seeds.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(seeds.hashes, h[spot], "left"), np.searchsorted(seeds.hashes, h[spot], "right")
        # Repeated words give many hits of one alignment: they are united in slices, so that only alignments are held.
        total, at = np.cumsum(hi - lo), 0
        while at < len(spot):
            to = max(at + 1, int(np.searchsorted(total, total[at] - (hi - lo)[at] + HITS, "right")))
            many = (hi - lo)[at:to]
            owner = np.repeat(np.arange(at, to), many)
            entry = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + lo[owner]
            lines = np.union1d(lines, seeds.item[entry] * (2 * span) + spot[owner] - seeds.at[entry] + span)
            at = to
    best: dict[int, tuple[int, int, int, int]] = {}
    for item, shift in zip((lines // (2 * span)).tolist(), (lines % (2 * span) - span).tolist(), strict=True):
        text = seeds.words[seeds.first[item]:seeds.first[item + 1]]
        lo, hi = max(0, -shift), min(len(text), len(doc) - shift)
        equal = doc[lo + shift:hi + shift] == text[lo:hi]
        a, b = overlap(equal, int(np.ceil(min(LEAST_WORDS, 0.8 * len(text)))))
        same = int(equal[a:b].sum())
        if b > a and (item not in best or same > best[item][3]):
            best[item] = (item, lo + a + shift, b - a, same)
    return list(best.values())


def _has_seed(hashes: np.ndarray, seeds: Seeds) -> np.ndarray:
    """Words at which a window may begin that the block knows; windows may reach into the next text here."""
    out = np.zeros(len(hashes), bool)
    for mask in (*MASKS, *("1" * n for n in seeds.lengths)):
        h = seed_hashes(hashes, mask)
        out[:len(h)] |= seeds.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The seeds of the benchmark, a bounded number of words at a time."""
    items = picked(benchmark, item_id=item_id, text=text)
    total = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    n = -(-int(total) // BLOCK_WORDS)
    for k in range(n):
        yield seeds_of(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow())


def _found(column: pa.Array, seeds: Seeds):
    """For each row its overlaps."""
    for _, _, words in word_batches(column):
        maybe = np.append(0, np.cumsum(_has_seed(words.hashes, seeds)))
        for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
            yield overlaps(words.hashes[lo:hi], seeds) if maybe[hi] > maybe[lo] else []


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, first_word, n_words, n_equal of the best overlap."""
    source = picked(docs, id=doc_id, text=text).select(F.col("id").cast("long"), "text")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, first_word long, n_words long, n_equal long"
    item_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def search(seeds: Seeds):
        def run(batches):
            for batch in batches:
                ids = batch.column("id").to_pylist()
                rows = [(i, seeds.ids[h[0]], *h[1:]) for i, hits in zip(ids, _found(batch.column("text"), seeds), strict=True) for h in hits]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), item_type, *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "n_equal"])
        return run

    out = None
    for seeds in blocks(benchmark):
        part = source.mapInArrow(search(seeds), schema)
        out = part if out is None else out.union(part)
    return source.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, unchanged."""
    def keep(seeds: Seeds):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in _found(batch.column(text), seeds)], pa.bool_()))
        return run

    for seeds in blocks(benchmark):
        docs = docs.mapInArrow(keep(seeds), docs.schema)
    return docs
