"""Ranked lexical search: the best documents for each item of a query set, by exact scores.

Terms are runs of ASCII letters and digits and of all other characters, with A-Z lower-cased.  ``N`` documents have a term, they have ``L``
terms in all; a document has ``n`` terms, a term ``tf`` of these; ``df`` documents hold it.  A term's weight is
``floor(1000 ln((2N+2)/(2df+1)))``, its impact in a document ``(10^9 tf) div (1000 tf + 8 m)`` with ``m = 25 + (75 n N) div L``, and a score
sums weight times impact over an item's terms, repeats included.  All of it is exact in integers.

1. One scan counts N, L and the df of the items' terms.
2. In a second scan each document's impacts are folded into a max-sketch: coordinate ``hash(term) mod width`` holds the largest impact of the
   terms that fall on it, and the width grows with the document's own terms.  For a block of documents all terms of all items are looked up at
   once; weight times coordinate, summed over an item's terms, can't be less than the score.
3. For each item the block's documents are taken by descending bound and scored exactly, until a bound is below the item's ``k``-th
   best score so far.  Each task hands on at most ``k`` rows an item, of which the best are chosen.

Items meet the documents in blocks of at most ``BLOCK`` terms, each with its own pair of scans; this bounds what is broadcast.

Nulls and odd rows: null and empty texts have no terms and are never found.  Rows of documents are taken as they are: equal rows are counted and
found as often as they occur.  Rows of one item id are one item with the terms of all its different texts; a null id is an id.  Equal scores
go by ascending doc_id, null last.  Texts of any length are taken whole.  If there are no items or no documents, there are no rows.
Other columns are left aside, whatever their names.  Terms are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scangrove.llm.tokens import Words, picked, signed, slices, text_buffers, words_of
from scangrove.operators.ordering import first_n_per_group
from scangrove.session import stored

#: Terms of items, repeats in an item not counted, that one pair of scans takes.
BLOCK = 1 << 20
#: Coordinates of a sketch for each distinct term of its document, and the least width.
ROOM, LEAST_WIDTH = 4, 64
#: Numbers in a table of documents by terms.
TABLE = 1 << 21
#: Documents scored exactly between two looks at the bounds.
STEP = 16

#: Bytes that are no part of a term, as blanks.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32


def term_batches(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The terms of a column of texts, some texts at a time."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, hi, words_of(_BYTES[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo])


class Occurrences(NamedTuple):
    """The distinct terms of some texts: text number, hash (ascending in a text) and how often; ``first[i]:first[i+1]`` are those of text i."""

    text: np.ndarray
    hashes: np.ndarray
    tf: np.ndarray
    first: np.ndarray


def occurrences(words: Words) -> Occurrences:
    order = np.lexsort((words.hashes, words.text))
    text, hashes = words.text[order], words.hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])])) if len(text) else np.zeros(0, np.int64)
    tf = np.diff(np.append(starts, len(text)))
    return Occurrences(text[starts], hashes[starts], tf, np.searchsorted(text[starts], np.arange(len(words.first))))


class Items(NamedTuple):
    """A block of items: their distinct terms (ascending hashes), and for each item the terms it has and how often."""

    ids: pa.Array
    terms: np.ndarray
    entry_term: np.ndarray
    entry_count: np.ndarray
    first: np.ndarray


class Counts(NamedTuple):
    documents: int
    terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.floor(1000.0 * np.log((2.0 * self.documents + 2.0) / (2.0 * self.df + 1.0))).astype(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in term_batches(batch.column("text")):
            found = occurrences(words)
            ids = batch.column("item_id").take(pa.array(found.text + lo))
            yield pa.RecordBatch.from_arrays([ids, pa.array(signed(found.hashes)), pa.array(found.tf)], ["item_id", "term", "n"])


def item_blocks(items: DataFrame, block: int) -> Iterator[Items]:
    """The items with their terms, in blocks of about ``block`` terms."""
    kind = items.schema["item_id"].dataType.simpleString()
    entries = stored(items.distinct().mapInArrow(_item_terms, f"item_id {kind}, term bigint, n bigint")
                     .groupBy("item_id", "term").agg(F.sum("n").alias("n")), "item-terms")
    blocks = -(-entries.count() // block)
    for b in range(blocks):
        rows = entries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        hashes = rows.column("term").to_numpy().view(np.uint64)
        item = ids.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((hashes, item))
        terms, term = np.unique(hashes[order], return_inverse=True)
        yield Items(ids.dictionary, terms, term, rows.column("n").to_numpy()[order], np.searchsorted(item[order], np.arange(len(ids.dictionary))))


def _places(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes are among the terms, and whether they are."""
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return at, terms[at] == hashes


def _count(shared: Broadcast):
    """term, df for the terms of the items; with no term: documents that have terms, and the number of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        df, documents, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, _, words in term_batches(batch.column("text")):
                found = occurrences(words)
                documents += int(np.count_nonzero(np.diff(words.first)))
                total += len(words.hashes)
                at, hit = _places(terms, found.hashes)
                df += np.bincount(at[hit], minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *some.tolist()], pa.int32()), pa.array([documents, *df[some].tolist()], pa.int64()), pa.array([total, *[0] * len(some)], pa.int64())],
            ["term", "df", "terms"])
    return run


def count_terms(docs: DataFrame, shared: Broadcast) -> Counts:
    rows = docs.select("text").mapInArrow(_count(shared), "term int, df bigint, terms bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms"))
    df, documents, total = np.zeros(len(shared.value.terms), np.int64), 0, 0
    for term, n, terms in zip(*(c.to_pylist() for c in rows.toArrow().columns)):
        if term is None:
            documents, total = n, terms
        else:
            df[term] = n
    return Counts(documents, total, df)


def impacts(found: Occurrences, counts: Counts) -> np.ndarray:
    lengths = np.add.reduceat(np.append(found.tf, 0), found.first[:-1]) * (np.diff(found.first) > 0) if len(found.first) > 1 else np.zeros(0, np.int64)
    m = np.array([25 + 75 * int(n) * counts.documents // counts.terms for n in lengths], np.int64)
    return 1_000_000_000 * found.tf // (1000 * found.tf + 8 * m[found.text])


class Sketches:
    """The max-sketches of some documents, one after another in one array."""

    def __init__(self, found: Occurrences, impact: np.ndarray):
        distinct = np.diff(found.first)
        self.mask = np.maximum(LEAST_WIDTH, 1 << np.ceil(np.log2(np.maximum(1, ROOM * distinct))).astype(np.int64)).astype(np.uint64) - np.uint64(1)
        ends = np.cumsum(self.mask + np.uint64(1))
        self.base = np.concatenate([[np.uint64(0)], ends[:-1]]).astype(np.uint64)
        self.values = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        np.maximum.at(self.values, self.base[found.text] + (found.hashes & self.mask[found.text]), impact.astype(np.int32))

    def look_up(self, documents: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """What each document's sketch holds for each term: no less than the term's impact."""
        return self.values[self.base[documents][:, None] + (terms[None, :] & self.mask[documents][:, None])]


def exact_scores(found: Occurrences, impact: np.ndarray, documents: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The scores of some documents for one item, from their own terms."""
    out = np.zeros(len(documents), np.int64)
    for i, d in enumerate(documents):
        lo, hi = found.first[d], found.first[d + 1]
        if hi > lo:
            at, hit = _places(found.hashes[lo:hi], terms)
            out[i] = (weights[hit] * impact[lo + at[hit]]).sum()
    return out


class Best:
    """The ``k`` best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """Documents with a lower score can't get in; one with this score may, by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        use = scores >= self.threshold
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores[use]), (self.ids, ids[use]), (self.null, null[use])))
        order = np.lexsort((ids, null, -scores))[:self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def _rank(shared: Broadcast, counts: Counts, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        weights = counts.weights()[items.entry_term] * items.entry_count
        ends = np.append(items.first[1:], len(items.entry_term))
        best = [Best(k) for _ in items.ids]
        for batch in batches:
            ids = batch.column("doc_id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy().astype(np.int64)
            for lo, hi, words in term_batches(batch.column("text")):
                found = occurrences(words)
                if not len(found.text):
                    continue
                impact = impacts(found, counts)
                sketches = Sketches(found, impact)
                step = max(1, TABLE // len(items.entry_term))
                # Documents are ranked so many at a time that their bounds for all items fit a table, however short their texts are.
                several = step * max(1, TABLE // (step * len(items.ids)))
                for first in range(0, hi - lo, several):
                    last = min(first + several, hi - lo)
                    bounds = np.concatenate([
                        np.add.reduceat(sketches.look_up(documents, items.terms)[:, items.entry_term] * weights, items.first, axis=1)
                        for documents in (np.arange(a, min(a + step, last)) for a in range(first, last, step))
                    ])
                    hopeful = np.flatnonzero(bounds.max(axis=0) >= np.array([b.threshold for b in best]))
                    for q in hopeful:
                        top, bound = best[q], bounds[:, q]
                        candidates = np.flatnonzero(bound >= top.threshold)
                        candidates = candidates[np.argsort(-bound[candidates], kind="stable")]
                        entry = slice(items.first[q], ends[q])
                        terms = items.terms[items.entry_term[entry]]
                        for at in range(0, len(candidates), STEP):
                            some = candidates[at:at + STEP]
                            some = some[bound[some] >= top.threshold]
                            if not len(some):
                                break
                            top.add(exact_scores(found, impact, some + first, terms, weights[entry]), ids[some + first + lo], null[some + first + lo])
        found = [(q, s, i, n) for q, b in enumerate(best) for s, i, n in zip(b.scores.tolist(), b.ids.tolist(), b.null.tolist())]
        if found:
            item, score, doc, none = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [items.ids.take(pa.array(item)), pa.array([None if n else d for d, n in zip(doc, none)], pa.int64()), pa.array(score, pa.int64())],
                ["item_id", "doc_id", "score"])
    return run


def search(documents: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 for each item.

    ``documents`` has doc_id (whole numbers) and text, ``items`` item_id and text.
    """
    spark = documents.sparkSession
    docs = picked(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, doc_id bigint, score bigint")
    for some in item_blocks(picked(items, item_id="item_id", text="text"), block):
        shared = spark.sparkContext.broadcast(some)
        counts = count_terms(docs, shared)
        if counts.documents:
            out = out.unionByName(docs.mapInArrow(_rank(shared, counts, k), f"item_id {kind}, doc_id bigint, score bigint"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = first_n_per_group(out, ["item_id"], order, k, ["doc_id"])
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return best.select("item_id", rank.alias("rank"), "doc_id", "score")
