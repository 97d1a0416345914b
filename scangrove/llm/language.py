"""Language identification, word first: known words by their frequency in each language, unseen words by their character n-grams.

An unseen word is scored character by character with the longest n-gram ending there that the model knows, from four
characters down to one.  The model is fitted on at most ``SAMPLE`` texts a language; prediction reads every whole text, however long.  It knows at most
``KNOWN_UNITS`` words, and as many n-grams of each length, in equal shares of the languages; more than ``MAX_LANGUAGES`` languages are refused.

Nulls and texts without a letter: ``und`` with score 0.  Without any labelled text every row is ``und``.  Ties go to the first
language by name.  A null id is never in the training part and is not held out.  Repeated rows give repeated results.  Of an id with several labelled
rows the one whose text has the smallest hash is learned from.  ``predict`` carries other columns along, whatever their names, and replaces those
named lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scangrove.llm.tokens import Ranges, one_row_an_id, picked, remainder, signed, slices, text_buffers
from scangrove.session import stored

SAMPLE = 4_000      # texts a language that the model is fitted on
LEAST_TEXTS = 3     # texts of the sample in which a word must occur to be known
LONGEST = 4
KNOWN_UNITS = 200_000
MAX_LANGUAGES = 500   # more are refused


class Model(NamedTuple):
    """Languages, and per unit (sorted hash) a log probability in each language; ``grams[n]`` for n characters."""

    languages: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]


def letter_table() -> np.ndarray:
    """Of each code point up to U+FFFF, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x10000)])


class Letters(NamedTuple):
    points: np.ndarray   # lower-cased code points, a blank wherever no letter stands, texts apart by a blank
    starts: np.ndarray   # of words
    ends: np.ndarray
    text: np.ndarray     # text number of each word


def letters_of(texts: list[str], table: np.ndarray) -> Letters:
    points = np.frombuffer(" ".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) + 1 for t in texts])
    is_letter = table[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        is_letter[high] = [chr(p).isalpha() for p in points[high]]
    points = np.where(is_letter, points, np.uint32(32))
    edge = np.diff(is_letter.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    return Letters(points, starts, ends, np.searchsorted(np.cumsum(lengths), starts - 1, "right"))


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the number of each one's range."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def _gram_hashes(ranges: Ranges, at: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at ``at``; at most one blank before the word counts."""
    return ranges.hashes(np.maximum(at - n + 1, start - 1), at + 1)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    _, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def _counts(batches):
    """Counts of words (n = 0) and n-grams of the sample, by language, added up within a batch."""
    table = letter_table()
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for lo, hi, texts in _texts(batch.column("text")):
            seen = letters_of(texts, table)
            ranges = Ranges(seen.points)
            names = np.array(languages[lo:hi], object)
            for name in dict.fromkeys(languages[lo:hi]):
                mine = np.flatnonzero(names[seen.text] == name) if len(seen.text) else np.zeros(0, int)
                starts, ends = seen.starts[mine], seen.ends[mine]
                hashes = ranges.hashes(starts, ends)
                parts = [(0, hashes, seen.text[mine])]
                at, owner = _spread(starts, ends)
                parts += [(n, _gram_hashes(ranges, at, starts[owner], n), seen.text[mine][owner]) for n in range(1, LONGEST + 1)]
                for n, h, text in parts:
                    keys, where, count = np.unique(h, return_inverse=True, return_counts=True)
                    pairs = np.unique(where * np.int64(len(texts)) + text) // len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)), pa.array(signed(keys)),
                         pa.array(count.astype(np.int64)), pa.array(np.bincount(pairs, minlength=len(keys)).astype(np.int64))],
                        ["lang", "n", "unit", "count", "texts"],
                    )


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, known_units: int = KNOWN_UNITS) -> Model:
    """A model from labelled texts: at most about ``sample`` of each language, chosen by a hash of the id, one row an id.

    Of words, and of n-grams of each length, the model knows at most ``known_units``; each language has an equal share of them for its most
    frequent ones.
    """
    labelled = picked(docs, id=doc_id, text=text, lang=lang).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("id", 0.01).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    empty = np.zeros(0, np.uint64), np.zeros((0, len(languages)))
    if not languages:
        return Model([], empty, {n: empty for n in range(1, LONGEST + 1)})
    share = F.lit(1.0)
    for name, n in sizes.items():
        if n > sample:
            share = F.when(F.col("lang") == name, F.lit(sample / n)).otherwise(share)
    part = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30)) < share * (1 << 30)
    chosen = one_row_an_id(labelled.where(part)).select("text", "lang")
    counts = chosen.mapInArrow(_counts, "lang string, n int, unit long, count long, texts long")
    units = counts.groupBy("n", "unit", "lang").agg(F.sum("count").alias("count"), F.sum("texts").alias("texts"))
    everywhere = units.groupBy("n", "unit").agg(
        F.sum("texts").alias("texts"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("counts"),
    ).where((F.col("n") > 0) | (F.col("texts") >= LEAST_TEXTS))
    # Each language keeps its own most frequent units, so that none loses its units to a larger one.
    order = Window.partitionBy("n", "lang").orderBy(F.desc("count"), "unit")
    kept = units.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, known_units // len(languages))).select("n", "unit").distinct()
    everywhere = everywhere.join(kept, ["n", "unit"], "left_semi")
    rows = stored(everywhere.select("n", "unit", "texts", *(F.coalesce(F.col("counts")[x], F.lit(0)).alias(f"c{i}") for i, x in enumerate(languages))), "language_units")
    tables = {}
    for n in range(LONGEST + 1):
        found = rows.where(F.col("n") == n).toArrow()
        unit = found.column("unit").combine_chunks().to_numpy().view(np.uint64) if found.num_rows else np.zeros(0, np.uint64)
        count = np.stack([found.column(f"c{i}").to_numpy() for i in range(len(languages))], axis=1).astype(float) if found.num_rows else np.zeros((0, len(languages)))
        order = np.argsort(unit)
        tables[n] = unit[order], np.log((count[order] + 0.5) / (count.sum(axis=0) + 0.5 * (len(unit) + 1)))
    return Model(languages, tables[0], {n: tables[n] for n in range(1, LONGEST + 1)})


def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for hashes, and whether each is there."""
    units = table[0]
    if not len(units):
        return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(units, hashes), len(units) - 1)
    return at, units[at] == hashes


def unit_scores(seen: Letters, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct word a log probability in each language, and the distinct word of each word."""
    ranges = Ranges(seen.points)
    keys, where, inverse = np.unique(ranges.hashes(seen.starts, seen.ends), return_index=True, return_inverse=True)
    at, known = _find(model.words, keys)
    scores = np.zeros((len(keys), len(model.languages)))
    scores[known] = model.words[1][at[known]]
    fresh = np.flatnonzero(~known)
    starts, ends = seen.starts[where[fresh]], seen.ends[where[fresh]]
    spots, owner = _spread(starts, ends)
    sums, left = np.zeros((len(spots), len(model.languages))), np.arange(len(spots))
    for n in range(LONGEST, 0, -1):
        at, hit = _find(model.grams[n], _gram_hashes(ranges, spots[left], starts[owner[left]], n))
        sums[left[hit]] = model.grams[n][1][at[hit]]
        left = left[~hit]
    for i in range(len(model.languages)):
        scores[fresh, i] = np.bincount(owner, sums[:, i], len(fresh)) / np.maximum(1, ends - starts)
    return scores, inverse


def predict_texts(texts: list[str], model: Model, table: np.ndarray) -> tuple[list[str], np.ndarray]:
    seen = letters_of(texts, table)
    n = len(texts)
    if not model.languages or not len(seen.starts):
        return ["und"] * n, np.zeros(n)
    scores, inverse = unit_scores(seen, model)
    sums = np.stack([np.bincount(seen.text, scores[inverse, i], n) for i in range(len(model.languages))], axis=1)
    best = sums.argmax(axis=1)
    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    some = np.bincount(seen.text, minlength=n) > 0
    return [model.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, share, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, then lang_pred and score; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]

    def run(batches):
        table = letter_table()
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(text)):
                names, score = predict_texts(texts, model, table)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"],
                )

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    rest = remainder("doc_id", 3)
    model = fit(docs.where((rest != 1) & (rest >= 0)))
    return predict(docs.select(F.col("doc_id").cast("long"), (rest == 1).alias("held_out"), "text"), model)
