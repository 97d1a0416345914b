"""Toxic spans by a linear-chain conditional random field over words; a document's score comes from the marginals.

Labels are given for whole texts.  Words are labelled from them: in a toxic text, a word is toxic if the word or one of its beginnings
occurs in many toxic texts and next to no others.  The field has two states, hashed features of a word (itself, beginnings, ending)
and transitions; a sentence is a chain.  Forward-backward marginals of whole texts give spans, and their largest value and sum
go through a logistic function fitted on the sample's labels.

A word or beginning counts as toxic if its texts are toxic far more often than chance would have it among so many candidates; near
copies count once.  Everything is fitted on a bounded sample of labelled texts (``SAMPLE``), one row an id; of each of them at most ``PIECES`` and
``MARKED`` pieces of ``PIECE`` words, at even distances, train the field, however long it is.  Scores and spans are those of whole texts.

Null, empty and unlabelled texts are scored like others; without any labels, or labels of one kind only, the score is the share of toxic
labels (0 without labels).  Repeated rows give repeated results; a null id is never in the training part and is not held out.  An id with
several labels counts as toxic if one of them is 1; of an id with several texts the one with the smallest hash is learned from.  Scores and marginals that
equal a limit count as reaching it.  Columns other than those named are carried along by ``tag`` and left aside elsewhere.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangrove.llm.near_dedup import shingle_sets
from scangrove.llm.tokens import Ranges, Words, mixed, one_row_an_id, picked, ragged, remainder, signed, word_batches
from scangrove.session import stored

SAMPLE = 3_000          # toxic texts that the model is fitted on, and three times as many others
PIECES, MARKED, PIECE = 6, 16, 64   # of a sampled text: pieces of any kind, more with toxic words, and words in a piece, that train the field
DIMENSIONS = 1 << 16
BEGINNINGS = (3, 4, 5, 6, 7, 8)
LEAST_TEXTS, LEAST_ODDS, SKETCHES = 4, 12, 3
STEPS, RATE, DECAY = 40, 0.3, 1e-4
PREDICTED = 0.7
EDGE = b".,;:!?\"'()[]*#$%&|"


class Field(NamedTuple):
    """Emission weights of the toxic state, log transitions [from, to], log start, and the weights of the text score."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    text: np.ndarray


def word_features(words: Words) -> list[np.ndarray]:
    """64-bit hashes of each word: itself, its beginnings, its ending; punctuation around it is left out."""
    edge = np.isin(np.arange(256), np.frombuffer(EDGE, np.uint8))
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        inner = ends - starts > 1
        ends -= inner & edge[words.data[ends - 1]]
        inner = ends - starts > 1
        starts += inner & edge[words.data[np.minimum(starts, len(words.data) - 1)]]
    ranges, kinds = Ranges(words.data), [(starts, ends)]
    kinds += [(starts, np.minimum(starts + k, ends)) for k in BEGINNINGS] + [(np.maximum(ends - 3, starts), ends)]
    return [mixed(ranges.hashes(*k) + np.uint64(i)) for i, k in enumerate(kinds)]


def chains(words: Words) -> np.ndarray:
    """Where chains begin: at each text, and after a word that ends a sentence; the number of words comes last."""
    n = len(words.text)
    new = np.ones(n, bool)
    new[1:] = (words.text[1:] != words.text[:-1]) | np.isin(words.data[words.ends[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    return np.append(np.flatnonzero(new), n)


def marginals(emission: np.ndarray, first: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state at each word of the chains ``first[i]:first[i+1]``, and expected transitions, by forward-backward."""
    n, length = len(emission), np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    longer = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")   # chains of more than t words
    e1 = np.exp(np.clip(emission, -30, 30))
    (k00, k01), (k10, k11) = np.exp(field.transition)
    s0, s1 = np.exp(field.start)
    a1, scale, b0, b1 = np.empty(n), np.empty(n), np.ones(n), np.ones(n)
    for t, last in enumerate(longer):
        at = begin[:last] + t
        if t == 0:
            x0, x1 = np.full(last, s0), s1 * e1[at]
        else:
            p1 = a1[at - 1]
            p0 = 1 - p1
            x0, x1 = p0 * k00 + p1 * k10, (p0 * k01 + p1 * k11) * e1[at]
        total = x0 + x1
        scale[at], a1[at] = total, x1 / total
    pairs = np.zeros((2, 2))
    for t in range(len(longer) - 1, 0, -1):
        at = begin[:longer[t]] + t
        h0, h1 = b0[at] / scale[at], e1[at] * b1[at] / scale[at]
        b0[at - 1], b1[at - 1] = k00 * h0 + k01 * h1, k10 * h0 + k11 * h1
        p1 = a1[at - 1]
        p0 = 1 - p1
        pairs += [[p0 @ h0 * k00, p0 @ h1 * k01], [p1 @ h0 * k10, p1 @ h1 * k11]]
    one = a1 * b1
    return one / np.maximum(one + (1 - a1) * b0, 1e-300), pairs


def train_field(features: np.ndarray, labels: np.ndarray, first: np.ndarray) -> Field:
    """Maximum likelihood with weight decay; ``features`` has the hashed features of each word."""
    field = Field(np.zeros(DIMENSIONS), np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    begins = np.zeros(len(labels), bool)
    begins[first[:-1]] = True
    inner = np.flatnonzero(~begins)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
    size, flat = max(1, len(first) - 1), features.ravel()
    squares, width = np.full(DIMENSIONS, 1e-8), features.shape[1]
    for _ in range(STEPS):
        toxic, pairs = marginals(field.emission[features].sum(axis=1), first, field)
        slope = np.bincount(flat, np.repeat(labels - toxic, width), DIMENSIONS) - DECAY * len(labels) * field.emission / 100
        squares += slope ** 2
        field.emission[:] += RATE * slope / np.sqrt(squares)
        field.transition[:] += RATE * np.clip((seen - pairs) / size, -1, 1)
        field.start[1] += RATE * np.clip((labels[first[:-1]].sum() - toxic[first[:-1]].sum()) / size, -1, 1)
    return field


def _association(batches):
    """Number of sampled texts that hold each feature, by label, added up within a batch."""
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        for lo, hi, words in word_batches(batch.column("text")):
            for feature in word_features(words)[:-1] if len(words.text) else []:
                keys, code = np.unique(feature, return_inverse=True)
                pairs = np.unique(code * np.int64(hi - lo) + words.text)
                code, toxic = pairs // (hi - lo), label[lo:hi][pairs % (hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys)), pa.array(np.bincount(code, toxic, len(keys)).astype(np.int64)), pa.array(np.bincount(code, 1 - toxic, len(keys)).astype(np.int64))],
                    ["unit", "bad", "good"],
                )


def _sketches(batches):
    """Smallest hashes of the five-word sequences of each text: near copies agree in most of them."""
    for batch in batches:
        for lo, hi, words in word_batches(batch.column("text")):
            sets = list(shingle_sets(words))
            least = [[signed(mixed(s ^ np.uint64(k)).min(keepdims=True))[0] if len(s) else k for s in sets] for k in range(SKETCHES)]
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *(pa.array(x, pa.int64()) for x in least)], [*batch.schema.names, *(f"sketch{k}" for k in range(SKETCHES))])


def _spaced(owner: np.ndarray, most: int) -> np.ndarray:
    """Which pieces to keep, given the text of each in ascending order: at most ``most`` of a text, at even distances."""
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return rank % -(-np.bincount(owner)[owner] // most) == 0 if len(owner) else np.zeros(0, bool)


def _pieces(lexicon: np.ndarray):
    """Pieces of sampled texts: feature hashes and labels of their words."""
    def run(batches):
        for batch in batches:
            label = batch.column("toxic").to_numpy()
            for lo, _, words in word_batches(batch.column("text")):
                if not len(words.text):
                    continue
                parts = word_features(words)
                marked = np.logical_or.reduce([np.isin(p, lexicon) for p in parts[:-1]]) & (label[lo:][words.text] == 1)
                hashed = np.stack([(p % np.uint64(DIMENSIONS)).astype(np.int32) for p in parts], axis=1)
                first = chains(words)
                cuts = np.unique(np.concatenate([np.arange(a, b, PIECE) for a, b in zip(first[:-1], first[1:], strict=True)]))
                owner, ends = words.text[cuts], np.append(cuts[1:], len(words.text))
                some = np.flatnonzero(np.logical_or.reduceat(marked, cuts))
                chosen = np.union1d(np.flatnonzero(_spaced(owner, PIECES)), some[_spaced(owner[some], MARKED)])
                yield pa.RecordBatch.from_arrays(
                    [ragged([hashed[cuts[i]:ends[i]].ravel() for i in chosen], pa.int32()), ragged([marked[cuts[i]:ends[i]].astype(np.int32) for i in chosen], pa.int32())],
                    ["features", "labels"],
                )
    return run


def text_scores(words: Words, n: int, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Per text the largest marginal and their sum (columns of the first array); the marginal of each word."""
    out = np.zeros((n, 2))
    if not len(words.text):
        return out, np.zeros(0)
    emission = np.zeros(len(words.text))
    for p in word_features(words):
        emission += field.emission[(p % np.uint64(DIMENSIONS)).astype(np.int64)]
    toxic, _ = marginals(emission, chains(words), field)
    some = np.flatnonzero(np.diff(words.first))
    out[some, 0] = np.maximum.reduceat(toxic, words.first[some])
    out[:, 1] = np.bincount(words.text, toxic, n)
    return out, toxic


def _logit_inputs(found: np.ndarray) -> np.ndarray:
    top = np.clip(found[:, 0], 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(found)), np.log(top / (1 - top)) / 5, np.log1p(found[:, 1])], axis=1)


def _sampled_scores(field: Field):
    def run(batches):
        for batch in batches:
            for lo, hi, words in word_batches(batch.column("text")):
                found, _ = text_scores(words, hi - lo, field)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, hi - lo), pa.array(found[:, 0]), pa.array(found[:, 1])], ["toxic", "top", "total"])
    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from the texts of ``docs`` that ``labels`` (doc_id, toxic) marks 0 or 1."""
    marks = picked(labels, id="doc_id", toxic="toxic").where("toxic IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = picked(docs, id="doc_id").where("id IS NOT NULL").distinct()
    sizes = {r["toxic"]: r["n"] for r in ids.join(marks, "id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = 1 - 1e-6 if 1 in sizes else 1e-6
        return Field(np.zeros(DIMENSIONS), np.zeros((2, 2)), np.zeros(2), np.array([np.log(share / (1 - share)), 0, 0]))
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / sizes[1]))).otherwise(F.lit(min(1.0, 3 * sample / sizes[0])))
    chosen = marks.where(F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) < rate * (1 << 30))
    texts = one_row_an_id(picked(docs, id="doc_id", text="text").join(chosen, "id").select("id", "toxic", "text"))
    texts = texts.mapInArrow(_sketches, "id long, toxic int, text string" + "".join(f", sketch{k} long" for k in range(SKETCHES)))
    for k in range(SKETCHES):
        least = texts.groupBy("toxic", f"sketch{k}").agg(F.min("id").alias("id"))
        texts = stored(texts.join(least, ["toxic", f"sketch{k}", "id"], "left_semi"), "toxicity_sample")
    texts = texts.select("toxic", "text")
    kept = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    units = stored(
        texts.mapInArrow(_association, "unit long, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxicity_units")
    # How surely a unit's texts are toxic more often than others: the log likelihood ratio against the sample's shares.
    share, both = kept[1] / (kept[0] + kept[1]), F.col("bad") + F.col("good")
    gain = F.col("bad") * F.log(F.col("bad") / (both * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - share)))).otherwise(0)
    lexicon = units.where((F.col("bad") >= LEAST_TEXTS) & (F.col("bad") * (1 - share) >= LEAST_ODDS * share * F.col("good")) & (gain >= float(np.log(max(1, units.count())) + 4))).select("unit").toArrow()
    units = lexicon.column("unit").to_numpy().view(np.uint64) if lexicon.num_rows else np.zeros(0, np.uint64)
    pieces = texts.mapInArrow(_pieces(units), "features array<int>, labels array<int>").toArrow()
    flat = lambda c: pieces.column(c).combine_chunks().flatten().to_numpy()
    labelled = flat("labels").astype(np.int64)
    lengths = np.diff(pieces.column("labels").combine_chunks().offsets.to_numpy()) if pieces.num_rows else np.zeros(0, int)
    field = train_field(flat("features").reshape(len(labelled), -1), labelled, np.append(0, np.cumsum(lengths)))
    found = texts.mapInArrow(_sampled_scores(field), "toxic int, top double, total double").toArrow()
    x, y = _logit_inputs(np.stack([found.column(c).to_numpy() for c in ("top", "total")], axis=1)), found.column("toxic").to_numpy()
    weight = np.zeros(3)
    for _ in range(30):   # Newton's method with a little decay
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        weight += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - p) - 0.5 * weight)
    return field._replace(text=weight)


def tag(docs: DataFrame, field: Field, text: str = "text", least: float = 0.5) -> DataFrame:
    """Columns of ``docs`` but the text, then score and spans: (start, end) of words whose marginal is ``least`` or more, in code points.

    Columns named score or spans are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "score", "spans")]

    def run(batches):
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for lo, hi, words in word_batches(batch.column(text)):
                found, toxic = text_scores(words, hi - lo, field)
                score = 1 / (1 + np.exp(-np.clip(_logit_inputs(found) @ field.text, -30, 30)))
                hit = np.flatnonzero(toxic >= least)
                point = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
                base = point[words.starts[words.first[np.minimum(words.text[hit], len(words.first) - 2)]]] if len(hit) else hit
                lead = _leading(batch.column(text).slice(lo, hi - lo), words, hit)
                offsets = np.append(0, np.cumsum(np.bincount(words.text[hit], minlength=hi - lo))).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(point[words.starts[hit]] - base + lead), pa.array(point[words.ends[hit]] - base + lead)], fields=list(pair))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(score), pa.ListArray.from_arrays(offsets, spans)], [*kept, "score", "spans"],
                )

    return docs.mapInArrow(run, f"{_ddl(docs, kept)}score double, spans array<struct<start: long, end: long>>")


def _leading(column: pa.Array, words: Words, hit: np.ndarray) -> np.ndarray:
    """Blanks before the first word of each hit's text."""
    lead = {i: len(t := column[int(i)].as_py()) - len(t.lstrip(" \t\n\x0b\x0c\r")) for i in np.unique(words.text[hit])}
    return np.array([lead[i] for i in words.text[hit]], np.int64)


def _ddl(docs: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document, learned from those not held out."""
    rest = remainder("doc_id", 3)
    field = fit(docs.where((rest != 1) & (rest >= 0)), labels)
    found = tag(docs.select(F.col("doc_id").cast("long"), (rest == 1).alias("held_out"), "text"), field)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
