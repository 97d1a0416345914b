"""Language-model scores from a hidden Markov model trained by Baum-Welch, beside a smoothed unigram base score.

Words of the training texts are counted once, over all of them.  The most frequent words are symbols of their own, the others fall into
hashed classes, and a text ends with an end symbol.  States emit symbols; a word of a class has its smoothed share of the class.
Each Baum-Welch round adds up expected transitions and emissions per partition and sums them by Spark.  Each of the first rounds takes
a twelfth of the training texts, by a hash of the id, and blends its sums with those before (stepwise expectation-maximisation); these parts are
the same shares of a corpus of any size, and together they are all of it.  The last rounds read all training texts.  The scaled forward recursion gives the exact
likelihood of a text's symbols.

Counts of the most frequent words (at most ``HEAD``) go to the tasks; a text's other words meet their counts in a join.

Null and empty texts are one end token.  A null id is neither in the training part nor held out.  Without training texts all counts are 0 and
the model is uniform.  Repeated rows give repeated results.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangrove.llm.tokens import remainder, signed, word_batches
from scangrove.session import stored

STATES = 8
OWN, CLASSES = 4_096, 256       # words with a symbol of their own, classes of the others
SYMBOLS, END = OWN + CLASSES + 1, OWN + CLASSES
HEAD = 1 << 19                  # words whose counts go to the tasks
WARM, ROUNDS = 12, 2            # rounds over parts in turn, rounds over all training texts
PART_TEXTS = 1_500              # no longer read: a part is always a twelfth of the training texts (a test still sets it)
FADE = 0.6                      # power of the part's number by which the weight of its sums falls
FLUSH = 1_500_000               # distinct words that a task adds up before it passes them on
RUN_TOKENS = 400_000            # symbols that the recursions work on at a time


class Vocabulary(NamedTuple):
    """Sorted hashes of the head words with their counts and symbols, totals of the classes, and the training totals."""

    units: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    class_norm: np.ndarray
    tokens: int
    distinct: int
    texts: int


class Model(NamedTuple):
    start: np.ndarray       # of each state
    move: np.ndarray        # from state, to state
    emit: np.ndarray        # symbol, state


def _count_words(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        units, where = np.unique(np.concatenate([u for u, _ in held]), return_inverse=True)
        return units, np.bincount(where, np.concatenate([c for _, c in held]), len(units)).astype(np.int64)

    def rows(units, counts):
        return pa.RecordBatch.from_arrays([pa.array(signed(units)), pa.array(counts)], ["unit", "count"])

    size = 0
    for batch in batches:
        for _, _, words in word_batches(batch.column("text")):
            held.append(np.unique(words.hashes, return_counts=True))
            size += len(held[-1][0])
            if size > 2 * FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*merged())


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From the table of word counts (unit, count)."""
    steps = F.floor(F.log2("count") * 8).cast("int")
    shape = {r["step"]: r["n"] for r in counts.groupBy(steps.alias("step")).agg(F.count("*").alias("n")).collect()}   # at most 8 rows a power of two
    least, taken = 1, 0
    for step in sorted(shape, reverse=True):
        taken += shape[step]
        if taken > HEAD:
            least = int(np.floor(2 ** ((step + 1) / 8)))
            break
    head = counts.where((F.col("count") >= least) & (steps >= (0 if taken <= HEAD else step + 1))).toArrow()
    units = head.column("unit").to_numpy().view(np.uint64) if head.num_rows else np.zeros(0, np.uint64)
    count = head.column("count").to_numpy() if head.num_rows else np.zeros(0, np.int64)
    order = np.argsort(units)
    units, count = units[order], count[order]
    own = np.lexsort((units, -count))[:OWN]
    symbols = (OWN + (units % np.uint64(CLASSES)).astype(np.int64)).astype(np.uint16)
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    class_of = F.col("unit").bitwiseAND(F.lit(CLASSES - 1))
    for r in counts.groupBy(class_of.alias("class")).agg(F.sum("count").alias("total"), F.count("*").alias("kinds")).collect():
        totals[r["class"]], kinds[r["class"]] = r["total"], r["kinds"]
    words, distinct = int(totals.sum()), int(kinds.sum())
    np.subtract.at(totals, symbols[own].astype(int) - OWN, count[own])
    np.subtract.at(kinds, symbols[own].astype(int) - OWN, 1)
    symbols[own] = np.arange(len(own))
    return Vocabulary(units, count, symbols, totals + 0.5 * (kinds + 1), words + texts, distinct + (texts > 0), texts)


def symbol_frequencies(v: Vocabulary) -> np.ndarray:
    """Share of each symbol among the training tokens, smoothed."""
    n = np.full(SYMBOLS, 0.5)
    own = v.symbols < OWN
    n[v.symbols[own]] += v.counts[own]
    n[OWN:OWN + CLASSES] += v.class_norm
    n[END] += v.texts
    return n / n.sum()


def _encode(v: Vocabulary):
    """Texts as symbols, sums over words whose counts are at hand, and the other words with their numbers."""
    def run(batches):
        entry = pa.struct([("unit", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for lo, hi, words in word_batches(batch.column("text")):
                n = hi - lo
                at = np.minimum(np.searchsorted(v.units, words.hashes), max(0, len(v.units) - 1))
                known = v.units[at] == words.hashes if len(v.units) else np.zeros(len(at), bool)
                symbol = (OWN + (words.hashes % np.uint64(CLASSES)).astype(np.int64)).astype(np.uint16)
                symbol[known] = v.symbols[at[known]]
                logs = np.zeros(len(at))
                logs[known] = np.log10(v.counts[at[known]] + 0.5)
                classed = symbol >= OWN
                inner = np.zeros(len(at))
                inner[classed] = logs[classed] - np.log10(v.class_norm[symbol[classed].astype(int) - OWN])
                lengths = np.diff(words.first)
                ends = words.first[1:] + np.arange(n)
                line = np.full(len(at) + n, END, np.uint16)
                line[np.arange(len(at)) + words.text] = symbol
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((words.hashes[rare], words.text[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (words.hashes[order[1:]] != words.hashes[order[:-1]]) | (words.text[order[1:]] != words.text[order[:-1]])
                firsts = np.flatnonzero(new)
                offsets = np.append(0, np.cumsum(np.bincount(words.text[order[firsts]], minlength=n))).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(signed(words.hashes[order[firsts]])), pa.array(np.diff(np.append(firsts, len(order))))], fields=list(entry))
                line_offsets = np.append(0, (ends + 1) * 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, n) for c in ("row", "doc_id", "rest")), pa.array(lengths + 1),
                     pa.array(np.bincount(words.text, known, n).astype(np.int64) + (v.texts > 0)),
                     pa.array(np.bincount(words.text, logs, n) + np.log10(v.texts + 0.5)), pa.array(np.bincount(words.text, inner, n).astype(float)),
                     pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(line_offsets), pa.py_buffer(line)]), pa.ListArray.from_arrays(offsets, rest)],
                    ["row", "doc_id", "rest", "n_tokens", "n_known", "logs", "inner", "symbols", "rare"],
                )
    return run


def _runs(column: pa.Array):
    """Texts of about the same length together: their row numbers, lengths (longest first), starts, and all symbols."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // 2
    symbols = np.frombuffer(column.buffers()[2], np.uint16)
    order = np.argsort(-np.diff(offsets), kind="stable")
    lengths = np.diff(offsets)[order].astype(np.int64)
    total, lo = np.cumsum(lengths), 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + RUN_TOKENS, "right")))
        rows, n = order[lo:hi], lengths[lo:hi]
        # Symbols by place in the text, so that a step of the recursion is one range.
        steps = np.searchsorted(-n, -np.arange(n[0]), "left")
        first = np.append(0, np.cumsum(steps))
        line = np.empty(first[-1], np.uint16)
        begin = offsets[rows].astype(np.int64)
        for t in range(len(steps)):
            line[first[t]:first[t + 1]] = symbols[begin[:steps[t]] + t]
        yield rows, steps, first, line
        lo = hi


def forward(model: Model, steps: np.ndarray, first: np.ndarray, line: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 likelihood of each text by the scaled forward recursion; the scaled values and scales of each place, if kept."""
    emit, logs = model.emit[line], np.zeros(steps[0])
    alphas = emit if keep else None
    scales = np.empty(len(line) if keep else 0, emit.dtype)
    before, ones = None, np.ones(STATES, emit.dtype)
    for t in range(len(steps)):
        lo, hi, m = first[t], first[t + 1], steps[t]
        now = (model.start if before is None else before[:m] @ model.move) * emit[lo:hi]
        scale = now @ ones
        now /= scale[:, None]
        logs[:m] += np.log10(scale)
        if keep:
            alphas[lo:hi], scales[lo:hi] = now, scale
        before = now
    return logs, alphas, scales


def expected(model: Model, steps: np.ndarray, first: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions of some texts; in single precision, which is enough for training."""
    model = Model(*(x.astype(np.float32) for x in model))
    _, alphas, scales = forward(model, steps, first, line, True)
    moves = np.zeros((STATES, STATES))
    after = None
    for t in range(len(steps) - 1, -1, -1):
        lo, hi, m = first[t], first[t + 1], steps[t]
        beta = np.ones((m, STATES), np.float32)
        if after is not None:
            beta[:len(after)] = after @ model.move.T
        if t:
            after = model.emit[line[lo:hi]] * beta / scales[lo:hi][:, None]
            moves += alphas[first[t - 1]:first[t - 1] + m].T @ after
        alphas[lo:hi] *= beta
    emits = np.stack([np.bincount(line, alphas[:, k], SYMBOLS) for k in range(STATES)], axis=1)
    return alphas[:steps[0]].sum(axis=0), moves * model.move, emits


def _expectation(model: Model):
    def run(batches):
        sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))]
        for batch in batches:
            for _, steps, first, line in _runs(batch.column("symbols")):
                for total, part in zip(sums, expected(model, steps, first, line), strict=True):
                    total += part
        flat = np.concatenate([s.ravel() for s in sums])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], ["at", "value"])
    return run


def baum_welch(lines: DataFrame, frequencies: np.ndarray, texts: int) -> Model:
    """A model from the symbols (column ``symbols``) of the training texts."""
    rng = np.random.default_rng(10)
    # States that last, so that a whole text decides between them from the first round on.
    emit = frequencies[:, None] * rng.uniform(0.2, 1.8, (SYMBOLS, STATES))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    model = Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))
    part = F.pmod(F.xxhash64(F.lit("markov"), "doc_id"), F.lit(WARM))
    blend = None
    for k in range(WARM + ROUNDS if texts else 0):
        read = lines.where(part == k) if k < WARM else lines
        found = read.select("symbols").mapInArrow(_expectation(model), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        if not found.num_rows:   # a part without texts tells nothing
            continue
        flat = np.zeros(STATES + STATES ** 2 + SYMBOLS * STATES)   # as many rows at most
        flat[found.column("at").to_numpy()] = found.column("value").to_numpy()
        if k < WARM:
            weight = (k + 1) ** -FADE
            blend = flat = flat if blend is None else (1 - weight) * blend + weight * flat
        start, move, emit = flat[:STATES] + 0.1, flat[STATES:STATES + STATES ** 2].reshape(STATES, STATES) + 0.1, flat[STATES + STATES ** 2:].reshape(SYMBOLS, STATES)
        emit = emit + frequencies[:, None] * (50 + 0.02 * emit.sum(axis=0))
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def _likelihood(model: Model):
    def run(batches):
        for batch in batches:
            logs = np.zeros(batch.num_rows)
            for rows, steps, first, line in _runs(batch.column("symbols")):
                logs[rows] = forward(model, steps, first, line, False)[0]
            names = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(logs)], [*names, "symbol_score"])
    return run


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, learned from those not held out."""
    rest = remainder("doc_id", 5)
    training = docs.where((rest != 1) & (rest >= 0))
    counts = stored(training.select("text").mapInArrow(_count_words, "unit long, count long").groupBy("unit").agg(F.sum("count").alias("count")), "word_counts")
    texts = training.count()
    v = vocabulary(counts, texts)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), rest.alias("rest"), "text")
    coded = stored(numbered.mapInArrow(
        _encode(v), "row long, doc_id long, rest int, n_tokens long, n_known long, logs double, inner double, symbols binary, rare array<struct<unit: long, n: long>>"), "symbols")
    model = baum_welch(coded.where((F.col("rest") != 1) & (F.col("rest") >= 0)), symbol_frequencies(v), texts)
    rare = coded.select("row", F.explode("rare").alias("w")).select("row", "w.unit", "w.n").join(counts, "unit", "left")
    tail = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("count", F.lit(0)) + 0.5)).alias("rare_logs"), F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    scored = coded.drop("rare").mapInArrow(_likelihood(model), "row long, doc_id long, rest int, n_tokens long, n_known long, logs double, inner double, symbol_score double")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(tail, "row", "left").select(
        "doc_id", (F.col("rest") == 1).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * float(np.log10(v.tokens + 0.5 * (v.distinct + 1)))).alias("base_score"),
        (F.col("symbol_score") + F.col("inner") + rare_logs).alias("score"),
    )
