"""Quality classifier from weak labels: overlapping heuristics vote, expectation-maximisation weighs them, a hashed linear model learns the result.

Each heuristic votes good, bad or nothing on a whole text.  The votes of all texts are counted per vote pattern (at most
``3 ** labellers`` of them), so fitting the accuracies needs only that table.  Posteriors of a bounded sample then train a logistic
model on hashed word shapes, repetitions and words; its probability is the score.

Nulls and empty texts have no vote and no feature: they score like a text of plain words, but are rejected, since they
hold nothing to learn from.  Repeated rows give repeated results; ties at the threshold are kept.  The sample has one row of an id, so repeated ids
don't enlarge it; rows without an id are not in it, and without any sampled row all texts score 0.5.  Texts of any length are read whole, about a
megabyte of texts at a time.  ``score`` carries other columns along, whatever their names, and replaces those named score and n_words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangrove.llm.tokens import Words, mixed, one_row_an_id, ragged, text_buffers, slices, words_of
from scangrove.session import stored

LABELLERS = ("plain words", "capitals", "symbols", "bare punctuation", "exclamations", "stutter", "variety", "sentences")
SAMPLE = 6_000        # texts that the linear model is trained on
DIMENSIONS = 2_048
THRESHOLD = 0.5
ROUNDS, STEPS, RATE, DECAY = 50, 300, 4.0, 1e-5
SHORT = 12            # a shorter text is filled up with plain words, so that a few words decide little
BAD, NONE, GOOD = 0, 1, 2


def _totals(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the ranges ``first[i]:first[i+1]``."""
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _word_flags(raw: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """Per word: plain, capitals, symbols, bare, exclaimed, repeats the word before, ends a sentence, new in its text."""
    byte = np.arange(256)
    upper = (byte >= 65) & (byte <= 90)
    letter = upper | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    symbol = np.isin(byte, np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8))

    def within(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        return total[words.ends] - total[words.starts]

    size, letters, capitals, symbols = words.ends - words.starts, within(letter), within(upper), within(symbol)
    last = raw[words.ends - 1] if len(words.ends) else raw[:0]
    inner = size - letters - np.isin(last, np.frombuffer(b".,;:!?)\"'", np.uint8))
    same = np.zeros(len(size), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
    _, seen = np.unique(words.hashes + mixed(words.text.astype(np.uint64)), return_index=True)
    new = np.zeros(len(size), bool)
    new[seen] = True
    before = raw[np.maximum(words.ends - 2, 0)] if len(words.ends) else raw[:0]
    return {
        "plain": (inner <= 0) & (letters > 0) & (capitals <= 1), "capitals": (capitals >= 2) & (capitals * 2 > letters), "symbols": symbols > 0,
        "bare": letters == 0, "exclaimed": (last == 33) & (before == 33) & (size > 1), "stutter": same, "ends": np.isin(last, np.frombuffer(b".!?", np.uint8)), "new": new,
    }


def votes(flags: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    """A vote of each labeller on each text."""
    n = np.diff(first).astype(float)
    share = {k: _totals(v, first) / np.maximum(n, 1) for k, v in flags.items()}
    expected = np.minimum(0.3, 6 / np.sqrt(np.maximum(n, 1)))

    def vote(bad: np.ndarray, good: np.ndarray, least: int) -> np.ndarray:
        return np.where(n < least, NONE, np.where(bad, BAD, np.where(good, GOOD, NONE)))

    return np.stack([
        vote(share["plain"] < 0.6, share["plain"] > 0.9, 3),
        vote(share["capitals"] > 0.3, share["capitals"] < 0.05, 3),
        vote(share["symbols"] > 0.2, share["symbols"] < 0.03, 3),
        vote(share["bare"] > 0.2, share["bare"] < 0.03, 3),
        vote(share["exclaimed"] > 0.2, share["exclaimed"] < 0.02, 3),
        vote(share["stutter"] > 0.25, share["stutter"] < 0.03, 5),
        vote(share["new"] < expected / 2, share["new"] > expected, 12),
        vote((share["ends"] > 0.6) | (share["ends"] < 0.005), (share["ends"] > 0.02) & (share["ends"] < 0.35), 30),
    ], axis=1).astype(np.int32)


def flag_features(flags: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Hashed features of each word's flags: all together, and each by itself."""
    flagged = sum(v.astype(np.uint64) << np.uint64(i) for i, v in enumerate(flags.values()))
    parts = [flagged] + [v.astype(np.uint64) + np.uint64(1000 + 2 * i) for i, v in enumerate(flags.values())]
    return [(mixed(p * np.uint64(31) + np.uint64(7)) % np.uint64(DIMENSIONS)).astype(np.int64) for p in parts]


def features(flags: dict[str, np.ndarray], words: Words) -> list[np.ndarray]:
    """Hashed features of each word: of its flags, and the word itself."""
    return [*flag_features(flags), (words.hashes % np.uint64(DIMENSIONS)).astype(np.int64)]


def filler() -> np.ndarray:
    """Features of a plain word that is new in its text."""
    names = ("plain", "capitals", "symbols", "bare", "exclaimed", "stutter", "ends", "new")
    return np.concatenate(flag_features({k: np.array([k in ("plain", "new")]) for k in names}))


def _chunks(batch: pa.RecordBatch, text: str):
    data, offsets = text_buffers(batch.column(text))
    for lo, hi in slices(offsets):
        raw = data[offsets[lo]:offsets[hi]]
        words = words_of(data, offsets[lo:hi + 1])
        yield lo, hi, words, _word_flags(raw, words)


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return vote @ (3 ** np.arange(vote.shape[1]))


def _vote_rows(batches):
    for batch in batches:
        for lo, hi, words, flags in _chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(pattern_of(votes(flags, words.first)).astype(np.int32))], ["key", "pattern"])


def _feature_rows(batches):
    plain = np.bincount(filler(), minlength=DIMENSIONS)
    for batch in batches:
        for lo, hi, words, flags in _chunks(batch, "text"):
            parts, rows = features(flags, words), []
            for i in range(hi - lo):
                a, b = words.first[i], words.first[i + 1]
                counts = np.bincount(np.concatenate([p[a:b] for p in parts]), minlength=DIMENSIONS) + max(0, SHORT - (b - a)) * plain
                rows.append(counts.astype(np.float32) / max(SHORT, b - a))
            used = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pattern_of(votes(flags, words.first)).astype(np.int32)), ragged([u.astype(np.int32) for u in used], pa.int32()), ragged([r[u] for r, u in zip(rows, used, strict=True)], pa.float32())],
                ["pattern", "at", "weight"],
            )


def accuracies(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expectation-maximisation over vote patterns; the probability that a text of each pattern is good."""
    vote = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good, bad = (vote == GOOD).sum(axis=1), (vote == BAD).sum(axis=1)
    # A bad vote names a fault, a good one only its absence.
    belief = 1 / (1 + np.exp(-(0.7 * good - 3.0 * bad + 1)))
    for _ in range(ROUNDS):
        log = np.zeros((len(patterns), 2))
        for y, weight in enumerate((1 - belief, belief)):
            mass = weight * counts
            log[:, y] = np.log(mass.sum() + 1)
            for j in range(len(LABELLERS)):
                told = np.array([mass[vote[:, j] == v].sum() for v in (BAD, NONE, GOOD)]) + 1
                log[:, y] += np.log(told / told.sum())[vote[:, j]]
        belief = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return belief


def train(at: list[np.ndarray], weight: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic model on hashed features with soft targets; the last weight is the constant."""
    x = np.zeros((len(at), DIMENSIONS + 1), np.float32)
    for i, (a, w) in enumerate(zip(at, weight, strict=True)):
        x[i, a] = w
    x[:, DIMENSIONS] = 1
    beta, speed = np.zeros(DIMENSIONS + 1, np.float32), np.zeros(DIMENSIONS + 1, np.float32)
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ beta))) - target
        speed = 0.9 * speed - RATE / 10 * (x.T @ error.astype(np.float32) / len(x) + DECAY * beta)
        beta = beta + speed
    return beta


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the linear model.  All texts count for the labellers' accuracies; about ``sample`` of them, one an id, train the model."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    voted = stored(texts.mapInArrow(_vote_rows, "key string, pattern int"), "votes")
    table = voted.groupBy("pattern").agg(F.count("*").alias("n")).toArrow()   # at most 3 ** labellers rows
    patterns, counts = table.column("pattern").to_numpy(), table.column("n").to_numpy().astype(float)
    if not len(patterns):
        return np.zeros(DIMENSIONS + 1, np.float32)
    belief = accuracies(patterns, counts)
    spot = F.pmod(F.xxhash64(F.lit("quality"), "key"), F.lit(1 << 30))
    ids = voted.agg(F.approx_count_distinct("key", 0.01)).first()[0]
    chosen = one_row_an_id(texts.where(F.col("key").isNotNull() & (spot < min(1.0, sample / max(1, ids)) * (1 << 30))), "key")
    rows = chosen.select("text").mapInArrow(_feature_rows, "pattern int, at array<int>, weight array<float>").toArrow()
    if not rows.num_rows:
        return np.zeros(DIMENSIONS + 1, np.float32)
    order = {p: b for p, b in zip(patterns.tolist(), belief.tolist(), strict=True)}
    lists = [[np.array(v.as_py()) for v in rows.column(c)] for c in ("at", "weight")]
    return train(*lists, np.array([order[p] for p in rows.column("pattern").to_pylist()], np.float32))


def values(words: Words, flags: dict[str, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of words of each text."""
    n = np.diff(words.first)
    sums = _totals(sum((weights[f] for f in features(flags, words)), np.zeros(len(words.text))), words.first) + np.maximum(0, SHORT - n) * weights[filler()].sum()
    return 1 / (1 + np.exp(-np.clip(sums / np.maximum(n, SHORT) + weights[-1], -50, 50))), n


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, then score (0 to 1, higher is better) and n_words; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (text, "score", "n_words")]

    def run(batches):
        for batch in batches:
            for lo, hi, words, flags in _chunks(batch, text):
                value, n = values(words, flags, weights)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(value.astype(float)), pa.array(n)], [*kept, "score", "n_words"])

    return docs.mapInArrow(run, docs.select(*kept).schema.add("score", "double").add("n_words", "long"))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, score and kept of every document."""
    found = score(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs))
    return found.select("doc_id", "n_words", "score", ((F.col("score") >= THRESHOLD) & (F.col("n_words") > 0)).alias("kept"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, unchanged, whatever columns they have."""
    weights = fit(docs)

    def run(batches):
        for batch in batches:
            found = [values(words, flags, weights) for _, _, words, flags in _chunks(batch, "text")]
            keep = np.concatenate([(value >= THRESHOLD) & (n > 0) for value, n in found]) if found else np.zeros(0, bool)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
