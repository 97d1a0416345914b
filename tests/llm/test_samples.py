"""Samples that repeated ids don't enlarge, and plain versions of the language and the quality models."""

import math
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from scangrove.llm import language, lexical, quality, toxicity
from scangrove.llm.tokens import BASE, one_row_an_id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def crowd(spark, docs, doc_id, n=20_000):
    """``docs`` with many more rows of one id, half of them equal."""
    text = F.concat(F.lit("Idiot zebra "), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(0).cast("string"), F.lit(" quagga."))
    more = spark.range(n).select(F.lit(doc_id).cast("long").alias("doc_id"), text.alias("text"), F.lit("zz").alias("lang"))
    return docs.select("doc_id", "text", "lang").unionByName(more).repartition(8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_row_an_id(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"t{i % 11}", i % 2) for i in range(500)] + [(None, "a", 0), (None, "b", 0)]
    table = spark.createDataFrame(rows, "id long, text string, mark int").repartition(5)
    got = one_row_an_id(table).collect()
    assert sorted(r.id for r in got if r.id is not None) == list(range(7)) and len(got) == 8
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, one_row_an_id(table.repartition(3)).collect()), key=repr)
    # The limit is taken before rows are moved.
    assert "WindowGroupLimit" in plan(one_row_an_id(table)) and "Partial" in plan(one_row_an_id(table))
    assert one_row_an_id(table.limit(0)).count() == 0


def test_language_sample_of_a_crowded_id(spark, docs):
    """Fitted with 20,000 rows of one id or with the one of them that counts: the same tables."""
    rows = crowd(spark, docs, 10**9)
    one = one_row_an_id(rows.where(F.col("doc_id") == 10**9).withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")
    many, few = language.fit(rows), language.fit(docs.select("doc_id", "text", "lang").unionByName(one.select("doc_id", "text", "lang")))
    assert many.languages == few.languages and "zz" in many.languages
    for a, b in zip([many.words, *many.grams.values()], [few.words, *few.grams.values()], strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_quality_sample_of_a_crowded_id(spark, docs, monkeypatch):
    """However many rows share an id, one of them is in the sample; whether that id is drawn depends on its hash."""
    sizes = []
    monkeypatch.setattr(quality, "train", lambda at, weight, target: sizes.append(len(at)) or np.zeros(quality.DIMENSIONS + 1))
    n = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    for extra in range(10**9, 10**9 + 4):
        quality.fit(crowd(spark, docs, extra), sample=200)
        quality.fit(crowd(spark, docs, extra), sample=10 * n)
    assert max(sizes[::2]) < 300 and set(sizes[1::2]) == {n + 1}


def test_toxicity_sample_of_a_crowded_id(spark):
    rows = [(i, f"the {i % 37} river by {i % 11} stones and {i % 5} trees" + (" you Idiot." if i % 4 == 0 else "."), "en") for i in range(600)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(10**9, 1)], "doc_id long, toxic int")
    many = crowd(spark, base, 10**9)
    one = one_row_an_id(many.where(F.col("doc_id") == 10**9).withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")
    a, b = toxicity.fit(many, labels), toxicity.fit(base.unionByName(one.select("doc_id", "text", "lang")), labels)
    assert np.allclose(a.emission, b.emission, atol=1e-6) and np.allclose(a.text, b.text, atol=1e-6)


def test_pieces_of_a_long_text_are_few():
    texts = ["idiot said so. " * 20_000, "a calm river. " * 20_000, None, "", "idiot"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 0, 0, 1], pa.int32()), pa.array(texts)], ["toxic", "text"])
    words = next(toxicity.word_batches(pa.array(["idiot"])))[2]
    (lexicon,) = toxicity.word_features(words)[0:1]
    got = [b for b in toxicity._pieces(lexicon)(iter([batch]))]
    labels = [p for b in got for p in b.column("labels").to_pylist()]
    assert max(map(len, labels)) <= toxicity.PIECE
    assert sum(any(p) for p in labels) <= toxicity.PIECES + toxicity.MARKED + 1
    assert toxicity.MARKED <= len(labels) <= 2 * toxicity.PIECES + toxicity.MARKED + 1


# ---------------------------------------------------------------- plain versions

def plain_words(text):
    out, word = [], ""
    for c in f"{(text or '').lower()} ":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_grams(word, n):
    line = " " + word
    return [line[max(0, j - n + 1):j + 1] for j in range(1, len(line))]


def test_language_equals_a_plain_version(spark, docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    seen, holders = defaultdict(Counter), defaultdict(set)
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            for w in plain_words(r.text):
                seen[0, w][r.lang] += 1
                holders[w].add(r.doc_id)
                for n in range(1, 5):
                    for gram in plain_grams(w, n):
                        seen[n, gram][r.lang] += 1
    seen = {k: v for k, v in seen.items() if k[0] > 0 or len(holders[k[1]]) >= language.LEAST_TEXTS}
    names = sorted({x for v in seen.values() for x in v})
    totals, sizes = Counter(), Counter(n for n, _ in seen)
    for (n, _), v in seen.items():
        for x, c in v.items():
            totals[n, x] += c
    memory = {}

    def score(word):
        if word not in memory:
            def log(n, unit, x):
                return math.log((seen[n, unit][x] + 0.5) / (totals[n, x] + 0.5 * (sizes[n] + 1)))
            if (0, word) in seen:
                memory[word] = [log(0, word, x) for x in names]
            else:
                found = [next(((n, g[j]) for n, g in grams if (n, g[j]) in seen), None) for grams in [[(n, plain_grams(word, n)) for n in range(4, 0, -1)]] for j in range(len(word))]
                memory[word] = [sum(log(*f, x) for f in found if f) / len(word) for x in names]
        return memory[word]

    for r in rows[::7]:
        r = r.asDict() | {"sums": np.sum([score(w) for w in plain_words(r.text)] or [[0.0] * len(names)], axis=0)}
        memory["", r["doc_id"]] = (names[int(np.argmax(r["sums"]))] if plain_words(r["text"]) else "und", r["sums"])
    for r in language.language_report(docs).collect():
        want = memory.get(("", r.doc_id))
        if want and want[0] != "und":
            share = 1 / np.exp(want[1] - want[1].max()).sum()
            assert r.lang_pred == want[0] and math.isclose(r.score, share, rel_tol=1e-6)


def plain_mixed(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * factor % 2**64
    return h ^ (h >> 33)


def plain_hash(word):
    h = sum((b + 1) * pow(BASE, i, 2**64) for i, b in enumerate(word.lower())) % 2**64
    return plain_mixed((h + len(word) * 0xD6E8FEB86659FD93) % 2**64)


def plain_flags(text):
    """Of each word: the word, and its flags in order."""
    out, before = [], None
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        capitals = sum(65 <= b <= 90 for b in w)
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w)
        inner = len(w) - letters - (w[-1:] in [bytes([b]) for b in b".,;:!?)\"'"])
        out.append((w, [
            inner <= 0 and letters > 0 and capitals <= 1, capitals >= 2 and capitals * 2 > letters, any(b in b"#$%&*+/<=>@[\\]^_`{|}~" for b in w),
            letters == 0, w.endswith(b"!!"), before is not None and before.lower() == w.lower(), w[-1:] in (b".", b"!", b"?"),
            w.lower() not in {o[0].lower() for o in out},
        ]))
        before = w
    return out


def plain_vote(flags):
    n = len(flags)
    plain, capitals, symbols, bare, exclaimed, stutter, ends, new = (sum(f[1][i] for f in flags) / max(n, 1) for i in range(8))
    expected = min(0.3, 6 / math.sqrt(max(n, 1)))

    def vote(bad, good, least):
        return quality.NONE if n < least else quality.BAD if bad else quality.GOOD if good else quality.NONE

    return [
        vote(plain < 0.6, plain > 0.9, 3), vote(capitals > 0.3, capitals < 0.05, 3), vote(symbols > 0.2, symbols < 0.03, 3), vote(bare > 0.2, bare < 0.03, 3),
        vote(exclaimed > 0.2, exclaimed < 0.02, 3), vote(stutter > 0.25, stutter < 0.03, 5), vote(new < expected / 2, new > expected, 12),
        vote(ends > 0.6 or ends < 0.005, 0.02 < ends < 0.35, 30),
    ]


def plain_score(flags, weights):
    total = 0.0
    rows = [(w, f) for w, f in flags] + [(None, [True, False, False, False, False, False, False, True])] * max(0, quality.SHORT - len(flags))
    for w, f in rows:
        marks = [sum(v << i for i, v in enumerate(f)), *(v + 1000 + 2 * i for i, v in enumerate(f))]
        total += sum(weights[plain_mixed((m * 31 + 7) % 2**64) % quality.DIMENSIONS] for m in marks)
        total += weights[plain_hash(w) % quality.DIMENSIONS] if w is not None else 0
    return 1 / (1 + math.exp(-(total / len(rows) + weights[-1])))


ODD = ["", None, "!", "!! !!", "wow!!", "!", "NO NO no no NO", "# $ % & x", "ü É ñ.", "one", "a " * 40, "Alpha beta. Gamma delta! " * 12, "x#1 y_2 <b> z"]


def test_quality_equals_a_plain_version(spark, docs):
    """Votes, beliefs and scores, text by text and word by word; texts next to each other don't touch."""
    texts = [r.text for r in docs.select("text").limit(150).collect()] + ODD
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    flags = [plain_flags(t) for t in texts]
    voted = {int(r.key): r.pattern for r in table.select(F.col("doc_id").cast("string").alias("key"), "text").mapInArrow(quality._vote_rows, "key string, pattern int").collect()}
    votes = [plain_vote(f) for f in flags]
    assert [voted[i] for i in range(len(texts))] == [sum(v * 3**j for j, v in enumerate(vote)) for vote in votes]

    belief = [1 / (1 + math.exp(-(0.7 * v.count(quality.GOOD) - 3.0 * v.count(quality.BAD) + 1))) for v in votes]
    for _ in range(quality.ROUNDS):
        logs = [[0.0, 0.0] for _ in votes]
        for y in (0, 1):
            mass = [b if y else 1 - b for b in belief]
            told = [[1 + sum(m for m, v in zip(mass, votes) if v[j] == k) for k in range(3)] for j in range(8)]
            for i, v in enumerate(votes):
                logs[i][y] = math.log(sum(mass) + 1) + sum(math.log(told[j][v[j]] / sum(told[j])) for j in range(8))
        belief = [1 / (1 + math.exp(min(50, max(-50, a - b)))) for a, b in logs]
    kinds, counts = np.unique([voted[i] for i in range(len(texts))], return_counts=True)
    got = dict(zip(kinds.tolist(), quality.accuracies(kinds, counts.astype(float))))
    assert np.allclose([got[voted[i]] for i in range(len(texts))], belief, atol=1e-9)

    weights = quality.fit(table)
    scored = {r.doc_id: (r.score, r.n_words) for r in quality.score(table, weights).collect()}
    for i, f in enumerate(flags):
        assert scored[i][1] == len(f) and math.isclose(scored[i][0], plain_score(f, weights.astype(float)), abs_tol=1e-5)


# ---------------------------------------------------------------- ranked search in small tables

def test_search_with_tables_of_any_size(monkeypatch):
    """How many documents are ranked at a time changes nothing."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 300) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (_, _, words), = lexical.term_batches(pa.array([" ".join(f"t{x}" for x in rng.integers(0, 300, 8)) for _ in range(30)]))
    seen = lexical.occurrences(words)
    terms, term = np.unique(seen.hashes, return_inverse=True)
    items = lexical.Items(pa.array([f"i{i}" for i in range(30)]), terms, term, seen.tf, seen.first[:-1])
    counts = lexical.Counts(400, 9_000, rng.integers(1, 90, len(terms)))
    results = []
    for table in (1, 50, 3_000, 1 << 21):
        monkeypatch.setattr(lexical, "TABLE", table)
        rows = [r for b in lexical._rank(SimpleNamespace(value=items), counts, 5)(iter([batch])) for r in b.to_pylist()]
        results.append(sorted(map(repr, rows)))
    assert results[0] and all(r == results[0] for r in results)
