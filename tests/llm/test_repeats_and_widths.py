"""Repeated rows, repeated words, wide vectors, many languages and crowded bands."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from scangrove.llm import contamination, language, mixing, near_dedup, neighbours, toxicity

VECTORS = "vec_id long, embedding array<double>"


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("width", [64, 256, 768])
@pytest.mark.parametrize("spread", [0.0, 0.08])
def test_recall_of_windows_on_vectors_without_clusters(width, spread):
    """One block, searched by collisions: random directions, of equal lengths and of lengths within a range."""
    rng = np.random.default_rng(width)
    x = rng.normal(size=(3_000, width))
    x *= ((1 + spread * rng.uniform(-1, 1, len(x))) / np.sqrt((x * x).sum(axis=1)))[:, None]
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 50)
    found = {}
    for q, v, _ in neighbours.search_block(ids, x, asked, x[asked], float(np.sqrt((x * x).sum(axis=1)).max()), 20):
        found.setdefault(q, set()).add(v)
    shares = []
    for q in asked.tolist():
        order = np.argsort(-(x @ x[q]), kind="stable")
        shares.append(len(found[q] & set(order[order != q][:20].tolist())) / 20)
    print(width, spread, np.mean(shares), min(shares))
    assert np.mean(shares) >= 0.95


def test_repeated_queries_have_one_answer(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    again = rows + [rows[20]] * 3 + [rows[41]]
    plain, doubled = (answers(neighbours.nearest(spark.createDataFrame(r, VECTORS).repartition(3))) for r in (rows, again))
    assert plain[20] == [a for a in doubled[20] if a[1] != 41][:20] or [a[1] for a in doubled[20]].count(41) == 2
    assert all([r for r, _, _ in a] == list(range(1, 21)) for a in doubled.values())
    assert Counter(v for _, v, _ in doubled[20] if v != 41).most_common(1)[0][1] == 1
    # Of different vectors of one id the smallest one asks.
    odd = rows + [(20, [-100.0] * 8)]
    assert answers(neighbours.nearest(spark.createDataFrame(odd, VECTORS)))[20][0][2] == max(float(np.dot([-100.0] * 8, x[i])) for i in range(60) if i != 20)
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).collect() == []


def test_possible_partners_of_a_crowded_band(spark, monkeypatch):
    """Texts that share a band and may not link, with some that may: signatures are compared in cells, and only rows with a partner come out."""
    monkeypatch.setattr(near_dedup, "SIGN_CELL", 300)
    rng = np.random.default_rng(5)
    signs = rng.integers(-(1 << 63), 1 << 63, (1500, near_dedup.LONGS), np.int64)
    signs[700:720] = signs[:20]
    names = [f"sig{i}" for i in range(near_dedup.LONGS)]
    rows = [(1, i, i, 100, *map(int, s)) for i, s in enumerate(signs)]
    table = spark.createDataFrame(rows, "band long, id long, id_label long, n_shingles long, " + ", ".join(f"{n} long" for n in names))
    found = near_dedup.possible_partners(table.where("id < 600"), table).collect()
    x, y = table.where("id < 600").alias("x"), table.alias("y")
    pairs = x.join(y, (F.col("x.id_label") != F.col("y.id_label")) & near_dedup.may_link("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()
    assert {r.id for r in found if r.few} == {p.a for p in pairs} >= set(range(20))
    assert {r.id for r in found if not r.few} == {p.b for p in pairs} >= set(range(700, 720))


def test_many_equal_words_take_little_memory():
    words = np.full(6_000, 12345, np.uint64)
    import pyarrow as pa
    seeds = contamination.seeds_of(pa.table({"item_id": [1], "text": ["again " * 6_000]}))
    tracemalloc.start()
    best = contamination.overlaps(seeds.words[:6_000].copy(), seeds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best == [(0, 0, 6_000, 6_000)] and peak < 200 << 20
    assert contamination.overlaps(words, seeds) == []


def test_overlaps_against_all_alignments():
    """Few different words, so that seeds repeat: the best overlap of every item over the alignments that share a seed."""
    import pyarrow as pa
    rng = random.Random(9)
    for _ in range(25):
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        items = [" ".join(rng.choices(letters, k=rng.choice([5, 9, 14, 40]))) for _ in range(3)]
        seeds = contamination.seeds_of(pa.table({"item_id": [1, 2, 3], "text": items}))
        text = rng.choices(letters, k=rng.randint(5, 60)) + rng.choice(items).split()[:rng.randint(3, 40)] + rng.choices(letters, k=7)
        (_, _, doc), = contamination.word_batches(pa.array([" ".join(text)]))
        doc = doc.hashes
        want = {}
        for item in range(3):
            own = seeds.words[seeds.first[item]:seeds.first[item + 1]]
            for shift in range(-len(own), len(doc) + 1):
                lo, hi = max(0, -shift), min(len(own), len(doc) - shift)
                if hi <= lo:
                    continue
                equal = doc[lo + shift:hi + shift] == own[lo:hi]
                masks = contamination.MASKS if len(own) >= contamination.SPAN else ("1" * len(own),)
                if not any(all(equal[i + j] for j, c in enumerate(m) if c == "1") for m in masks for i in range(len(equal) - len(m) + 1)):
                    continue
                a, b = contamination.overlap(equal, int(np.ceil(min(contamination.LEAST_WORDS, 0.8 * len(own)))))
                if b > a and equal[a:b].sum() > want.get(item, (0, 0, 0, 0))[3]:
                    want[item] = (item, lo + a + shift, b - a, int(equal[a:b].sum()))
        assert sorted(contamination.overlaps(doc, seeds)) == sorted(want.values())


def test_mixture_of_equal_rows(spark):
    """A third of all rows are one repeated row; they are numbered, so no group of a flight gets them all."""
    rows = spark.range(12_000).select(
        F.when(F.col("id") < 4_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 6_000, "a").otherwise("b").alias("source"),
        F.when(F.col("id") < 4_000, "one two three").otherwise(F.repeat(F.lit("w "), (F.col("id") % 50).cast("int"))).alias("text"))
    old, mixing.GROUP = mixing.GROUP, 500
    try:
        first, second = (Counter(map(tuple, mixing.mix(df).collect())) for df in (rows, rows.repartition(7)))
    finally:
        mixing.GROUP = old
    assert first == second and first.total() == 12_000
    taken, wanted = Counter(), {}
    for (_, source, size, _, target, _, words), n in first.items():
        taken[source] += n * words
        wanted[source] = target
        assert words <= 2 * size
    assert all(abs(taken[s] - wanted[s]) <= 0.002 * wanted[s] + 60 for s in wanted)


def test_a_small_language_keeps_its_words(spark):
    """Fifty languages, one with far fewer texts: its words are known though others have more frequent ones."""
    rng = random.Random(2)
    rows = []
    for n in range(50):
        own = [f"{chr(97 + n % 26)}{chr(97 + n // 26)}{a}{b}" for a in "aeiou" for b in "bdfgk"]
        rows += [(1000 * n + i, " ".join(rng.choices(own, k=20)), f"l{n:02d}") for i in range(5 if n == 49 else 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, known_units=50 * 25)
    assert len(model.languages) == 50 and len(model.words[0]) <= 50 * 25
    small = model.words[1][:, 49] > np.log(3e-3)
    assert small.sum() >= 15
    found = language.predict(docs.where("lang = 'l49'"), model).collect()
    assert all(r.lang_pred == "l49" for r in found)


def test_toxic_spans_are_returned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    report = toxicity.toxicity_report(docs, labels)
    assert report.columns == ["doc_id", "held_out", "score", "predicted", "n_spans", "spans"]
    assert all(len(r.spans) == r.n_spans for r in report.collect())
