"""Operators for training corpora: brute-force versions on small tables, and edge cases of every operator and stage."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from check_queries import connect, difference
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from scangrove.llm import contamination, language, markov, mixing, near_dedup, neighbours, pii, quality, queries, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, spans string, copies string, row string, gone long"
LONG = " ".join(f"word{i} goes on." for i in range(20_000))
ROWS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n", "en", None), (4, "one two", "en", "b"), (4, "one two", "en", "b"), (5, "one two", None, "b"), (None, "three four five six seven eight", "de", "b"),
    (6, LONG, "en", "a"), (7, LONG + " tail", "en", "a"), (8, "Write to jo@x.org or +44 (20) 7946-0958, stupid.", "en", None), (9, "ü é 1.2.3.4 \u2028 end", "fr", "c"), (10, "!!! ### |", None, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 7, "s", "p", "c", "r", 1) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


def test_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(queries.ORACLES) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert difference(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])[0] is None


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def plain_components(rows):
    sets, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_duplicates_of_a_diffuse_group(spark):
    """Copies of one text with ever more words replaced: some links exist only between texts that are not the group's first."""
    rng, base, rows = random.Random(3), [f"w{i}" for i in range(80)], []
    for i in range(120):
        text = list(base)
        for k in rng.sample(range(80), rng.randint(0, 6)):
            text[k] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_components(rows)


def test_links_in_bands(spark):
    a, b = " ".join(map(str, range(40))), " ".join(map(str, range(1, 41)))
    texts = spark.createDataFrame([(1, a), (2, b), (3, "else " + a[:20])], "id long, text string")
    few, rest = (spark.createDataFrame([(9, i, i) for i in ids], "band long, id long, id_label long") for ids in ([2, 3], [1, 2, 3]))
    assert [tuple(r) for r in near_dedup.links_in_bands(few, rest, texts).collect()] == [(2, 1)]


def test_near_duplicates_edges(odd):
    found = {(r.doc_id, r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (None, None, 2)} <= found
    assert {r[1] for r in found if r[0] in (6, 7)} == {6}
    kept = near_dedup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 8, 9, 10]


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    a, b = near_dedup._coefficients()
    common, only = rng.integers(0, 1 << 63, 600, np.uint64), rng.integers(0, 1 << 63, 200, np.uint64)
    x, y = (near_dedup.minima(np.concatenate([common, part]), a, b) for part in (only[:100], only[100:]))
    equal = ((x ^ y) & 3 == 0).mean()
    assert abs((equal - 0.25) / 0.75 - 0.75) < 0.12


def test_language(spark, docs, odd):
    found = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(r.lang_pred == "und" and r.score == 0 for r in language.language_report(odd).collect() if r.doc_id in (1, 2, 3, 10))
    assert {r.lang_pred for r in language.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).limit(5).collect()} == {"und"}


def test_language_backs_off():
    known = np.sort(np.array([5], np.uint64))
    model = language.Model(["a", "b"], (known, np.zeros((1, 2))), {n: (known[:0], np.zeros((0, 2))) for n in range(1, 5)})
    assert language.predict_texts(["xyz", ""], model, language.letter_table()) [0] == ["a", "und"]


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.quality_report(docs).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in found]) > 0.9


def test_accuracies_find_the_better_class():
    patterns = np.array([quality.pattern_of(np.full((1, 8), v))[0] for v in (quality.BAD, quality.GOOD)])
    assert (quality.accuracies(patterns, np.array([10.0, 90.0])) > 0.5).tolist() == [False, True]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(10, 16))
    x = centre[rng.integers(0, 10, 600)] + 0.5 * rng.normal(size=(600, 16))
    x[100:140] = x[0]   # ties
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(1000, None, "z"), (1020, [0.0] * 16, "z"), (1040, [float("nan")] * 16, "z"), (1060, [None] * 16, "z"), (None, x[0].tolist(), "z")]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")).collect()
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        want = sorted((-float((x[i] * x[q]).sum()), i) for i in range(600) if i != q)[:20]
        assert [r.rank for r in mine] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in want})
    assert hits / 600 >= 0.9
    tied = [r.vec_id for r in sorted((r for r in found if r.query_id == 0), key=lambda r: r.rank) if 100 <= r.vec_id < 140]
    assert tied and tied == list(range(100, 100 + len(tied)))
    assert neighbours.nearest(spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")).count() == 0


def recall(spark, x):
    """The share of the true neighbours found, and the least of a query."""
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in range(0, len(x), 20):
        order = np.argsort(-(x @ x[q]), kind="stable")
        shares.append(len(found[q] & set(order[order != q][:20].tolist())) / 20)
    return np.mean(shares), min(shares)


@pytest.mark.parametrize("kind", ["outlier", "lognormal", "blocks"])
def test_neighbours_of_different_lengths(spark, kind, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4_000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    if kind == "outlier":
        x[7] *= 10
    else:
        x *= rng.lognormal(0, 1, (len(x), 1))
    if kind == "blocks":
        monkeypatch.setattr(neighbours, "BLOCK", 700)
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", 64)
        monkeypatch.setattr(neighbours, "FEW", 256)
    mean, least = recall(spark, x)
    print(kind, mean, least)
    assert mean >= 0.93 and least >= 0.6


@pytest.mark.parametrize("n", [2, 5, 24, 25, 30])
def test_neighbours_in_small_blocks(n):
    """Each vector and its opposite: some stand outside of every window."""
    rng = np.random.default_rng(n)
    for _ in range(10):
        x = rng.normal(size=(n, 8))
        x[1] = -x[0]
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        found = neighbours.search_block(np.arange(n), x, np.arange(n), x, 1.0, 20)
        assert len(found) == n * min(20, n - 1)


def test_marginals_against_all_paths():
    rng = np.random.default_rng(5)
    field = toxicity.Field(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    emission, first = rng.normal(size=9), np.array([0, 4, 5, 9])
    found, pairs = toxicity.marginals(emission, first, field)
    seen = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = [tuple(int(c) for c in np.binary_repr(k, b - a)) for k in range(2 ** (b - a))]
        weight = np.exp([field.start[p[0]] + sum(emission[a + t] * s for t, s in enumerate(p)) + sum(field.transition[s, u] for s, u in zip(p, p[1:])) for p in paths])
        weight /= weight.sum()
        for t in range(b - a):
            assert math.isclose(found[a + t], sum(w for w, p in zip(weight, paths, strict=True) if p[t]), rel_tol=1e-9)
        for w, p in zip(weight, paths, strict=True):
            for s, u in zip(p, p[1:]):
                seen[s, u] += w
    assert np.allclose(pairs, seen)


def test_toxicity(spark, odd):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["tree", "house", "river", "stone", "cloud"]) for _ in range(30)) + (" you Idiot." if i % 4 == 0 else ".")) for i in range(1200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity_report(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in found if r.held_out)
    field = toxicity.fit(docs, labels)
    spans = toxicity.tag(spark.createDataFrame([(1, "  ü tree\nyou idiot! stone")], "doc_id long, text string"), field).first().spans
    assert [(s.start, s.end) for s in spans][-1] == (13, 19)
    assert toxicity.toxicity_report(odd, labels.limit(0)).where("predicted = 0").count() == len(ROWS)


def test_pii(spark, odd):
    text = "call +49 (30) 1234-5678, a@b.c@d.ef, 1.2.3.4.5 9.9.9.256 iban GB82 WEST 1234 5698 7654 32 or GB83WEST12345698765432, 4111-1111-1111-1111, 4111111111111112"
    row = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.n_iban) == (1, 1, 1, 1, 1)
    assert [text[int(s.split(":")[1]):int(s.split(":")[2])] for s in row.spans.split(",")] == ["a@b.c", "1.2.3.4", "4111-1111-1111-1111", "+49 (30) 1234-5678", "GB82 WEST 1234 5698 7654 32"]
    found = pii.without_pii(odd)
    assert found.columns == odd.columns
    assert found.where("doc_id = 8").first().text == "Write to <email> or <phone>, stupid."
    assert found.where("doc_id = 1").first().text is None and found.where("doc_id = 6").first().text == LONG
    many = spark.createDataFrame([(1, "a@b.cc " * 2_000)], "doc_id long, text string")
    assert pii.pii_report(many).first().spans.endswith(f"email:{7 * 1999}:{7 * 1999 + 6}")


def test_account_numbers_before_and_after_other_words(spark):
    gb, de, other = "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "ZZ33 1234 5678 9012 345"   # no country has the last one's code
    cases = [
        (f"{gb} PLEASETRANSFERNOW", [gb]), (f"{gb} BIC NWBKGB2L", [gb]), ("DE89370400440532013000 BANK", ["DE89370400440532013000"]), (f"{de} 2024", [de]),
        (f"AB13 {gb} {de} A1", [gb, de]), (f"\U0001f600 {de}", [de]), (f"{gb}X {gb[:-1]} x{gb}", []), (f"NO9386011117947 {gb}", ["NO9386011117947", gb]), (other, [other]),
        (f"{gb} " * 300, [gb] * 300),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.pii_report(docs).collect():
        text, want = cases[r.doc_id]
        assert [text[int(s.split(":")[1]):int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("iban")] == want
    assert [r.text for r in pii.without_pii(docs).where("doc_id in (1, 3, 4)").orderBy("doc_id").collect()] == ["<iban> BIC NWBKGB2L", "<iban> 2024", "AB13 <iban> <iban> A1"]


def test_leaks(spark, odd):
    rng = random.Random(6)
    item = [f"q{i}" for i in range(40)]
    changed = [w if i % 6 else "other" for i, w in enumerate(item)]
    filler = lambda n: [f"f{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = [(1, filler(30) + item + filler(9)), (2, filler(3) + changed), (3, filler(80)), (4, item[:8] + filler(50)), (5, item[10:30]), (6, ["short", "item", "of", "five", "words"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "one two"), (4, "short item of five words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination.leaks(docs, bench).collect()} == {(1, 1), (2, 1), (5, 1), (6, 4)}
    assert sorted(r.doc_id for r in contamination.without_leaks(docs, bench).collect()) == [3, 4]
    assert contamination.without_leaks(odd, bench).columns == odd.columns
    assert contamination.leaks(odd, bench.limit(0)).count() == 0
    old, contamination.BLOCK_WORDS = contamination.BLOCK_WORDS, 20
    try:
        assert {r.doc_id for r in contamination.leaks(docs, bench).collect()} == {1, 2, 5, 6}
    finally:
        contamination.BLOCK_WORDS = old


def test_overlap_against_all_segments():
    rng = np.random.default_rng(7)
    for n in (1, 5, 20, 60):
        for _ in range(100):
            equal, least = rng.random(n) < rng.uniform(0.5, 1), int(rng.integers(1, 13))
            fit = [(b - a, -a) for a in range(n) for b in range(a + 1, n + 1) if equal[a] and equal[b - 1] and equal[a:b].sum() >= max(least, 0.75 * (b - a))]
            a, b = contamination.overlap(equal, least)
            assert (b - a, -a) == max(fit, default=(0, 0))


def test_leaks_with_a_segment_that_qualifies(spark):
    """The best-scoring segment has too small a share of equal words, parts of it do not."""
    item = [f"q{i}" for i in range(216)]
    changed = [w if i % 17 < 12 else f"x{i}" for i, w in enumerate(item)]
    docs, bench = (spark.createDataFrame([(1, " ".join(w))], f"{c} long, text string") for c, w in (("doc_id", changed), ("item_id", item)))
    row = contamination.leaks(docs, bench).first()
    assert row.n_equal >= 12 and row.n_equal >= 0.75 * row.n_words
    assert contamination.without_leaks(docs, bench).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([0, 10], [3, 1], 15) == [0, 15]
    rng = np.random.default_rng(7)
    p, size = rng.uniform(0.1, 0.9, 500), rng.integers(1, 900, 500).astype(float)
    flown = mixing.flight(p, size, rng.uniform(size=500))
    assert math.isclose(flown.sum(), p.sum(), abs_tol=1e-6) and math.isclose(flown @ size, p @ size, rel_tol=1e-9)
    assert ((flown > 0) & (flown < 1)).sum() <= 2


def test_mixture(docs, odd):
    rows = mixing.mixture_report(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture_report(docs.repartition(5)).collect()))
    assert all(r.taken <= 2 * r.size for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(t - target) <= 0.1 * target + 20 for (_, target), t in taken.items())
    old, mixing.GROUP = mixing.GROUP, 4   # several levels
    try:
        assert all(abs(sum(r.taken for r in mixing.mixture_report(docs).collect()) - sum(t for _, t in taken)) <= 0.2 * sum(t for _, t in taken) for _ in range(1))
    finally:
        mixing.GROUP = old
    found = mixing.mixed_documents(odd)
    assert found.columns == [*(c for c in odd.columns if c not in ("copies", "taken")), "copies", "taken"]
    assert all(r.size == len(words(t)) for r, t in zip(sorted(mixing.mixture_report(odd.where("doc_id > 5")).collect()), [r[1] for r in ROWS[7:]], strict=True))


def test_urls(spark):
    rows = [("http://a.net/x",), ("http://a.net",), ("https://EXAMPLE.net/en/1?x#y",), ("http://xexample.com/de/",), ("http://www.example.com/de/",), ("ftp://b.org/fr/",), (None,), ("",), ("nohost",), ("x://h?a/b",)]
    pages = spark.createDataFrame([(i, r[0], "h", "r") for i, r in enumerate(rows)], "page_id long, url string, html string, row string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][:3] == ("a.net", "", None) and got[2] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2] is None and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow") and got[9][:2] == ("h", "")
    assert got[6] == got[7] == ("", "", None, "block") and got[8][:3] == ("", "", None)
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_ratios_against_plain_counts(spark):
    rows = [("aab", 2, 0), ("abb", 1, 3), ("bbb", 0, 1)]
    counts = spark.createDataFrame([("^" + g, a, b) for g, a, b in rows], "gram string, allow long, block long")

    def chance(gram, k):
        p = 1 / len(urls.ALPHABET)
        for n in range(1, 5):
            end = gram[4 - n:]
            inside = Counter()
            for g, *c in rows:
                if ("^" + g)[4 - n:-1] == end[:-1]:
                    inside[g[-1]] += c[k]
            if total := sum(inside.values()):
                kinds = sum(v > 0 for v in inside.values())
                p = (inside[end[-1]] + kinds * p) / (total + kinds)
        return p
    for r in urls.ratios(counts).collect():
        assert math.isclose(r.ratio, math.log(chance(r.gram, 0) / chance(r.gram, 1)), abs_tol=1e-9)


def test_language_model_base(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for t in train for w in words(t))
    n, d = sum(count.values()) + len(train), len(count) + 1
    old, markov.HEAD = markov.HEAD, 500   # most words go through the join
    try:
        found = {r.doc_id: r for r in markov.language_model_scores(docs).collect()}
    finally:
        markov.HEAD = old
    for i, t in rows:
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (d + 1))) for c in [*(count[w] for w in words(t)), len(train)])
        r = found[i]
        assert math.isclose(base, r.base_score, rel_tol=1e-9) and r.n_tokens == len(words(t)) + 1 and r.train_tokens == n
        assert r.n_known == sum(count[w] > 0 for w in words(t)) + 1
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_first_rounds_read_all_texts(spark, monkeypatch):
    """Each text has a symbol of its own, which the model knows after the rounds over parts."""
    monkeypatch.setattr(markov, "PART_TEXTS", 10)
    monkeypatch.setattr(markov, "ROUNDS", 0)
    n = 240
    lines = spark.createDataFrame([(i, np.array([i] * 50 + [markov.END], np.uint16).tobytes()) for i in range(n)], "doc_id long, symbols binary")
    emit = markov.baum_welch(lines, np.full(markov.SYMBOLS, 1 / markov.SYMBOLS), n).emit.sum(axis=1)
    assert emit[:n].min() > 1.5 * emit[n:markov.END].max()


def test_forward_against_all_paths():
    rng = np.random.default_rng(8)
    model = markov.Model(rng.dirichlet(np.ones(8)), rng.dirichlet(np.ones(8), 8), rng.dirichlet(np.ones(markov.SYMBOLS), 8).T)
    line = [3, 4000, 17]
    total = sum(
        model.start[a] * model.emit[line[0], a] * model.move[a, b] * model.emit[line[1], b] * model.move[b, c] * model.emit[line[2], c]
        for a in range(8) for b in range(8) for c in range(8))
    logs, _, _ = markov.forward(model, np.array([1, 1, 1]), np.arange(4), np.array(line, np.uint16), False)
    assert math.isclose(logs[0], math.log10(total), rel_tol=1e-9)


@pytest.mark.parametrize("report", [
    near_dedup.near_duplicates, language.language_report, quality.quality_report, pii.pii_report, mixing.mixture_report, markov.language_model_scores,
    lambda d: toxicity.toxicity_report(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).limit(0)), lambda d: contamination.leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")),
])
def test_odd_and_empty_tables(odd, report):
    assert report(odd.limit(0)).count() == 0
    assert report(odd).count() >= 5


def test_stages(spark, odd, docs):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.columns[:len(odd.columns) - 1] == [c for c in odd.columns if c != "copies"][:len(odd.columns) - 1] or out.columns == odd.columns
        out.count()
        assert stage(spark, odd.limit(0), SF).count() == 0
    found = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in found}
    assert len(ids) == len(found) and 0 < len(found) < docs.count()
    kept = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    leaked = {r.doc_id for r in contamination.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids <= kept - leaked


@pytest.mark.parametrize("n", [3, 100])
def test_rounds_do_not_depend_on_the_size(spark, n):
    """Few texts are learned in the same steps as many: each first round takes its twelfth, a part without texts changes nothing."""
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 300, 40), markov.END).astype(np.uint16) for _ in range(n)]
    lines = spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(texts)], "doc_id long, symbols binary")
    frequencies = np.full(markov.SYMBOLS, 1 / markov.SYMBOLS)
    got = markov.baum_welch(lines, frequencies, n)
    part_of = {r.doc_id: r.k for r in lines.select("doc_id", F.pmod(F.xxhash64(F.lit("markov"), "doc_id"), F.lit(12)).alias("k")).collect()}
    emit = frequencies[:, None] * np.random.default_rng(10).uniform(0.2, 1.8, (markov.SYMBOLS, 8))
    model = markov.Model(np.full(8, 1 / 8), np.full((8, 8), 0.1 / 8) + 0.9 * np.eye(8), emit / emit.sum(axis=0))
    blend = None
    for k in range(14):
        read = [t for i, t in enumerate(texts) if k >= 12 or part_of[i] == k]
        if not read:
            continue
        sums = [markov.expected(model, np.ones(len(t), int), np.arange(len(t) + 1), t) for t in read]
        flat = [sum(s[j] for s in sums) for j in range(3)]
        if k < 12:
            weight = (k + 1) ** -markov.FADE
            blend = flat = flat if blend is None else [(1 - weight) * b + weight * f for b, f in zip(blend, flat, strict=True)]
        start, move, emit = flat[0] + 0.1, flat[1] + 0.1, flat[2] + frequencies[:, None] * (50 + 0.02 * flat[2].sum(axis=0))
        model = markov.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    for mine, plain in zip(got, model, strict=True):
        assert np.allclose(mine, plain, rtol=1e-3, atol=1e-9)
