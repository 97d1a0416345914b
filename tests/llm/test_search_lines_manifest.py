"""Ranked search, line dedup and manifests against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scangrove.llm import lexical, line_dedup, merkle

DOCS = "doc_id bigint, text string, item_id string, rank int, keys string, _group string, place string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "k", "g", "p") for i, t in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- ranked search

def plain_terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_search(documents, items, k):
    texts = [(i, Counter(plain_terms(t))) for i, t in documents]
    n_docs, n_terms = sum(1 for _, c in texts if c), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        query = sum((Counter(plain_terms(t)) for t in {t for i, t in items if i == item}), Counter())
        scored = []
        for doc, c in texts:
            m = 25 + 75 * c.total() * n_docs // max(1, n_terms)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, n in query.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "a1b", "x"]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.choice([1, 3, 20, 300])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "?!"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (3, rows[3][1]), (7, "w1"), (-5, "w1"), (9, "w1")]
    items = [(f"i{j}", " ".join(rng.choices([*words, "absent"], k=rng.choice([1, 4, 30])))) for j in range(25)]
    items += [("i0", items[0][1]), ("i1", "w5 w5 w5"), (None, "w1 W1"), ("none", None), ("odd", "***"), ("unknown", "nowhere")]
    table = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id string, text string, doc_id int")
    want = sorted(plain_search(rows, items, 4), key=repr)
    assert found(lexical.search(docs(spark, rows), table, 4)) == want
    # Many small blocks of items, and a table in which every document is a chunk of its own.
    assert found(lexical.search(docs(spark, rows), table, 4, block=40)) == want


def test_search_of_many_equal_documents(spark):
    """Ties by id among thousands of equal rows, and a very long text."""
    rows = [(i, "alpha beta gamma") for i in range(3000)] + [(5000, "alpha " * 40_000 + "beta"), (5001, "delta " * 10)] + [(i, "omega") for i in range(6000, 9500)]
    items = spark.createDataFrame([("a", "alpha beta"), ("d", "delta")], "item_id string, text string")
    got = found(lexical.search(docs(spark, rows), items, 10))
    assert got == sorted(plain_search(rows, [("a", "alpha beta"), ("d", "delta")], 10), key=repr)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == "a" and r[2] != 5000][:9] == list(range(9))


def test_search_of_nothing(spark):
    items = spark.createDataFrame([("a", "alpha")], "item_id string, text string")
    assert found(lexical.search(docs(spark, []), items)) == []
    assert found(lexical.search(docs(spark, [(1, None)]), items)) == []
    assert found(lexical.search(docs(spark, [(1, "alpha")]), items.where("false"))) == []


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(5)
    column = pa.array([" ".join(f"t{x}" for x in rng.zipf(1.3, rng.integers(1, 400)) % 5000) for _ in range(80)])
    (_, _, words), = lexical.term_batches(column)
    seen = lexical.occurrences(words)
    counts = lexical.Counts(80, len(words.hashes), np.zeros(0))
    impact = lexical.impacts(seen, counts)
    sketches = lexical.Sketches(seen, impact)
    terms = np.unique(np.concatenate([seen.hashes[::7], rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    bounds = sketches.look_up(np.arange(80), terms)
    exact = np.stack([lexical.exact_scores(seen, impact, np.arange(80), terms[i:i + 1], np.ones(1, np.int64)) for i in range(len(terms))], axis=1)
    assert (bounds >= exact).all()
    # Most coordinates of absent terms are empty, so a bound is worth something.
    assert (bounds[exact == 0] == 0).mean() > 0.7


# ---------------------------------------------------------------- lines

def plain_key(line):
    key = line.strip("\x20\t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def plain_line_dedup(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(plain_key(line)) >= 20:
                holders[plain_key(line)].add(doc)
    keeper = {k: max(d for d in ids if d is not None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if keeper.get(plain_key(line), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_table():
    rng = random.Random(11)
    pool = [f"{'Repeated' if i % 2 else 'repeated'} line number {i} é" for i in range(30)] + ["x" * 19, "é" * 19, "é" * 20, " " + "y" * 19]
    ends = ["", " ", "\t", "\r", "\x0b\x0c "]
    rows = [(i, "\n".join(rng.choice(ends) + rng.choice([line.upper(), line]) + rng.choice(ends) for line in rng.choices(pool, k=rng.choice([0, 1, 5, 30]))))
            for i in range(60)]
    rows += [(i, f"only here {i} and nowhere else\n" * 3 + "a line of two documents only") for i in (100, 101)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, pool[0]), (None, pool[1] + "\n" + pool[0]), rows[5], rows[5], (7, pool[2])]
    # Repeats inside one document, and copies of one id, are one document.
    return rows + [(300, "said thrice by one document\n" * 3), (301, "said by one id in copies"), (301, "said by one id in copies"), (301, "said by one id in copies")]


@pytest.mark.parametrize("max_bits", [line_dedup.MAX_BITS, 1 << 10])
def test_line_dedup_equals_brute_force(spark, max_bits):
    """Also with a filter that is full, so that nearly every key is suspected."""
    rows = lines_table()
    got = line_dedup.without_repeated_lines(docs(spark, rows), max_bits=max_bits).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_line_dedup(rows)


def test_line_of_a_third_of_all_rows(spark):
    rows = [(i, f"This is a very common line\nunique text number {i}") for i in range(9000)]
    got = line_dedup.without_repeated_lines(docs(spark, rows)).groupBy("n_lines", "n_dropped").agg(F.count("*"), F.max("doc_id")).collect()
    assert sorted(tuple(r) for r in got) == [(2, 0, 1, 8999), (2, 1, 8999, 8998)]


def test_line_dedup_of_nothing_and_long_lines(spark):
    assert line_dedup.without_repeated_lines(docs(spark, [])).collect() == []
    rows = [(i, "z" * 300_000 + "\nshort\n" + "w" * i) for i in range(4)]
    got = line_dedup.line_dedup_report(docs(spark, rows))
    assert sorted(map(tuple, got.collect())) == plain_line_dedup(rows)


def test_filters_find_every_repeat(spark):
    """No key of two documents is missed, however the documents are dealt; few others are suspected."""
    rows = [(i, f"line of its own, number {i}\nline of a pair, number {i // 2}") for i in range(4000)]
    bits = 1 << 20
    twice = line_dedup.seen_twice(docs(spark, rows), bits)
    def hit(line):
        halves = line_dedup._halves([line_dedup.line_key(line.encode(), 20)])
        places = line_dedup.bit_places(halves, bits)[0].astype(int)
        return all(twice[p >> 3] >> (p & 7) & 1 for p in places)
    assert all(hit(f"line of a pair, number {i}") for i in range(2000))
    assert sum(hit(f"line of its own, number {i}") for i in range(4000)) < 40


# ---------------------------------------------------------------- manifests

SOURCE = "doc_id bigint, source string, lang string, n_chars bigint, text string, place string, root string, _n string, leaf string"


def plain_leaf(row):
    return sha256(b"".join(b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in row)).hexdigest()


def plain_levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha256("".join(nodes[i:i + 8]).encode()).hexdigest() for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def plain_siblings(levels, place):
    out = []
    for level in levels[:-1]:
        run = place - place % 8
        out.append((level[run:place], level[place + 1:run + 8]))
        place //= 8
    return out


def plain_crc(i):
    import zlib
    return zlib.crc32(str(i).encode())


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    roof = plain_levels([trees[g][-1][0] for g in names])
    out = []
    for t, g in enumerate(names):
        for place, (_, _, digest, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            siblings = plain_siblings(trees[g], place) + plain_siblings(roof, t)
            shown = row
            if row[0] is not None and plain_crc(row[0]) % 3 == 0 and row[4] is not None:
                shown = (*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]))
            node = plain_leaf(shown)
            for left, right in siblings:
                node = sha256("".join([*left, node, *right]).encode()).hexdigest()
            proof = sha256("".join("".join(left + right) for left, right in siblings).encode()).hexdigest()
            out.append((row[0], digest, trees[g][-1][0], roof[-1][0], proof, node, node == roof[-1][0]))
    return sorted(out, key=repr)


def check_manifest(spark, rows):
    table = spark.createDataFrame([(*r, "p", "r", "n", "l") for r in rows], SOURCE).repartition(5)
    got = merkle.manifest_report(table)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(2)
    ids = [*range(40), *range(65530, 65550), *rng.sample(range(1 << 40), 60), -1, -70000, -(1 << 63), (1 << 63) - 1]
    rows = [(i, rng.choice(["s", None, "Quelle ü"]), rng.choice(["de", "en", "en", None, "", "é", "z"]), rng.choice([None, i & 1023]), f"Text {i} É") for i in ids]
    rows += [(50, "s", "en", 1, None), (51, None, "en", None, ""), (52, "s", "alone", 1, "A" * 100_000)]
    # No id; one id with different texts; equal rows.
    rows += [(None, "s", "en", 1, f"none {i}") for i in range(5)] + [(None, "s", None, 1, "none")] * 3
    rows += [(7, "s", "en", 1, f"Other {i % 3}") for i in range(9)] + [rows[0]] * 4
    check_manifest(spark, rows)


def test_manifest_of_many_rows(spark):
    """More leaves than two blocks hold, in a group with one language next to a lone one."""
    rows = [(i * 3, "s", "en", i, f"Text {i}") for i in range(8200)] + [(1, "s", "fr", 1, "Seul")]
    check_manifest(spark, rows)


def test_manifest_of_little(spark):
    check_manifest(spark, [])
    check_manifest(spark, [(3, None, None, None, None)])
    check_manifest(spark, [(3, "a", "en", 1, "x"), (4, "a", "en", 1, "y")])


def test_container_of_a_repeated_row(spark):
    """One id with more rows than a container has ids: its container is dealt over cells, and every copy has its own place."""
    ids = spark.range(70_000).select(F.lit(5).cast("bigint").alias("_id")).union(spark.range(10).toDF("_id"))
    rows = ids.select(F.lit("g").alias("_group"), "_id", F.sha2(F.col("_id").cast("string"), 256).alias("_leaf"), F.monotonically_increasing_id().alias("_row"))
    from scangrove.session import stored
    got = merkle.placed(stored(rows, "rows")).groupBy("_id").agg(F.count("*"), F.count_distinct("_place"), F.min("_place"), F.max("_place"))
    want = {i: (1, 1, i, i) if i < 5 else (1, 1, i + 70_000, i + 70_000) for i in range(10)} | {5: (70_001, 70_001, 5, 70_005)}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_ranks():
    rng = np.random.default_rng(1)
    for size in (1, 50, merkle.DENSE - 1, merkle.DENSE, 3000, merkle.SPAN):
        lows = np.sort(rng.choice(merkle.SPAN, size, replace=False))
        counts = np.where(rng.random(size) < 0.1, rng.integers(2, 9, size), 1)
        ids, again, extra, rows = merkle._container(lows, counts)
        assert rows == counts.sum() and (merkle._lows(ids) == lows).all() and len(ids) <= merkle.SPAN // 8
        ranks = merkle.Ranks(ids, again, extra)
        assert (ranks.before(lows) == np.cumsum(counts) - counts).all() and (ranks.repeats(lows) == counts - 1).all()


def test_fold_rejects_another_leaf():
    leaves = [sha256(bytes([i])).hexdigest() for i in range(20)]
    tree = merkle.climb(leaves, 2)
    for place in range(20):
        proof = "".join("".join(left + right) for left, right in plain_siblings(tree, place))
        assert merkle.fold(leaves[place], place, 20, 0, 1, proof) == tree[-1][0]
        assert merkle.fold(leaves[place - 1], place, 20, 0, 1, proof) != tree[-1][0]
