"""Near duplicates: b-bit MinHash signatures, band candidates, exact confirmation, connected components.

Texts with the same set of shingles collapse to one representative first.  Band buckets propose pairs; the packed low bits of
the minima estimate their similarity, corrected for chance collisions, and only pairs that may reach the threshold are confirmed
on full sets.  A bucket never emits all its pairs: first every member meets the bucket's smallest member, then only members of
different components meet, the minority of a bucket against the rest, in cells of bounded size from which only links come out.  What is
left out can't change a component.

A pair of similarity 0.75 shares none of the 40 bands of 5 minima with probability (1 - 0.75^5)^40 = 2e-5, and is then not proposed; one of 0.8
with 1e-7.  Texts of any length are read whole.  Ties can't occur: representatives, hubs and components go by the smallest id.  Columns other
than id and text are left aside by ``near_duplicates``, whatever their names, and carried along by ``without_near_duplicates``.

Nulls: a null or empty text has no shingles and no links; a row with a null id is kept and has no component.  Rows that share an id should share the text:
with different texts each row gets the component of its own text, and ``without_near_duplicates`` drops all of them if one is a copy.
Repeated rows give repeated result rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scangrove.llm.tokens import Words, mixed, picked, ragged, signed, word_batches
from scangrove.session import stored

WIDTH = 5                # words in a shingle
THRESHOLD = 0.75
BANDS, ROWS = 40, 5      # a pair of similarity 0.75 shares no band with probability 2e-5; see the docstring
BITS = 2                 # low bits kept of each minimum
HASHES = BANDS * ROWS
LONGS = -(-HASHES * BITS // 64)
CELL = 500               # texts of a band on either side that one task compares
SIGN_CELL = 4_000        # the same for signatures
MARGIN = 6               # standard deviations by which an estimate may fall short of the threshold


def shingle_sets(words: Words, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word sequences of each text; a shorter text is one sequence, an empty one has none."""
    h, n = words.hashes, len(words.hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = mixed(rolled * np.uint64(0x9FB21C651E98DF25) + h[k:k + len(rolled)])
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= width:
            yield np.unique(rolled[lo:hi - width + 1])
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for x in h[lo:hi]:
                whole = mixed(np.array([whole], np.uint64) * np.uint64(0xA0761D6478BD642F) + x)[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for lo in range(0, len(folded), 2048):
        np.minimum(low, (a[:, None] * folded[None, lo:lo + 2048] + b[:, None]).min(axis=1), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima of each row, packed into 64-bit integers."""
    per = 64 // BITS
    kept = np.zeros((len(low), LONGS * per), np.uint64)
    kept[:, :HASHES] = low & np.uint32((1 << BITS) - 1)
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(kept.reshape(len(low), LONGS, per) << shifts, axis=2)


def _sign(batches):
    a, b = _coefficients()
    band = np.arange(BANDS, dtype=np.uint64)[None, :]
    for batch in batches:
        for lo, hi, words in word_batches(batch.column("text")):
            sets = list(shingle_sets(words))
            low = np.stack([minima(s, a, b) for s in sets])
            keys = np.broadcast_to(band, (len(sets), BANDS))
            for k in range(ROWS):
                keys = mixed(keys * np.uint64(0x9FB21C651E98DF25) + low.reshape(len(sets), BANDS, ROWS)[:, :, k])
            longs = packed(low)
            prints = [np.array([mixed(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (0x1234567, 0x89ABCDEF0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(signed(p)) for p in prints),
                 *(pa.array(signed(np.ascontiguousarray(longs[:, i]))) for i in range(LONGS)),
                 ragged([signed(k) if len(s) else signed(k[:0]) for s, k in zip(sets, np.ascontiguousarray(keys), strict=True)], pa.int64())],
                ["id", "n_shingles", "print_a", "print_b", *(f"sig{i}" for i in range(LONGS)), "bands"],
            )


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_shingles, print_a and print_b (128 bits that stand for the set), packed signature, band keys."""
    longs = ", ".join(f"sig{i} long" for i in range(LONGS))
    return picked(docs, id=doc_id, text=text).select(F.col("id").cast("long"), "text").mapInArrow(
        _sign, f"id long, n_shingles long, print_a long, print_b long, {longs}, bands array<long>",
    )


def estimate(left: str, right: str) -> Column:
    """Similarity from the share of equal low bits, corrected for the share that agrees by chance."""
    lanes = int("01" * 32, 2)
    unequal = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{left}.sig{i}").bitwiseXOR(F.col(f"{right}.sig{i}"))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(lanes)))
    chance = 2.0 ** -BITS
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def _least_estimate() -> float:
    chance = 2.0 ** -BITS
    equal = THRESHOLD * (1 - chance) + chance
    return THRESHOLD - MARGIN * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def may_link(left: str, right: str) -> Column:
    """Pairs that the estimate and the set sizes leave possible."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (F.least(a, b) * 100 >= F.greatest(a, b) * 75) & (estimate(left, right) >= _least_estimate())


def _confirm(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, left, right = batch.slice(lo, 256), [], []
            for name, out in (("a", left), ("b", right)):
                # The text of a hub stands next to all of its partners; it is taken apart once.
                _, first, where = np.unique(part.column(name).to_numpy(), return_index=True, return_inverse=True)
                sets = [s for _, _, words in word_batches(part.column(f"text_{name}").take(pa.array(first))) for s in shingle_sets(words)]
                out.extend(sets[i] for i in where)
            good = []
            for x, y in zip(left, right, strict=True):
                common = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * common >= 75 * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; ``texts`` has id and text."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long").distinct()


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between texts of different components in a cell: for each text on the left the smallest partner in each component."""
    found: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        sets = []
        for side in (left, right):
            column = side.column("text").combine_chunks()
            sets.append([s for _, _, words in word_batches(column) for s in shingle_sets(words)])
        ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()
        sizes = np.array([len(s) for s in sets[1]])
        every, first = np.concatenate(sets[1]), np.append(0, np.cumsum(sizes))[:-1]
        for one, own, mine in zip(left.column("id").to_pylist(), left.column("label").to_pylist(), sets[0], strict=True):
            at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
            common = np.add.reduceat(mine[at] == every, first)
            linked = np.flatnonzero((100 * common >= 75 * (sizes + len(mine) - common)) & (labels != own))
            partners: dict[int, int] = {}
            for i in linked:
                partners[labels[i]] = min(ids[i], partners.get(labels[i], ids[i]))
            found += [(one, int(b)) for b in partners.values()]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _cells(few: DataFrame, rest: DataFrame, size: int):
    """Deals the rows of a band on both sides to cells of about ``size`` by ``size`` rows; each row meets all cells of the other side."""
    sizes = few.groupBy("band").agg(F.ceil(F.count("*") / size).cast("int").alias("n_few")).join(
        rest.groupBy("band").agg(F.ceil(F.count("*") / size).cast("int").alias("n_rest")), "band")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        cells = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))
        return rows.join(sizes, "band").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int")).withColumn(other, cells).drop("n_few", "n_rest")

    return dealt(few, "few", "rest"), dealt(rest, "rest", "few")


_SIGNS = ["id", "id_label", "n_shingles", *(f"sig{i}" for i in range(LONGS))]


def _who_may_link(left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of a cell with a possible partner of another component on the other side: band, id, id_label and the side."""
    out = {"band": [], "id": [], "id_label": [], "few": []}
    if left.num_rows and right.num_rows:
        (ids, label, n, *sig), (other_ids, other_label, other_n, *other_sig) = ([side.column(c).to_numpy() for c in _SIGNS] for side in (left, right))
        sig, other_sig = (np.stack(x, axis=1).view(np.uint64) for x in (sig, other_sig))
        hit, chance, least = np.zeros(len(other_ids), bool), 2.0 ** -BITS, _least_estimate()
        lanes = np.uint64(int("01" * 32, 2))
        for i in range(len(ids)):
            possible = np.flatnonzero((other_label != label[i]) & (np.minimum(other_n, n[i]) * 100 >= np.maximum(other_n, n[i]) * 75))
            x = other_sig[possible] ^ sig[i]
            unequal = np.bitwise_count((x | (x >> np.uint64(1))) & lanes).sum(axis=1, dtype=np.int64)
            near = possible[((1 - unequal / HASHES) - chance) / (1 - chance) >= least]
            if len(near):
                hit[near] = True
                out["id"].append(ids[i])
                out["id_label"].append(label[i])
        out["few"] = [True] * len(out["id"]) + [False] * int(hit.sum())
        out["id"] += other_ids[hit].tolist()
        out["id_label"] += other_label[hit].tolist()
        out["band"] = [left.column("band")[0].as_py()] * len(out["id"])
    return pa.table({c: pa.array(v, pa.bool_() if c == "few" else pa.int64()) for c, v in out.items()})


def possible_partners(few: DataFrame, rest: DataFrame) -> DataFrame:
    """band, id, id_label, few: the rows (band and signature) of either side that may link with one of another component on the other side."""
    cell = ["band", "_few", "_rest"]
    # Columns get names anew, as both sides may come from one table.
    left, right = (side.select("band", F.col("few").alias("_few"), F.col("rest").alias("_rest"), *_SIGNS).toDF(*cell, *_SIGNS) for side in _cells(few, rest, SIGN_CELL))
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_who_may_link, "band long, id long, id_label long, few boolean").distinct()


def links_in_bands(few: DataFrame, rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect different components, between texts (band, id, id_label) of ``few`` and ``rest`` that share a band.

    A band's texts meet in cells of about ``CELL`` by ``CELL`` texts; only links leave a cell, no pairs.
    """
    few, rest, cell = stored(few, "few"), stored(rest, "rest"), ["band", "few", "rest"]
    left, right = (
        side.join(texts, "id").select("band", "few", "rest", "id", "id_label", "text").toDF(*cell, "id", "label", "text").groupBy(*cell) for side in _cells(few, rest, CELL))
    return left.cogroup(right).applyInArrow(_meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame | None:
    """Per node of the edges (a, b): id and label, the smallest node that it reaches.  None without edges.

    Labels spread to neighbours and jump to their label's label until nothing changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select("id", F.least("id", "label").alias("label")), "labels")
    if labels.isEmpty():
        return None
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("beyond"))
        found = stored(hooked.join(jump, "next").select("id", F.least("next", "beyond").alias("label"), "old"), "labels")
        labels = found.select("id", "label")
        if found.where("label <> old").isEmpty():
            return labels


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Labels after further edges between nodes."""
    if labels is None:
        return components(edges)
    of = lambda column: F.coalesce(F.col(f"l{column}.label"), F.col(column)).alias(column)
    between = edges
    for column in ("a", "b"):
        between = between.join(labels.alias(f"l{column}"), F.col(column) == F.col(f"l{column}.id"), "left").select(
            *(of(c) if c == column else F.col(c) for c in ("a", "b")))
    more = components(between.where("a <> b"))
    if more is None:
        return labels
    known = labels.alias("l").join(more.alias("m"), F.col("l.label") == F.col("m.id"), "left").select("l.id", F.coalesce("m.label", "l.label").alias("label"))
    return stored(known.union(more.join(labels, "id", "left_anti").select("id", "label")), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links) and kept."""
    signed_rows = stored(signatures(docs, doc_id, text), "signatures")
    real = signed_rows.where("id IS NOT NULL AND n_shingles > 0")
    groups = stored(real.groupBy("print_a", "print_b").agg(F.min("id").alias("rep")), "same_sets")
    reps = real.join(groups, ["print_a", "print_b"]).where("id = rep")
    signs = reps.select("id", "n_shingles", *(f"sig{i}" for i in range(LONGS))).dropDuplicates(["id", "n_shingles", "sig0"])

    bands = reps.select("id", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
    shared = stored(bands.join(hubs, "band"), "shared_bands")
    texts = stored(
        picked(docs, id=doc_id, text=text).select(F.col("id").cast("long"), "text").join(shared.select("id").distinct(), "id", "left_semi"),
        "candidate_texts",
    )

    stars = shared.where("id <> hub").select("id", "hub").distinct().alias("p")
    stars = stars.join(signs.alias("x"), F.col("p.id") == F.col("x.id")).join(signs.alias("y"), F.col("p.hub") == F.col("y.id"))
    stars = stored(stars.where(may_link("x", "y")).select(F.col("p.id").alias("a"), F.col("p.hub").alias("b"), estimate("x", "y").alias("about")), "stars")
    # One pair a text first: the smallest partner that is surely near enough, or else the nearest.
    chosen = stars.groupBy("a").agg(F.min(F.when(F.col("about") >= 0.9, F.col("b"))).alias("sure"), F.max_by("b", "about").alias("best"))
    labels = components(confirmed(chosen.select("a", F.coalesce("sure", "best").alias("b")), texts))

    def labelled(rows: DataFrame, column: str) -> DataFrame:
        if labels is None:
            return rows.withColumn(f"{column}_label", F.col(column))
        named = labels.select(F.col("id").alias(column), F.col("label").alias("_label"))
        return rows.join(named, column, "left").withColumn(f"{column}_label", F.coalesce("_label", column)).drop("_label")

    rest = stored(labelled(labelled(stars, "a"), "b").where("a_label <> b_label").select("a", "b"), "other_stars")
    if not rest.isEmpty():
        labels = _merged(labels, confirmed(rest, texts))

    spots = labelled(shared, "id")
    mixes = spots.groupBy("band", "id_label").agg(F.count("*").alias("n")).groupBy("band").agg(
        F.count("*").alias("labels"), F.max_by("id_label", "n").alias("major"),
    ).where("labels > 1")
    spots = stored(spots.join(mixes.drop("labels"), "band").join(signs, "id"), "mixed_bands")
    if not spots.isEmpty():
        # Who has a possible partner in another component, each once, however many partners there are.
        few, rest = spots.where("id_label <> major AND id <> hub"), spots.where("id <> hub")
        partners = stored(possible_partners(few, rest), "partners")
        few, rest = (partners.where(side).select("band", "id", "id_label") for side in ("few", "NOT few"))
        labels = _merged(labels, links_in_bands(few, rest, texts))

    out = signed_rows.select("id", "n_shingles", "print_a", "print_b").alias("s").join(
        groups.alias("g"), (F.col("s.print_a") == F.col("g.print_a")) & (F.col("s.print_b") == F.col("g.print_b")) & (F.col("s.n_shingles") > 0), "left",
    ).select("s.id", "s.n_shingles", F.coalesce(F.when(F.col("s.id").isNotNull(), F.col("g.rep")), F.col("s.id")).alias("rep"))
    out = labelled(out, "rep")
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("rep_label").alias("component_id"),
        F.coalesce(F.col("id") == F.col("rep_label"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and rows without an id."""
    gone = near_duplicates(docs, doc_id, text).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["gone"], "left_anti")
