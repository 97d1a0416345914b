"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is a multiple of its size; each document is taken the whole part of that multiple, and once more with a
probability, its fractional part.  Which documents are taken once more is a sample balanced on words and documents: a flight
moves the probabilities of three documents at a time along the null space of both totals until one is 0 or 1.  Flights
run in groups of bounded size; what they leave open (two documents each) flies again, level by level, until a source's rest fits one
group, where the last two documents are settled.  No group grows with the input, and no text is shuffled.

Nulls: a null text has size 0; a null source is a source of its own, last in order.  Empty documents take nothing.  Equal rows (id, source
and size) are numbered and dealt like others; they get results that may differ, as a set always the same.  Texts of any length only count by
their words.  A table without words has targets of 0, an empty one gives no rows.  More than ``MAX_SOURCES`` sources are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangrove.llm.tokens import picked, word_count
from scangrove.session import stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
GROUP = 4_000            # documents that fly together
MAX_SOURCES = 100_000    # more are refused
PART = 10_000            # equal rows that are numbered together
TINY = 1e-9


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float = LIMIT) -> list[float]:
    """Shares of ``total`` by weight, none above ``limit`` times its size; the excess goes to the others by weight."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > limit * sizes[i]}
        for i in full or open_:
            out[i] = limit * sizes[i] if full else weights[i] * unit
        rest -= sum(out[i] for i in full or open_)
        open_ -= full or open_
    return out


def flight(chance: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after moves that keep their sum and their sum weighted by size, until fewer than three are open."""
    p, s, u = chance.tolist(), size.tolist(), draws.tolist()
    waiting: list[int] = []
    for i in range(len(p)):
        if not TINY < p[i] < 1 - TINY:
            p[i] = float(round(p[i]))
            continue
        waiting.append(i)
        if len(waiting) < 3:
            continue
        a, b, c = waiting
        # The direction that changes neither total; with equal sizes, two documents trade.
        v = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if not any(v):
            v = (1.0, -1.0, 0.0)
        up = min((1 - x) / y if y > 0 else x / -y for x, y in zip((p[a], p[b], p[c]), v, strict=True) if y)
        down = min(x / y if y > 0 else (1 - x) / -y for x, y in zip((p[a], p[b], p[c]), v, strict=True) if y)
        step = up if u[i] * (up + down) < down else -down
        for k, y in zip(waiting, v, strict=True):
            p[k] += step * y
            if not TINY < p[k] < 1 - TINY:
                p[k] = float(round(p[k]))
        waiting = [k for k in waiting if 0 < p[k] < 1]
    return np.array(p)


def landing(wanted: np.ndarray, chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the few documents left open, nearest to the words that ``wanted`` expects; then up to three documents change sides to come nearer."""
    out, open_ = chance.copy(), np.flatnonzero((chance > 0) & (chance < 1))
    if len(open_):
        choices = np.array(np.meshgrid(*[[0, 1]] * len(open_), indexing="ij")).reshape(len(open_), -1).T
        words, count = choices @ size[open_] - chance[open_] @ size[open_], choices.sum(axis=1) - chance[open_].sum()
        out[open_] = choices[np.lexsort((np.abs(count), np.abs(words)))[0]]
    for _ in range(3 * bool(len(out))):
        missing = float(wanted @ size - out @ size)
        after = np.abs(missing - np.where(out == 0, size, -size))
        if after.min() >= abs(missing):
            break
        out[after.argmin()] = 1 - out[after.argmin()]
    return out


def _fly(last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("order", "doc_id", "size", "copy")])
        chance, size = table.column("chance").to_numpy(), table.column("size").to_numpy().astype(float)
        p = flight(chance, size, table.column("draw").to_numpy())
        if last:
            p = landing(chance, p, size)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(p))
    return run


def sources(sizes: DataFrame) -> DataFrame:
    """Number, source_size and n_docs of each source, in order of code points, null last; and its target under the standing weights."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    total = SHARE * sum(r["source_size"] for r in rows)
    wanted = targets([r["source_size"] for r in rows], weights, total) if rows else []
    return sizes.sparkSession.createDataFrame(
        [(i, r["source"], r["source_size"], r["n_docs"], t) for i, (r, t) in enumerate(zip(rows, wanted, strict=True))],
        "number int, source string, source_size long, n_docs long, target double",
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target (its source's), copies (how often it is taken) and taken (words)."""
    sizes = picked(docs, doc_id=doc_id, source=source, text=text).select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"))
    # Equal rows are counted and numbered, so that they are dealt to groups like other rows.
    counted = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / PART))))
    numbers = F.sequence(F.col("part") * PART, F.least(F.col("rows"), (F.col("part") + 1) * PART) - 1)
    sizes = stored(parts.repartition("doc_id", "size", "part").withColumn("copy", F.explode(numbers)).drop("rows", "part"), "sizes")
    named = sources(sizes)
    rows = sizes.join(F.broadcast(named), sizes.source.eqNullSafe(named.source)).drop(named.source)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("chance", ratio - F.col("whole"))
    draw = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select(
        "doc_id", "source", "size", "source_size", "target", "number", F.col("whole").cast("long").alias("whole"), "chance",
        "copy", F.xxhash64(F.lit("mixing"), "doc_id", "size", "copy").alias("order"), draw(F.lit("move"), "doc_id", "size", "copy").alias("draw"), F.col("n_docs").alias("left"),
    )
    fixed = (F.col("chance") < TINY) | (F.col("chance") > 1 - TINY) | (F.col("size") == 0)
    done = rows.where(fixed).withColumn("chance", F.round("chance"))
    open_, level = rows.where(~fixed), 0
    biggest = named.agg(F.max("n_docs")).first()[0] or 0
    while True:
        last = biggest <= GROUP
        groups = F.ceil(F.col("left") / F.lit(GROUP))
        cell = F.pmod(F.xxhash64(F.lit(level), "order", "doc_id"), groups)
        dealt = open_.withColumn("cell", cell)
        flown = stored(dealt.groupBy("number", "cell").applyInArrow(_fly(last), dealt.schema).drop("cell"), "flown")
        if last:
            done = done.union(flown)
            break
        # Each group leaves two documents open at most.
        settled = (F.col("chance") == 0) | (F.col("chance") == 1)
        done = done.union(flown.where(settled))
        open_ = flown.where(~settled).withColumn("left", F.ceil(F.col("left") / F.lit(GROUP)) * 2)
        biggest, level = -(-biggest // GROUP) * 2, level + 1
    copies = (F.col("whole") + F.col("chance")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with the number of copies and the words taken; columns named copies or taken are replaced.

    Of documents that share an id, all stay if one does.
    """
    chosen = mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"), F.max("taken").alias("taken"))
    docs = docs.drop("copies", "taken")
    chosen = chosen.withColumnRenamed("doc_id", "taken_id")
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["taken_id"])).select(*(docs[f"`{c}`"] for c in docs.columns), chosen["copies"], chosen["taken"])
