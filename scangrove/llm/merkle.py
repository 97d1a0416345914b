"""A Merkle manifest of a dataset: one tree of digests for each group of rows, and one over the groups.

H is the lowercase hex sha256 of its inputs, concatenated; digests go in as hex text.  A leaf is H of a row's values, each ``-`` if null,
else its UTF-8 length, ``:`` and the value.  In a group leaves ascend by id.  While there are several nodes, every eight consecutive ones
(the last run may be shorter, even one) become their H; what remains is the group's root, a lone leaf itself.  The roots of the groups,
in order of the group's name, null first and then by UTF-8 bytes, give the dataset's root in the same way.

Places come from bitmaps instead of sorted rows:

1. Every task notes the ids of its rows as bits, in containers of 2^12 ids for each group: few ids as numbers, many as a bitmap, and the
   repeats of an id as counts.  The containers of all tasks are merged.
2. The containers' row counts are summed up along each group (``numbered``, over containers, not rows).  In a container a directory of
   popcounts tells how many ids lie before each word of 64 bits.
3. A row's place is a rank query: rows before its container, plus ids before its bit, plus repeats of those ids.
4. Rows meet by (group, place div 4096) and fill slots 0 to 4095; a block of slots gives four levels of the tree at once.  Its top goes into
   a slot of the next block, until a group has one node.  Proofs come down the same blocks.

No container holds more than 2^12 ids, and no block more than 4096 rows.  A container with very many repeated rows is dealt over cells.

Nulls and odd rows: null ids come before all others, a null group before all others.  Rows of one id are ordered by their leaf; equal
rows have equal leaves, so any order of theirs gives the same trees (each copy has its own place and proof).  Ids are 64-bit integers of any
sign.  Texts of any length are hashed whole.  An empty table gives no rows.  Other columns are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scangrove.operators.ordering import heavy_keys, numbered
from scangrove.session import stored

ARITY = 8
LEVELS = 4  #: levels of the tree that one block covers
BLOCK = ARITY ** LEVELS
LOW = 12  #: bits of an id inside its container
SPAN = 1 << LOW
DENSE = SPAN // 16  #: from so many ids on a bitmap is smaller than their numbers
GATHERED = 1 << 20


def leaf(*values: Column) -> Column:
    """The digest of a row's values as hex text."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*map(part, values)), 256)


# ---------------------------------------------------------------- containers of ids

def _bitmap(lows: np.ndarray) -> bytes:
    """Ascending numbers below ``SPAN``, as they are or as a bitmap, whichever is smaller."""
    if len(lows) < DENSE:
        return lows.astype(np.uint16).tobytes()
    bits = np.zeros(SPAN, bool)
    bits[lows] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _lows(data: bytes) -> np.ndarray:
    if len(data) == SPAN // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    return np.frombuffer(data, np.uint16).astype(np.int64)


def _container(lows: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """Ids, repeated ids, how often these come beyond the first time, rows."""
    again = counts > 1
    return _bitmap(lows), lows[again].astype(np.uint16).tobytes(), (counts[again] - 1).astype(np.int64).tobytes(), int(counts.sum())


_CONTAINER = "ids binary, again binary, extra binary, rows bigint"
_NAMES = ["_group", "_high", "ids", "again", "extra", "rows"]


def _containers_of(groups: list[str], highs: list[int], parts: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((groups, highs, *(zip(*parts) if parts else [()] * 4)), kinds)], _NAMES)


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The containers of a task's rows."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        groups = table.column("_group").combine_chunks().dictionary_encode()
        pairs = np.stack([groups.indices.to_numpy(zero_copy_only=False).astype(np.int64), table.column("_id").to_numpy()], axis=1)
        rows, counts = np.unique(pairs, axis=0, return_counts=True)
        cells = np.stack([rows[:, 0], rows[:, 1] >> LOW], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
        names = groups.dictionary.to_pylist()
        slices = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(rows)])]
        return _containers_of([names[cells[s.start, 0]] for s in slices], [int(cells[s.start, 1]) for s in slices],
                              [_container(rows[s, 1] & (SPAN - 1), counts[s]) for s in slices])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield flush()
            held = []
    if held:
        yield flush()


def _union(key: tuple, table: pa.Table) -> pa.Table:
    """One container from those of several tasks."""
    counts = np.zeros(SPAN, np.int64)
    for ids, again, extra in zip(*(table.column(c).to_pylist() for c in ("ids", "again", "extra"))):
        counts[_lows(ids)] += 1
        counts[np.frombuffer(again, np.uint16)] += np.frombuffer(extra, np.int64)
    lows = np.flatnonzero(counts)
    return pa.Table.from_batches([_containers_of([key[0].as_py()], [key[1].as_py()], [_container(lows, counts[lows])])])


def containers(rows: DataFrame) -> DataFrame:
    """_group, _high, ids, again, extra, rows, before: the merged containers with the number of rows before each in its group."""
    noted = rows.where("_id IS NOT NULL").select("_group", "_id").mapInArrow(_note, f"_group string, _high bigint, {_CONTAINER}")
    merged = noted.groupBy("_group", "_high").applyInArrow(_union, f"_group string, _high bigint, {_CONTAINER}")
    return stored(numbered(merged, ["_group"], ["_high"], "before", "rows"), "containers")


class Ranks:
    """Rank queries on a container: how many of its rows come before an id, and how often the id itself comes."""

    def __init__(self, ids: bytes, again: bytes, extra: bytes):
        bits = np.zeros(SPAN, bool)
        bits[_lows(ids)] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.directory = np.cumsum(counts) - counts
        self.again = np.frombuffer(again, np.uint16).astype(np.int64)
        self.extra = np.concatenate([[0], np.cumsum(np.frombuffer(extra, np.int64))])

    def before(self, lows: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (lows & 63).astype(np.uint64)) - np.uint64(1)
        ids = self.directory[lows >> 6] + np.bitwise_count(self.words[lows >> 6] & below)
        return ids + self.extra[np.searchsorted(self.again, lows)]

    def repeats(self, lows: np.ndarray) -> np.ndarray:
        return self.extra[np.searchsorted(self.again, lows, "right")] - self.extra[np.searchsorted(self.again, lows)]


def _place(key: tuple, rows: pa.Table, container: pa.Table) -> pa.Table:
    place, repeats = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
    if rows.num_rows:
        ids, again, extra, before = (container.column(c)[0].as_py() for c in ("ids", "again", "extra", "before"))
        ranks, lows = Ranks(ids, again, extra), rows.column("_id").to_numpy() & (SPAN - 1)
        place, repeats = before + ranks.before(lows), ranks.repeats(lows)
    return rows.append_column("_place", pa.array(place)).append_column("_repeats", pa.array(repeats))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (a stored table with _group, _id, _leaf, _row) with ``_place``: the zero-based place of each row in its group."""
    spans = containers(rows)
    nulls = rows.where("_id IS NULL").groupBy("_group").agg(F.count("*").alias("_nulls"))
    known = rows.where("_id IS NOT NULL").withColumn("_high", F.shiftright("_id", LOW))
    # Only repeated rows make a container large; such are dealt over cells, each with a copy of the container.
    crowded = heavy_keys(known, ["_group", "_high"]).select("_group", "_high", F.ceil(F.col("n") / SPAN).cast("int").alias("_cells"))
    crowded = F.broadcast(crowded.where("_cells > 1"))
    dealt = known.join(crowded, ["_group", "_high"], "left").withColumn("_cell", F.coalesce(F.pmod("_row", "_cells"), F.lit(0)).cast("int")).drop("_cells")
    copies = spans.join(crowded, ["_group", "_high"], "left").withColumn("_cell", F.explode(F.sequence(F.lit(0), F.coalesce("_cells", F.lit(1)) - 1)))
    keys = ["_group", "_high", "_cell"]
    schema = T.StructType([*dealt.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_repeats", T.LongType())])
    ranked = dealt.groupBy(*keys).cogroup(copies.select(*keys, "ids", "again", "extra", "before").groupBy(*keys)).applyInArrow(_place, schema)
    ranked = stored(ranked.drop("_high", "_cell"), "ranked")
    # Rows of one id, and those without one, are told apart by leaf, then by the number they got when they were stored.
    null_rows = rows.where("_id IS NULL").withColumns({"_place": F.lit(0).cast("bigint"), "_repeats": F.lit(1).cast("bigint")})
    tied = ranked.where("_repeats > 0").unionByName(null_rows)
    if not tied.isEmpty():
        tied = numbered(tied, ["_group", "_id"], ["_leaf", "_row"], "_tie").withColumn("_place", F.col("_place") + F.col("_tie")).drop("_tie")
        ranked = ranked.where("_repeats = 0").unionByName(tied)
        ranked = ranked.join(F.broadcast(nulls) if nulls.count() <= 10_000 else nulls, "_group", "left").withColumn(
            "_place", F.col("_place") + F.when(F.col("_id").isNotNull(), F.coalesce("_nulls", F.lit(0))).otherwise(0)).drop("_nulls")
    return ranked.drop("_repeats")


# ---------------------------------------------------------------- the trees

def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def digest(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block and of so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)]
        out.append(nodes)
    return out


def _block_levels(n: int, step: int) -> int:
    return min(LEVELS, max(0, levels_of(n) - LEVELS * step))


def _slots(table: pa.Table) -> list[str]:
    """The nodes of a block by slot."""
    out = [""] * table.num_rows
    for slot, node in zip((table.column("_place").to_numpy() % BLOCK).tolist(), table.column("_node").to_pylist()):
        out[slot] = node
    return out


def _reduce(step: int) -> Callable:
    def block(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("_n")[0].as_py()
        top = climb(_slots(table), _block_levels(n, step))[-1][0]
        return pa.table({"_group": [key[0].as_py()], "_place": pa.array([key[1].as_py()], pa.int64()), "_node": [top], "_n": pa.array([n], pa.int64())})
    return block


def _descend(step: int, names: list[str]) -> Callable:
    def block(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        """Each node's siblings in this block, level by level, then those above the block."""
        proofs, rest = [], ""
        if rows.num_rows:
            rest = above.column("_proof")[0].as_py()
            nodes = _slots(rows)
            tree = climb(nodes, _block_levels(rows.column("_n")[0].as_py(), step))[:-1]
            for slot in (rows.column("_place").to_numpy() % BLOCK).tolist():
                parts = []
                for level in tree:
                    run = slot - slot % ARITY
                    parts += level[run:slot] + level[slot + 1:run + ARITY]
                    slot //= ARITY
                proofs.append("".join(parts) + rest)
        facts = {c: pa.array([above.column(c)[0].as_py()] * rows.num_rows if rows.num_rows else [], above.schema.field(c).type) for c in _FACTS}
        return pa.table({c: rows.column(c) for c in names} | {"_proof": pa.array(proofs, pa.string())} | facts)
    return block


#: What a proof needs besides the siblings, and the digests it leads to.
_FACTS = ["_top", "_top_place", "_tops", "_root"]


def _trees(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each step (_group, _place, _node, _n) and the single node that is left of each group."""
    steps = [nodes]
    most = nodes.agg(F.max("_n")).first()[0] or 0
    for step in range(max(1, -(-levels_of(most) // LEVELS))):
        blocks = steps[-1].withColumn("_block", F.floor(F.col("_place") / BLOCK)).groupBy("_group", "_block")
        steps.append(stored(blocks.applyInArrow(_reduce(step), "_group string, _place bigint, _node string, _n bigint"), "nodes"))
    return steps[:-1], steps[-1]


def _proofs(steps: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, _proof and the facts for the nodes of the first step; ``above`` has _group, _place (0), _proof and the facts."""
    for step in reversed(range(len(steps))):
        names = ["_group", "_place", "_n", *(keep if step == 0 else [])]
        rows = steps[step].withColumn("_block", F.floor(F.col("_place") / BLOCK))
        schema = T.StructType([*(steps[step].schema[c] for c in names), T.StructField("_proof", T.StringType()), *(above.schema[c] for c in _FACTS)])
        known = above.select("_group", F.col("_place").alias("_block"), "_proof", *_FACTS)
        above = rows.groupBy("_group", "_block").cogroup(known.groupBy("_group", "_block")).applyInArrow(_descend(step, names), schema)
    return above


def manifest(rows: DataFrame, group: str, key: str, leaf: str, carry: Sequence[str] = ()) -> DataFrame:
    """The tree's facts for each row: id, leaf, place and leaves (in the group's tree), subroot, its place among subroots, root, proof.

    ``proof`` is the digests of all siblings, from the leaf's run up to the root's, left to right, as one hex text.  ``leaf`` names a column
    of hex digests; ``carry`` names columns that come along.
    """
    def named(name: str) -> Column:
        return F.col(f"`{name}`")

    along = [f"_c{i}" for i in range(len(carry))]
    leaves = stored(rows.select(
        F.when(named(group).isNull(), "").otherwise(F.concat(F.lit("="), named(group).cast("string"))).alias("_group"),
        named(key).cast("bigint").alias("_id"), named(leaf).alias("_leaf"), *(named(c).alias(a) for c, a in zip(carry, along)),
    ).withColumn("_row", F.monotonically_increasing_id()), "leaves")
    sizes = stored(leaves.groupBy("_group").agg(F.count("*").alias("_n")), "groups")
    at = placed(leaves).withColumnRenamed("_leaf", "_node")
    base = stored(at.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "_group").drop("_row"), "places")
    steps, tops = _trees(base)
    # The roots of the groups are the leaves of one more tree.
    many = sizes.count()
    roots = stored(numbered(tops.select(F.col("_group").alias("_of"), "_node"), [], ["_of"], "_place").select(
        F.lit("").alias("_group"), "_place", "_node", F.lit(many).cast("bigint").alias("_n"), "_of"), "roots")
    upper, last = _trees(roots)
    root = last.select("_group", F.lit(0).cast("bigint").alias("_place"), F.lit("").alias("_proof"), F.lit("").alias("_top"),
                       F.lit(0).cast("bigint").alias("_top_place"), F.lit(many).cast("bigint").alias("_tops"), F.col("_node").alias("_root"))
    above = _proofs(upper, root, ["_of", "_node"]).select(
        F.col("_of").alias("_group"), F.lit(0).cast("bigint").alias("_place"), "_proof", F.col("_node").alias("_top"),
        F.col("_place").alias("_top_place"), "_tops", "_root")
    found = _proofs(steps, stored(above, "subroots"), ["_id", "_node", *along])
    return found.select(
        F.col("_id").alias("id"), F.when(F.col("_group") != "", F.substring("_group", 2, 1 << 30)).alias("group"), F.col("_node").alias("leaf"),
        F.col("_place").alias("place"), F.col("_n").alias("leaves"), F.col("_top").alias("subroot"), F.col("_top_place").alias("subroot_place"),
        F.col("_tops").alias("subroots"), F.col("_root").alias("root"), F.col("_proof").alias("proof"), *(F.col(a).alias(c) for a, c in zip(along, carry)),
    )


def fold(node: str, place: int, leaves: int, top_place: int, tops: int, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for slot, n in ((place, leaves), (top_place, tops)):
        while n > 1:
            first = slot - slot % ARITY
            left, right = 64 * (slot - first), 64 * (min(first + ARITY, n) - slot - 1)
            node = sha256((proof[at:at + left] + node + proof[at + left:at + left + right]).encode()).hexdigest()
            at, slot, n = at + left + right, slot // ARITY, -(-n // ARITY)
    return node


def folded(manifest_rows: DataFrame, leaf: str, into: str) -> DataFrame:
    """``manifest_rows`` with the root that the digest in column ``leaf`` leads to by each row's proof."""
    fields = [leaf, "place", "leaves", "subroot_place", "subroots", "proof"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [fold(*row) for row in zip(*(batch.column(f).to_pylist() for f in fields))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, into])

    return manifest_rows.mapInArrow(run, T.StructType([*manifest_rows.schema.fields, T.StructField(into, T.StringType())]))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest_report(documents: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by language, and what becomes of each proof if the text of every third id or so is tampered with."""
    values = [F.col(f"`{c}`") for c in ("doc_id", "source", "lang", "n_chars", "text")]
    honest = leaf(*values)
    chosen = F.crc32(values[0].cast("string").cast("binary")) % 3 == 0
    rows = documents.select(
        values[0].alias("doc_id"), values[2].alias("lang"), honest.alias("leaf"),
        F.when(chosen, leaf(*values[:-1], ascii_lower(values[-1]))).otherwise(honest).alias("shown"),
    )
    made = folded(manifest(rows, "lang", "doc_id", "leaf", ["shown"]), "shown", "folded_root")
    return made.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
