"""Nearest neighbours by inner product with collision-counting hashing.

Vectors are split into ranges of length, each searched in blocks of its own; ranges of few vectors are searched whole, with exact
products.  In a range, vectors get one more component that makes all lengths equal, so that the largest inner product is the smallest
distance; as lengths differ by a factor of ``SPREAD`` at most, that component doesn't hide the others.  Each hash
function is a single projection; a block of vectors keeps, per projection, its vectors sorted by projected value.  For a query, windows
centred on its own projections widen round by round (virtual rehashing: the radius grows, the arrays stay); a vector that stands in
enough windows collides often enough to be verified, and a query is done with a block once enough vectors have been verified.  How many
are enough is measured in each block: some of its queries are answered exactly, and so many must be verified that each of them would find
``RECALL`` of its neighbours.  Vectors without clusters, and wide ones, need more, up to all of the block.  The first radius is the upper
quartile of those that these queries need for so many, found by bisection.
All vectors that collide often enough in the last round are verified, however many, with exact inner products in double precision;
if too few ever do, as in small blocks, all vectors of the block are.

The stated queries meet all vectors in blocks: a block of vectors and a block of queries make one task, and each task returns the
nearest of its block only.  No answer depends on how many rows a block got.

Null and zero vectors, and those with null or non-finite components or another length than most, take no part; so do null ids.
Ties go to the smaller id.  Rows of one id are one query, with the smallest of their vectors, and so have one answer; as neighbours of others
they count as often as they stand there, but never for their own id.  An empty table, or one without usable vectors, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scangrove.llm.tokens import picked
from scangrove.operators.ordering import first_n_per_group

EVERY = 20
NEAREST = 20
PROJECTIONS = 96
COLLISIONS = 0.85       # share of the projections in whose windows a vector must stand
GROWTH = 1.04           # of the radius from one round to the next
VERIFIED = 0.14         # least share of a block that is verified before a query is done with it, besides the neighbours asked for
RECALL = 0.96           # of the neighbours of each query that is answered exactly
TRIED = 16              # queries of a block that are answered exactly
BLOCK, QUERY_BLOCK = 8_192, 2_048
SPREAD = 1.25           # longest to shortest vector of a range
LAST = 200              # rounds of widening
FEW = 1_024             # a range of no more vectors is verified whole, together with others


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns id and v (doubles) of the rows that take part."""
    rows = picked(vectors, id=vec_id, v=vector).select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def collisions(order: np.ndarray, lines: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """In how many windows each vector stands; counted by those outside, who are fewer.  ``lines`` has the sorted values, one projection after the other."""
    m, n = order.shape
    edges = np.searchsorted(lines, np.concatenate([centre - radius, centre + radius])).reshape(2, m) - np.arange(m) * n
    edges = np.clip(edges, 0, n).tolist()
    outside = [ranks[:low] for ranks, low in zip(order, edges[0], strict=True)] + [ranks[high:] for ranks, high in zip(order, edges[1], strict=True)]
    return m - np.bincount(np.concatenate(outside), minlength=n)


def whole_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, neighbour, inner product): the ``k`` best of a block for each query, all vectors verified."""
    out, size = [], np.sqrt((x * x).sum(axis=1))
    for i in range(len(q)):
        found = np.flatnonzero(ids != query_ids[i])
        out += best_of(found, ids, x, int(query_ids[i]), q[i], float(size.max()), k)
    return out


def best_of(found: np.ndarray, ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, longest: float, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` best of some vectors of a block for one query."""
    if len(found) > k:
        rough = x[found] @ q
        found = found[rough >= np.partition(rough, -k)[-k] - 1e-9 * longest * np.abs(q).sum()]
    # Summed component by component, so that equal vectors get equal products wherever they stand.
    score = (x[found] * q).sum(axis=1)
    best = np.lexsort((ids[found], -score))[:k]
    return [(query_id, int(ids[found[b]]), float(score[b])) for b in best]


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, longest: float, k: int) -> list[tuple[int, int, float]]:
    """(query, neighbour, inner product): the ``k`` best of a block for each query."""
    n, dim = x.shape
    enough = min(n, k + 1 + int(VERIFIED * n))
    if n <= enough:
        return whole_block(ids, x, query_ids, q, k)
    directions = np.random.default_rng(4).normal(size=(dim + 1, PROJECTIONS))
    rest = np.sqrt(np.maximum(0, longest ** 2 - (x * x).sum(axis=1)))
    spots = (np.hstack([x, rest[:, None]]) @ directions).T
    order = np.argsort(spots, axis=1, kind="stable")
    apart = 4 * np.abs(spots).max() + 1   # keeps the projections' values apart in one array
    lines = (np.take_along_axis(spots, order, axis=1) + np.arange(PROJECTIONS)[:, None] * apart).ravel()
    centres = (q * (longest / np.sqrt((q * q).sum(axis=1)))[:, None]) @ directions[:-1]
    centres = np.clip(centres, -apart / 4, apart / 4) + np.arange(PROJECTIONS) * apart
    need = int(np.ceil(COLLISIONS * PROJECTIONS))

    def colliding(i: int, level: int) -> np.ndarray:
        return np.flatnonzero(collisions(order, lines, centres[i], min(longest * GROWTH ** level, apart / 4)) >= need)

    def least(done) -> int:
        """The smallest radius at which ``done`` holds, or one beyond all."""
        low, high = -200, LAST
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if done(middle) else (middle, high)
        return high

    tried = range(0, len(q), -(-len(q) // TRIED))
    for i in tried:
        exact = whole_block(ids, x, query_ids[i:i + 1], q[i:i + 1], k)
        wanted = np.flatnonzero(np.isin(ids, [r[1] for r in exact]))
        level = least(lambda at: np.isin(wanted, colliding(i, at)).mean() >= RECALL) if len(wanted) else -200
        enough = max(enough, n if level >= LAST else len(colliding(i, level)))
    if enough >= n:
        return whole_block(ids, x, query_ids, q, k)
    start = int(np.quantile([least(lambda at: len(colliding(i, at)) >= enough) for i in tried], 0.75))
    out = []
    for i in range(len(q)):
        level, found = start, colliding(i, start)
        while len(found) < enough and level < LAST:
            level += 1
            found = colliding(i, level)
        if len(found) < enough:
            found = np.arange(n)
        out += best_of(found[ids[found] != query_ids[i]], ids, x, int(query_ids[i]), q[i], longest, k)
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest of each row whose id is divisible by ``every``."""
    rows = usable(vectors, vec_id, vector)
    # Vectors too short or too long for squares are all in the first or last range.
    square = F.least(F.greatest(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b), F.lit(1e-300)), F.lit(1e300))
    # Half a step aside, so that unit vectors are far from a border.
    rows = rows.withColumn("range", F.floor(F.log(square) / (2 * np.log(SPREAD)) + 0.5).cast("int"))
    sizes = rows.groupBy(F.size("v").alias("dim"), "range").agg(
        F.count("*").alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("queries"), F.max(square).alias("longest"),
    ).collect()   # about 3,100 ranges at most for each number of components
    schema = "query_id long, vec_id long, score double"
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors_of: dict[int, int] = {}
    for r in sizes:
        vectors_of[r["dim"]] = vectors_of.get(r["dim"], 0) + r["n"]
    dim = min(vectors_of, key=lambda d: (-vectors_of[d], d))
    sizes = sorted((r for r in sizes if r["dim"] == dim), key=lambda r: r["range"])
    query_blocks = max(1, -(-sum(r["queries"] for r in sizes) // QUERY_BLOCK))
    # Blocks of ranges, one range after the other; those of small ranges, which share their blocks, come last and have no length.
    first, lengths = {}, []
    for r in sizes:
        if r["n"] > FEW:
            first[r["range"]] = (len(lengths), -(-r["n"] // BLOCK))
            lengths += [float(np.sqrt(r["longest"]))] * first[r["range"]][1]
    small = -(-sum(r["n"] for r in sizes if r["n"] <= FEW) // BLOCK)
    first |= {r["range"]: (len(lengths), small) for r in sizes if r["n"] <= FEW}
    lengths += [0.0] * small
    blocks = len(lengths)
    place = F.create_map(*(F.lit(x) for r, (lo, n) in first.items() for x in (r, lo))), F.create_map(*(F.lit(x) for r, (lo, n) in first.items() for x in (r, n)))
    rows = rows.where(F.size("v") == dim)
    cell = lambda n, name: F.pmod(F.xxhash64(F.lit(name), "id"), n).cast("int")
    all_of = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)])) if n <= 64 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("id", "v", (place[0][F.col("range")] + cell(place[1][F.col("range")], "block")).alias("block")).withColumn("part", all_of(query_blocks)).toDF("id", "v", "block", "part")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.select("id", "v", cell(F.lit(query_blocks), "part").alias("part")).withColumn("block", all_of(blocks)).toDF("id", "v", "part", "block")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            # In order of id, so that nothing depends on how rows arrive.
            left, right = left.sort_by("id"), right.sort_by("id")
            sides = left.column("id").to_numpy(), _matrix(left.column("v"), dim), right.column("id").to_numpy(), _matrix(right.column("v"), dim)
            longest = lengths[left.column("block")[0].as_py()]
            found = search_block(*sides, longest, k) if longest else whole_block(*sides, k)
        columns = list(zip(*found, strict=True)) if found else [[]] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    found = data.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(meet, schema)
    best = first_n_per_group(found, ["query_id"], [F.desc("score"), "vec_id"], k, ["vec_id"], salts=8)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).select("query_id", "rank", "vec_id", "score")
