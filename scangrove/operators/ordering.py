"""Order-dependent building blocks that never put a whole group into one task.

A repository, a copied file or a popular import target may own a large part of
all rows, so plain per-group windows are avoided here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

SALTS = 32


def first_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | Column, spread_by: Sequence[str], salts: int = SALTS,
) -> DataFrame:
    """The first ``n`` rows of each group.

    The limit is taken per slice of a group first, so the final window sees at
    most ``salts * n`` rows of any group.  ``spread_by`` names columns that
    differ between the rows of a group.
    """
    slices = Window.partitionBy(*keys, "_salt").orderBy(*order)
    groups = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(slices)).where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(groups)).where(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """Zero-based position of each row within its group, nulls first; with ``weight`` the sum of that column over the rows before it.

    Rows are cut into ranges of (keys, order) and sorted inside them, in one exchange.  A range is numbered as it streams by.  Only the
    group that a range begins with may have begun in ranges before it, so one row a range is all that the ranges have to tell each other.
    A group of any size is spread over many ranges, as long as ``order`` tells its rows apart.
    """
    fields = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", "_at", "_within", "_weight")), T.StructField("_first", T.BooleanType())])
    cut = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    inside = stored(cut.mapInArrow(_positions(list(keys), weight), fields), "numbered")
    group = F.struct(F.lit(0).alias("_"), *keys)
    ranges = inside.groupBy("_part").agg(
        F.min_by(group, "_at").alias("first"), F.max_by(group, "_at").alias("last"), F.max_by(F.col("_within") + F.col("_weight"), "_at").alias("total"),
        F.max_by("_first", "_at").alias("one"),
    ).orderBy("_part").collect()
    offsets, before, group_before = [], 0, None
    for r in ranges:
        offset = before if r["first"] == group_before else 0
        offsets.append((r["_part"], offset))
        before, group_before = r["total"] + (offset if r["one"] else 0), r["last"]
    known = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    place = F.col("_within") + F.when(F.col("_first"), F.col("_offset")).otherwise(0)
    return inside.join(F.broadcast(known), "_part").select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))


def _positions(keys: list[str], weight: str | None):
    """Numbers the sorted rows of a partition within their groups; ``_first`` marks the rows of the group it begins with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, carry, last, first = 0, 0, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            for key in keys:
                codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
                begins[1:] |= codes[1:] != codes[:-1]
            ends = [tuple(batch.column(key)[i].as_py() for key in keys) for i in (0, n - 1)]
            begins[0] = last is not None and ends[0] != last
            weights = np.ones(n, np.int64) if weight is None else batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(weights) - weights
            run_of = np.cumsum(begins)
            starts = np.concatenate([[-carry], before[begins]])
            within = before - starts[run_of]
            in_first = (run_of == 0) & first
            columns = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n)), pa.array(within), pa.array(weights), pa.array(in_first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_part", "_at", "_within", "_weight", "_first"])
            at, carry, last, first = at + n, int(within[-1] + weights[-1]), ends[1], bool(in_first[-1])
    return run


def heavy_keys(df: DataFrame, keys: Sequence[str], parts: int = 10_000) -> DataFrame:
    """The keys that hold more than 1 / ``parts`` of all rows, with their rows as ``n``: fewer than ``parts`` keys at any size of the data."""
    least = max(1, df.count() // parts)
    return stored(df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > least), "heavy-keys")


def skew_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, spread_by: Sequence[str], salts: int = SALTS,
) -> DataFrame:
    """An equi-join in which keys with a notable share of the left rows are split over ``salts`` tasks.

    The list of those keys is short at any size (``heavy_keys``) and is
    broadcast, so no join is on a bare popular key.  Only the right rows of
    those keys are copied; ``right`` should hold few rows per key.  The left side
    is read twice and should be a stored table.
    """
    hot_keys = F.broadcast(heavy_keys(left, keys).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = left.join(hot_keys, list(keys), "left").withColumn("_salt", salt).drop("_hot")
    copied = right.join(hot_keys, list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
