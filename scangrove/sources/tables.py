"""Tables that are replaced as a whole: marks, responses, catalogs.

Each version is a folder of its own.  A marker file, created only once its version is complete, names it; the marker with the highest number
counts.  A reader holds on to the version it found, so it sees one whole version, whatever is written meanwhile.  Markers are created, never
overwritten or renamed, so two writers can't take the same number: the second one takes the next.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import file_system

_MARKER, _LOCK = "current-", "lock-"


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def _markers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder of each version, oldest first."""
    parts = [n.removeprefix(_MARKER).split("-", 1) for n in _names(spark, path) if n.startswith(_MARKER)]
    return sorted((int(number), folder) for number, folder in parts)


def replace_table(df: DataFrame, path: str, attempts: int = 20) -> None:
    """Make the rows of ``df`` the table at ``path``; they may come from its present version."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path}/v-{folder}")
    for _ in range(attempts):
        # The lock has the number alone, so that only one writer can have it; one that was left behind is passed over.
        taken = [n.removeprefix(_LOCK) for n in _names(spark, path) if n.startswith(_LOCK)]
        number = max(map(int, taken), default=0) + 1
        fs, lock = file_system(spark, f"{path}/{_LOCK}{number:012d}")
        if fs.createNewFile(lock):
            fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_MARKER}{number:012d}-{folder}"))
            return
    raise PySparkException(f"others kept replacing {path}")


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The present version; without one there are no rows."""
    versions = _markers(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v-{versions[-1][1]}")


def clear_table(spark: SparkSession, path: str, schema: StructType) -> None:
    replace_table(spark.createDataFrame([], schema), path)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions, and say how many; readers of those must be done."""
    old = _markers(spark, path)[:-keep]
    for number, folder in old:
        for name in (f"{_MARKER}{number:012d}-{folder}", f"{_LOCK}{number:012d}", f"v-{folder}"):
            fs, target = file_system(spark, f"{path}/{name}")
            fs.delete(target, True)
    return len(old)
