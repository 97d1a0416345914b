"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffles at run time and splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter provides the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("scangrove")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; for a local session that names none, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir, when the session starts, to a folder that all executors share")
    return _temporary()


@functools.cache
def _temporary() -> str:
    path = tempfile.mkdtemp(prefix="scangrove-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What is stored inside goes to one folder of the shared one, which is deleted at the end.

    Results that are wanted afterwards have to be written elsewhere inside.
    """
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        fs, target = file_system(spark, path)
        fs.delete(target, True)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, as the executors see it, and the path in its terms."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_RUN.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that several consumers share one computation."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer partitions than the cluster has cores; leave large inputs alone."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table held in the plan itself, so that Spark knows its size and joins it by broadcast."""
    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, int):
            return str(value)
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    fields = [field.split() for field in schema.split(",")]
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(name for name, _ in fields)})")
