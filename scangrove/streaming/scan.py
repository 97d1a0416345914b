"""Scanning files as they arrive.

The operators are the batch ones; only the sources, sinks and the running
counters are specific to streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..catalog import SEVERITIES, Rule
from ..operators.marks import suppress
from ..operators.scan import scan_files, scan_rules
from ..session import file_system, fresh_path


def arriving_files(
    spark: SparkSession, path: str, schema: StructType, per_batch: int = 1000, glob: str | None = None, partitions: int | None = None,
) -> DataFrame:
    """Parquet files appearing in a folder, as a stream of their rows; a path of one file stands for that file.

    ``partitions`` spreads the rows of a batch; of use only where a batch is
    few files and a scan of them is slow.
    """
    fs, target = file_system(spark, path)
    if fs.exists(target) and fs.getFileStatus(target).isFile():
        path, glob = target.getParent().toString(), target.getName()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.parquet(path)
    return rows.repartition(partitions) if partitions else rows


def stream_findings(files: DataFrame, marks: DataFrame | None = None, rules: DataFrame | Sequence[Rule] | None = None) -> DataFrame:
    """Findings of arriving files, without marked ones (N1, N2); stateless."""
    found = scan_rules(files, rules)
    return found if marks is None else suppress(found, marks)


def running_counts(findings: DataFrame) -> DataFrame:
    """Findings so far per repository and severity (N3); the state is one number per pair."""
    return findings.groupBy("repo", "severity").agg(F.count("*").alias("findings"))


def batch_counts(files: DataFrame, rules: DataFrame | Sequence[Rule] | None = None) -> DataFrame:
    """Per repository the files scanned and the findings of each severity, from one read of the texts."""
    found = ~F.col("is_file")
    return scan_files(files, rules).groupBy("repo").agg(
        F.count_if("is_file").alias("files_scanned"), *[F.count_if(found & (F.col("severity") == s)).alias(s) for s in SEVERITIES[::-1]],
    )


def count_batches(path: str, rules: DataFrame | Sequence[Rule] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the counts of each batch under its number, so a batch that is repeated replaces its own counts."""
    def write(files: DataFrame, batch: int) -> None:
        batch_counts(files, rules).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def progress(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """How far a scan has come: files scanned, of how many ``known`` (repo, path), and findings by severity, per repository."""
    names = ["files_scanned", *SEVERITIES[::-1]]
    schema = "repo string, " + ", ".join(f"{c} bigint" for c in names) + ", batch bigint"
    done = _written(spark, path, schema).groupBy("repo").agg(*[F.sum(c).alias(c) for c in names])
    if known is None:
        return done
    total = known.groupBy("repo").agg(F.count("*").alias("files_known"))
    return total.join(done, "repo", "full").select("repo", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files_known", *names)])


def run_progress(files: DataFrame, label: str, known: DataFrame | None = None) -> DataFrame:
    """Scan everything that is there and return the progress."""
    spark = files.sparkSession
    out = fresh_path(spark, label)
    writer = files.writeStream.option("checkpointLocation", fresh_path(spark, f"{label}-progress")).trigger(availableNow=True)
    writer.foreachBatch(count_batches(out)).start().awaitTermination()
    return progress(spark, out, known)


def changed_only(files: DataFrame, arrived: str, forget_after: str = "7 days") -> DataFrame:
    """Files whose content differs from what was last seen in the same place.

    The state is one hash a file.  It is forgotten when a file has not been seen for some time, of the clock; a file that comes back
    later counts as changed.  Versions of a file in one batch are taken in order of ``arrived``; they are held together.
    """
    millis, names = int(pd.Timedelta(forget_after).total_seconds() * 1000), files.columns

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([arrived, "_hash"], kind="stable")
        before = rows["_hash"].shift(fill_value=state.get[0] if state.exists else "")
        state.update((rows["_hash"].iloc[-1],))
        state.setTimeoutTimestamp(int(rows["_ms"].max()) + millis)
        yield rows[rows["_hash"] != before][names]

    # The time of the batch is the time that state goes by, so no row is ever late.
    hashed = files.withColumns({
        "_hash": F.coalesce(F.sha2("content", 256), F.lit("none")), "_now": F.current_timestamp(), "_ms": F.unix_millis(F.current_timestamp()),
    }).withWatermark("_now", "1 second")
    return hashed.groupBy("repo", "path").applyInPandasWithState(step, files.schema, "hash string", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything that is there and return the written rows.

    Output and progress are kept in the shared folder.  Complete and update
    output is written per batch, so that the last batch is the result.
    """
    spark = stream.sparkSession
    out = fresh_path(spark, label)
    writer = stream.writeStream.option("checkpointLocation", fresh_path(spark, f"{label}-progress")).trigger(availableNow=True)
    if mode == "append":
        query: StreamingQuery = writer.format("parquet").option("path", out).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _epoch: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return _written(spark, out, stream.schema)


def _written(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows that a stream has written; none where no batch had files, so that nothing was written."""
    fs, target = file_system(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(target) else spark.createDataFrame([], schema)
