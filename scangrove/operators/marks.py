"""False-positive marks: suppression of findings and upkeep of the mark table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import description_hash
from ..schemas import MARKS


def load_marks(spark: SparkSession, path: str | None) -> DataFrame:
    """The mark table, a JSON object a line; an absent path or unreadable rows give no marks (A10)."""
    return _read(spark, path).where("problem IS NULL").select("mark.*").select(*MARKS.fieldNames())


def unread_marks(spark: SparkSession, path: str | None) -> DataFrame:
    """The lines that ``load_marks`` leaves out, each with the reason."""
    return _read(spark, path).where("problem IS NOT NULL").select("value", "problem")


def _read(spark: SparkSession, path: str | None) -> DataFrame:
    """Lines of a mark file as value, mark and problem."""
    target = path and spark._jvm.org.apache.hadoop.fs.Path(path)
    if target and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        lines = spark.read.text(path).where("trim(value) <> ''")
    else:
        lines = spark.createDataFrame([], "value string")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MARKS)
    read = lines.select("value", F.from_json("value", f"{shape}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("mark"))
    problem = F.when(F.col("mark").isNull() | F.col("mark._broken").isNotNull(), "unreadable").when(
        F.col("mark.file_path").isNull(), "file_path is required")
    return read.withColumn("problem", problem)


def suppress(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Drop marked findings: by rule where there is one, else by the hash of the description.

    One anti join serves both kinds: a finding and a mark meet on the rule id,
    or on the hash where the rule id is null.  The two key spaces are kept apart
    by a leading letter.  Works for streaming findings as well.
    """
    key = F.when(F.col("rule_id").isNotNull(), F.concat(F.lit("r:"), F.col("rule_id")))
    kinds = F.filter(
        F.array(key, F.concat(F.lit("d:"), F.col("description_hash"))), lambda k: k.isNotNull(),
    )
    marked = marks.where(F.col("file_path") != "").select(
        "repo", F.col("file_path").alias("file"), F.explode(kinds).alias("_key"),
    ).distinct()
    keyed = findings.withColumn(
        "_key", key.otherwise(F.concat(F.lit("d:"), description_hash(F.col("description")))),
    )
    return keyed.join(marked, ["repo", "file", "_key"], "left_anti").drop("_key").select(findings.columns)


def invalid_marks(marks: DataFrame) -> DataFrame:
    """Marks without a file, or with both or neither of rule and hash, with the reason."""
    problem = F.when(F.coalesce(F.col("file_path"), F.lit("")) == "", "file_path is required").when(
        F.col("rule_id").isNull() == F.col("description_hash").isNull(), "exactly one of rule_id and description_hash must be set",
    )
    return marks.withColumn("problem", problem).where(F.col("problem").isNotNull())


def add_marks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing marks plus the valid new ones; the earliest mark of a file and rule or hash stays.

    Existing rows win over new ones.  The choice is an aggregate, so repeated
    marks collapse before the shuffle.
    """
    valid = new.join(invalid_marks(new).select("id"), "id", "left_anti")
    both = existing.withColumn("_new", F.lit(0)).unionByName(valid.withColumn("_new", F.lit(1)))
    rest = [c for c in MARKS.fieldNames() if c not in ("repo", "file_path", "rule_id", "description_hash")]
    first = F.min(F.struct("_new", F.col("marked_at").alias("_at"), F.col("id").alias("_id"), F.struct(*rest).alias("row")))
    return (
        both.groupBy("repo", "file_path", "rule_id", "description_hash").agg(first.alias("_first"))
        .select("repo", "file_path", "rule_id", "description_hash", "_first.row.*").select(*MARKS.fieldNames())
    )


def remove_marks(marks: DataFrame, ids: DataFrame) -> DataFrame:
    """Marks without the given ids."""
    return marks.join(ids.select("id").distinct(), "id", "left_anti").select(*MARKS.fieldNames())


def removal_result(marks: DataFrame, ids: DataFrame) -> DataFrame:
    """For each requested id whether there is such a mark."""
    known = marks.select("id").distinct().withColumn("removed", F.lit(True))
    return ids.select("id").distinct().join(known, "id", "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def list_marks(marks: DataFrame) -> DataFrame:
    """Marks in insertion order (I8)."""
    return marks.orderBy("marked_at", "id")


def mark_count(marks: DataFrame) -> DataFrame:
    """D13."""
    return marks.agg(F.count("*").alias("mark_count"))


def clear(table: DataFrame) -> DataFrame:
    """The same table without rows; write it over the old one to clear it."""
    return table.limit(0)
