"""Choosing the files of a repository that fit into one bundle of limited size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import first_n_per_group

# The budget in estimated tokens and the reason given for files left out.
BUNDLE_TOKENS = 150_000
EXCLUDED_REASON = "Excluded from AI bundle (budget exceeded); static analysis ran."


def _cutoffs(sized: DataFrame, budget: int) -> DataFrame:
    """Per repository and class the smallest size that does not fit completely, and how many files of it do.

    Files are taken smallest first, so after the first file that does not fit
    none of its class does.  It is enough to count files per size: a class has
    no more sizes than the per-file token limit.
    """
    sizes = sized.groupBy("repo", "late", "tokens").agg(F.count("*").alias("n"))
    before = Window.partitionBy("repo", "late").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)

    def fitting(room):
        taken = F.floor((room - F.col("before")) / F.col("tokens"))
        return F.when(F.col("tokens") == 0, F.col("n")).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), taken)))

    first = (
        sizes.withColumn("before", F.coalesce(F.sum(F.col("tokens") * F.col("n")).over(before), F.lit(0)))
        .withColumn("fit", fitting(F.lit(budget)))
        .withColumn("spent", F.sum(F.when(~F.col("late"), F.col("tokens") * F.col("fit")).otherwise(0)).over(Window.partitionBy("repo")))
        .withColumn("fit", F.when(F.col("late"), fitting(F.lit(budget) - F.col("spent"))).otherwise(F.col("fit")))
    )
    return first.where(F.col("fit") < F.col("n")).groupBy("repo", "late").agg(
        F.min(F.struct("tokens", "fit")).alias("cut"),
    ).select("repo", "late", F.col("cut.tokens").alias("cut_tokens"), F.col("cut.fit").alias("cut_fit"))


def pack_bundle(files: DataFrame, with_hits: DataFrame, budget: int = BUNDLE_TOKENS) -> DataFrame:
    """The files with ``in_bundle``: those with findings first, small before large, as long as they fit.

    ``files`` has repo, path, file_ord, token_count and analyzed; ``with_hits``
    has repo and path of files with findings.  What is needed of both is stored
    first, as sizes are looked at more than once.  The cut-offs are two rows per
    repository; adaptive execution broadcasts them or splits large repositories.
    """
    hits = with_hits.select("repo", "path").distinct().withColumn("_hit", F.lit(True))
    sized = (
        files.where("analyzed").select("repo", "path", "file_ord", F.col("token_count").alias("tokens"))
        .join(hits, ["repo", "path"], "left")
        .withColumn("late", F.col("_hit").isNull()).drop("_hit")
    )
    sized = stored(sized, "sizes")
    placed = sized.join(_cutoffs(sized, budget), ["repo", "late"], "left")
    whole = placed.where(F.col("cut_tokens").isNull() | (F.col("tokens") < F.col("cut_tokens")))
    edge = first_n_per_group(
        placed.where((F.col("tokens") == F.col("cut_tokens")) & (F.col("cut_fit") > 0)),
        ["repo", "late"], ["file_ord"], F.col("cut_fit"), ["file_ord"],
    )
    # Empty files always fit, whatever was cut before them.
    chosen = whole.unionByName(edge).select("repo", "path").withColumn("in_bundle", F.lit(True))
    return files.join(chosen, ["repo", "path"], "left").withColumn("in_bundle", F.coalesce("in_bundle", F.lit(False)))


def mark_excluded(packed: DataFrame) -> DataFrame:
    """Give analysed files outside the bundle their reason; they stay analysed."""
    left_out = F.col("analyzed") & ~F.col("in_bundle")
    return packed.withColumn("skip_reason", F.when(left_out, EXCLUDED_REASON).otherwise(F.col("skip_reason")))


def with_texts(files: DataFrame, chosen: DataFrame, few: int = 100_000) -> DataFrame:
    """The files that ``chosen`` (a stored table with repo and path) names, with their contents and the columns of ``chosen``.

    Few paths are sent to the contents, which then stay where they are; only if there are more are contents shuffled.
    """
    paths = F.broadcast(chosen) if chosen.count() <= few else chosen
    return files.join(paths, ["repo", "path"])
