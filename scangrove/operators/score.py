"""Scores, gates and the sentences that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import SECURITY_BONUS, SEVERITIES, SEVERITY_WEIGHT, by_severity, severity_rank


def severity_counts(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repository: issues, issues per severity, and the uncapped score."""
    severity = F.col("severity")
    serious = (F.col("category") == "security") & severity.isin("critical", "high")
    points = by_severity(severity, SEVERITY_WEIGHT, 1) + F.when(serious, SECURITY_BONUS).otherwise(0)
    counted = findings.groupBy("repo").agg(
        F.count("*").alias("issues"),
        *[F.count_if(severity == s).alias(s) for s in SEVERITIES[::-1]],
        F.sum(points.cast("bigint")).alias("points"),
    )
    names = ["issues", *SEVERITIES[::-1], "points"]
    return repos.select("repo").distinct().join(counted, "repo", "left").select(
        "repo", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names],
    )


def risk_score(points: Column, suggested: Column | None = None) -> Column:
    """The capped score, or the suggested one (0 to 100) where that is higher."""
    static = F.least(F.lit(100), points)
    if suggested is None:
        return static.cast("bigint")
    whole = F.when(suggested >= 0, F.floor(suggested)).otherwise(F.ceil(suggested))
    # greatest and least pass over nulls, so a missing suggestion is told apart first.
    raised = F.greatest(static, F.greatest(F.lit(0), F.least(F.lit(100), whole)))
    return F.when(suggested.isNull(), static).otherwise(raised).cast("bigint")


def risk_band(score: Column) -> Column:
    """D12."""
    return F.when(score >= 75, "Critical Risk").when(score >= 50, "High Risk").when(score >= 25, "Medium Risk").otherwise("Low Risk")


def assessment(static_only: bool = True) -> Column:
    """The summary sentence from the columns issues, critical and high."""
    label = "Static analysis" if static_only else "Analysis"
    parts = F.concat_ws(
        " and ",
        F.when(F.col("critical") > 0, F.concat(F.col("critical").cast("string"), F.lit(" critical"))),
        F.when(F.col("high") > 0, F.concat(F.col("high").cast("string"), F.lit(" high severity"))),
    )
    text = F.concat(
        F.lit(f"{label} found "), F.col("issues").cast("string"), F.lit(" issue"), F.when(F.col("issues") == 1, "").otherwise("s"),
        F.when(parts == "", "").otherwise(F.concat(F.lit(", including "), parts)),
    )
    if not static_only:
        return text
    # Fixed value: the closing remark of a scan without model review.
    return F.concat(text, F.lit(". No LLM-based code review was performed; results reflect regex and pattern-matching only."))


def scores(findings: DataFrame, repos: DataFrame, suggested: DataFrame | None = None, static_only: bool = True) -> DataFrame:
    """Counts, score, band and assessment per repository."""
    counts = severity_counts(findings, repos)
    hint = None
    if suggested is not None:
        counts, hint = counts.join(suggested.select("repo", "suggested"), "repo", "left"), F.col("suggested")
    return (
        counts.withColumn("risk_score", risk_score(F.col("points"), hint))
        .withColumn("risk_band", risk_band(F.col("risk_score")))
        .withColumn("assessment", assessment(static_only))
        .drop("points", "suggested")
    )


def file_counts(files: DataFrame) -> DataFrame:
    """Analysed and skipped files per repository, from files with a token gate."""
    return files.groupBy("repo").agg(
        F.count_if("analyzed").alias("total_files_analyzed"), F.count_if(~F.col("analyzed")).alias("total_files_skipped"),
    )


def at_least(findings: DataFrame, threshold: str) -> DataFrame:
    """Findings of a severity or worse."""
    return findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(threshold))


def gate(findings: DataFrame, repos: DataFrame, threshold: str = "low", fail_on: str | None = None) -> DataFrame:
    """1 for repositories with a shown finding at or above ``fail_on``, else 0."""
    limit = SEVERITIES.index(fail_on or threshold)
    failing = at_least(findings, threshold).groupBy("repo").agg(
        F.max((severity_rank(F.col("severity")) >= limit).cast("int")).alias("exit_code"),
    )
    return repos.select("repo").distinct().join(failing, "repo", "left").select("repo", F.coalesce("exit_code", F.lit(0)).alias("exit_code"))
