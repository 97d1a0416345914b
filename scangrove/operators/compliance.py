"""Compliance checklists per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import SECTIONS, severity_name, severity_rank


def _sections() -> Column:
    return F.array(*[
        F.struct(
            F.lit(framework).alias("framework"), F.lit(i).alias("sec_ord"), F.lit(section).alias("section"),
            F.lit(title).alias("title"), F.lit(text).alias("description"), F.lit(needle).alias("ref_substring"),
        )
        for i, (framework, section, title, needle, text) in enumerate(SECTIONS)
    ])


def checklists(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """All 39 sections of every repository with count, status and worst severity.

    Findings are counted per reference before they meet the sections, so what is
    expanded is a few rows per repository and reference.  HIPAA sections look at
    the HIPAA reference only, the others at the reference of every framework.
    """
    counted = (
        findings.where(F.col("compliance_ref").isNotNull() | F.col("hipaa_reference").isNotNull())
        .groupBy("repo", "compliance_ref", "hipaa_reference")
        .agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    )
    failing = (
        counted.select(
            "repo", "n", "worst",
            F.explode(F.filter(
                _sections(),
                lambda s: F.when(s["framework"] == "HIPAA", F.col("hipaa_reference")).otherwise(F.col("compliance_ref")).contains(s["ref_substring"]),
            )).alias("s"),
        )
        .groupBy("repo", F.col("s.sec_ord").alias("sec_ord"))
        .agg(F.sum("n").alias("n"), F.max("worst").alias("worst"))
    )
    every = repos.select("repo").distinct().select("repo", F.explode(_sections()).alias("s")).select("repo", "s.*").drop("ref_substring")
    return every.join(failing, ["repo", "sec_ord"], "left").select(
        "repo", "framework", "sec_ord", "section", "title", "description",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("findings_count"),
        F.when(F.col("n") > 0, "fail").otherwise("pass").alias("status"),
        severity_name(F.col("worst")).alias("worst_severity"),
    )


def framework_summary(checklist: DataFrame) -> DataFrame:
    """Failing sections, sections and findings per framework."""
    failing = F.count_if(F.col("status") == "fail")
    return checklist.groupBy("repo", "framework").agg(
        failing.alias("sections_failing"), F.count("*").alias("sections_total"), F.sum("findings_count").alias("findings"),
        F.when(failing > 0, "At Risk").otherwise("No Issues Found").alias("compliance_status"),
    )
