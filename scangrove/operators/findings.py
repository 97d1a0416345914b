"""Views over findings: filters, rollups, report order and repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import severity_rank
from ..schemas import REPORT_ORDER
from ..session import stored
from .ordering import first_n_per_group

SHOWN_SEVERITIES = ("critical", "high", "medium", "low")
REPRESENTATIVES = 25


def search_findings(findings: DataFrame, text: str | None = None, severities: Sequence[str] = SHOWN_SEVERITIES) -> DataFrame:
    """Findings of some severities whose description, file or category contains a text, worst first."""
    out = findings.where(F.col("severity").isin(list(severities)))
    if text:
        needle = text.lower()
        out = out.where(
            F.lower("description").contains(needle) | F.lower("file").contains(needle) | F.lower("category").contains(needle),
        )
    return by_severity_order(out)


def by_severity_order(findings: DataFrame) -> DataFrame:
    """Worst first, then report order.

    A sort reads its input twice, to sample it and to sort it; findings are stored first, so that a scan below runs once.
    """
    return stored(findings, "to-sort").orderBy("repo", severity_rank(F.col("severity")).desc(), *REPORT_ORDER)


def in_report_order(findings: DataFrame) -> DataFrame:
    """F5; stored first as above."""
    return stored(findings, "to-sort").orderBy("repo", *REPORT_ORDER)


def file_findings(findings: DataFrame) -> DataFrame:
    """Findings that belong to a scanned file, so without the manifest notes."""
    return findings.where(F.col("part_ord") >= 0)


def issues_of_category(findings: DataFrame, project: DataFrame, category: str) -> DataFrame:
    """File and project issues of one category."""
    shared = [c for c in findings.columns if c in project.columns]
    both = file_findings(findings).select(*shared).unionByName(project.select(*shared))
    return both.where(F.col("category") == category)


def representatives(findings: DataFrame, n: int = REPRESENTATIVES) -> DataFrame:
    """The first critical and high findings of each repository, by severity text and category text (F2)."""
    serious = findings.where(F.col("severity").isin("critical", "high"))
    return first_n_per_group(serious, ["repo"], ["severity", "category", *REPORT_ORDER], n, REPORT_ORDER)


def file_rollup(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per file with its issues in report order, their number, and whether any is critical or high.

    A file is limited in size, and so is its issue list.
    """
    fields = ["category", "severity", "line", "description", "recommendation", "code_snippet", "source", "rule_id",
              "hipaa_reference", "compliance_ref"]
    per_file = file_findings(findings).groupBy("repo", F.col("file").alias("path")).agg(
        F.array_sort(F.collect_list(F.struct(F.struct(*REPORT_ORDER).alias("at"), F.struct(*fields).alias("issue")))).alias("_sorted"),
        F.count("*").alias("issue_count"),
        F.bool_or(F.col("severity") == "critical").alias("has_critical"),
        F.bool_or(F.col("severity") == "high").alias("has_high"),
    ).withColumn("issues", F.transform("_sorted", lambda x: x["issue"])).drop("_sorted")
    return files.drop("content").join(per_file, ["repo", "path"], "left").withColumns({
        "issue_count": F.coalesce("issue_count", F.lit(0)),
        "has_critical": F.coalesce("has_critical", F.lit(False)),
        "has_high": F.coalesce("has_high", F.lit(False)),
    })


def category_facets(findings: DataFrame) -> DataFrame:
    """Issues per file and category."""
    return file_findings(findings).groupBy("repo", "file", "category").agg(F.count("*").alias("issues"))


# Places of a report in which an issue is listed.
SECURITY_LIST, SECURITY_AGAIN, FILE_LIST, PROJECT_LIST = 0, 1, 2, 3


def report_multiset(findings: DataFrame, project: DataFrame | None = None, repeat: str = "report") -> DataFrame:
    """Issues as often as a report lists them, with the place of each copy.

    ``report``: the security list, then the file lists, then project issues, so
    a security issue of a file appears twice.  ``sarif_cli``: the security list
    takes file issues a second time.  ``unique``: each issue once.
    """
    of_file, security = F.col("part_ord") >= 0, F.col("category") == "security"
    if repeat == "unique":
        places = [F.when(of_file, F.lit(FILE_LIST)).otherwise(F.lit(SECURITY_LIST))]
    else:
        places = [F.when(security, F.lit(SECURITY_LIST)), F.when(of_file, F.lit(FILE_LIST))]
        if repeat == "sarif_cli":
            places.insert(1, F.when(security & of_file, F.lit(SECURITY_AGAIN)))
    listed = findings.withColumn("place", F.explode(F.array_compact(F.array(*places))))
    if project is None:
        return listed
    return listed.unionByName(project.withColumn("place", F.lit(PROJECT_LIST)), allowMissingColumns=True)
