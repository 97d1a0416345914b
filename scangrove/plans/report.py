"""From files to a report: the composed plan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Rule
from ..functions.text import count_lines
from ..operators.compliance import checklists
from ..operators.marks import suppress
from ..operators.scan import facts_of, hits_of, manifest_findings, scan_files, scan_rules, token_gate
from ..operators.score import file_counts, scores
from ..session import stored
from ..sources.tree import language_breakdown


class Analysis(NamedTuple):
    files: DataFrame  # repo, file_ord, path, language, size_bytes, token_count, analyzed, skip_reason, line_count
    findings: DataFrame
    repos: DataFrame


def analyse(
    tree: DataFrame, files: DataFrame, marks: DataFrame | None = None, rules: DataFrame | Sequence[Rule] | None = None,
    store: bool = False,
) -> Analysis:
    """Scan the files, drop marked findings, and add the manifest notes of the whole tree.

    Manifest notes are not subject to marks.  With ``store`` the texts are read
    once: hits and facts about files are written to the shared folder together
    and read back, which is the way to draw several results or an export from
    one scan.
    """
    if store:
        scanned = stored(scan_files(files, rules), "scan")
        found, facts = hits_of(scanned), facts_of(scanned)
    else:
        found = scan_rules(files, rules)
        facts = files.withColumn("line_count", count_lines(F.col("content")))
    if marks is not None:
        found = suppress(found, marks)
    manifests = manifest_findings(tree).join(facts.select("repo").distinct(), "repo", "left_semi")
    found = found.unionByName(manifests)
    facts = token_gate(facts).drop("content")
    if store:
        found = stored(found, "findings")
    return Analysis(facts, found, facts.select("repo").distinct())


def report_rows(analysis: Analysis, mode: str = "static", suggested: DataFrame | None = None) -> DataFrame:
    """One row per repository with counts, score, sentence, languages and checklists.

    ``suggested`` has a model's suggested score, and its assessment, if there is one, takes the place of the sentence.
    Findings are not nested here: they may be many.  They stay a table, and the
    sinks write them in parts.
    """
    scored = scores(analysis.findings, analysis.repos, suggested, mode == "static")
    if suggested is not None and "assessment" in suggested.columns:
        said = suggested.select("repo", F.nullif("assessment", F.lit("")).alias("_said"))
        scored = scored.join(said, "repo", "left").withColumn("assessment", F.coalesce("_said", "assessment")).drop("_said")
    languages = language_breakdown(analysis.files).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("file_count")).alias("o"), "first_seen", "language", "file_count", "line_count",
        ))).alias("_l"),
    ).select("repo", F.transform("_l", lambda x: F.struct(x["language"].alias("language"), x["file_count"].alias("file_count"), x["line_count"].alias("line_count"))).alias("languages"))
    sections = checklists(analysis.findings, analysis.repos).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct(
            "sec_ord", "framework", "section", "title", "description", "findings_count", "status", "worst_severity",
        ))).alias("checklist"),
    )
    return (
        scored.join(file_counts(analysis.files), "repo").join(languages, "repo").join(sections, "repo")
        .withColumn("total_issues_found", F.col("issues")).withColumn("analysis_mode", F.lit(mode))
    )
