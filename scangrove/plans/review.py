"""Reviews: what a scan finds and what a model answers, as one report.

A review takes the answers of the model as a table; asking it is not part of this project.  Answers meet the files by path, so an answer to a
file that is not there, or that was too large to be asked about, adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Rule
from ..operators.context import context_blocks
from ..operators.findings import file_findings
from ..operators.marks import suppress
from ..operators.packing import BUNDLE_TOKENS, mark_excluded, pack_bundle
from ..operators.prompts import file_prompts
from ..operators.responses import bundle_findings, file_review_findings, parse_responses, project_findings, review_summaries
from ..operators.scan import MAX_FILE_TOKENS, MODEL_PART, facts_of, hits_of, manifest_findings, scan_files, token_gate
from ..session import stored
from .report import Analysis, report_rows


class Review(NamedTuple):
    files: DataFrame  # facts of each file, with analyzed, skip_reason and summary
    findings: DataFrame  # of rules, of the model, and of manifests; marked ones are gone
    project: DataFrame  # issues of a project as a whole; neither marked nor scored
    repos: DataFrame
    answers: DataFrame  # repo, assessment, suggested
    mode: str


def review_prompts(files: DataFrame, context_tokens: int = 0, limit: int = MAX_FILE_TOKENS) -> DataFrame:
    """A prompt for each file that is small enough, with excerpts of what it imports if ``context_tokens`` allows for them (L2, K7)."""
    asked = token_gate(files, limit).where("analyzed")
    return file_prompts(asked, context_blocks(files, context_tokens) if context_tokens else None)


def _united(hits: DataFrame, model: DataFrame, marks: DataFrame | None, tree: DataFrame, repos: DataFrame) -> DataFrame:
    found = hits.unionByName(model)
    found = found if marks is None else suppress(found, marks)
    return stored(found.unionByName(manifest_findings(tree).join(repos, "repo", "left_semi")), "reviewed")


def per_file_review(
    tree: DataFrame, files: DataFrame, answers: DataFrame, project_answers: DataFrame, marks: DataFrame | None = None,
    rules: DataFrame | Sequence[Rule] | None = None,
) -> Review:
    """The review of each file by an answer of its own (repo, path, response) and of each repository by one (repo, response).

    A file has one answer, a repository has one.  Unreadable answers leave their fixed text as summary or assessment.
    """
    scanned = stored(scan_files(files, rules), "scan")
    facts = token_gate(facts_of(scanned))
    repos = facts.select("repo").distinct()
    asked = facts.where("analyzed").select("repo", "path", "file_ord")
    read = stored(parse_responses(answers.select("repo", "path", "response").join(asked, ["repo", "path"]), "file"), "answers")
    summaries = read.select("repo", "path", "summary")
    on_project = stored(parse_responses(project_answers.join(repos, "repo", "left_semi"), "project"), "project-answers")
    return Review(
        facts.join(summaries, ["repo", "path"], "left").withColumn("summary", F.coalesce("summary", F.lit(""))),
        _united(hits_of(scanned), file_review_findings(read), marks, tree, repos),
        project_findings(on_project), repos, on_project.select("repo", "assessment", "suggested"), "per_file",
    )


def bundle_review(
    tree: DataFrame, files: DataFrame, answers: DataFrame, marks: DataFrame | None = None,
    rules: DataFrame | Sequence[Rule] | None = None, budget: int = BUNDLE_TOKENS,
) -> Review:
    """The review of each repository by an answer (repo, response) on the bundle of its files that fit into the budget.

    Files with hits come into the bundle first, marked or not.  Files left out keep their hits and get a reason.  Issues are taken for
    files of the bundle only.  Where a repository has several answers, their issues are united, and the largest assessment and
    suggested score count.
    """
    scanned = stored(scan_files(files, rules), "scan")
    hits = hits_of(scanned)
    packed = stored(mark_excluded(pack_bundle(
        token_gate(facts_of(scanned), bundle=True), hits.select("repo", F.col("file").alias("path")).distinct(), budget)), "bundle")
    repos = packed.select("repo").distinct()
    read = stored(parse_responses(answers.join(repos, "repo", "left_semi"), "bundle"), "answers")
    found = _united(hits, bundle_findings(read, packed), marks, tree, repos)
    summaries = review_summaries(packed, found)
    return Review(
        packed.join(summaries, ["repo", "path"], "left").withColumn("summary", F.coalesce("summary", F.lit(""))),
        found, project_findings(read), repos,
        read.groupBy("repo").agg(F.max("assessment").alias("assessment"), F.max("suggested").alias("suggested")), "bundle",
    )


def review_rows(review: Review) -> DataFrame:
    """The report of each repository: counts, score, assessment, languages, checklists, and the number of project issues."""
    issues = review.project.groupBy("repo").agg(F.count("*").alias("project_issues"))
    return (
        report_rows(Analysis(review.files, review.findings, review.repos), review.mode, review.answers)
        .join(issues, "repo", "left").withColumn("project_issues", F.coalesce("project_issues", F.lit(0)))
    )


def file_entries(review: Review) -> DataFrame:
    """Each file with what was made of it and how many issues it has, of the model and in all."""
    counted = file_findings(review.findings).groupBy("repo", F.col("file").alias("path")).agg(
        F.count("*").alias("issues"), F.count_if(F.col("part_ord") == MODEL_PART).alias("model_issues"),
    )
    return review.files.join(counted, ["repo", "path"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("issues", "model_issues")})
