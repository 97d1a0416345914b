"""Model responses back into findings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import CATEGORIES, SEVERITIES
from ..functions.text import strip
from ..schemas import FINDINGS
from .scan import MODEL_PART

_ISSUES = "array<map<string,string>>"
_SHAPE = f"issues {_ISSUES}, project_level_issues {_ISSUES}, summary string, overall_assessment string, overall_risk_score string"

# The texts and the score used when a response cannot be read.
UNREADABLE = {
    "file": "[Parse Error] LLM response could not be parsed.",
    "bundle": "[Parse Error] Bundle analysis response could not be parsed.",
    "project": "Failed to generate project-level assessment due to response parsing error.",
}
UNREADABLE_SCORE = 50


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    """The JSON object that begins at the first brace of each text, whatever follows it."""
    decoder = json.JSONDecoder()

    def one(text):
        try:
            return None if text is None else json.dumps(decoder.raw_decode(text, text.index("{"))[0])
        except ValueError:
            return None
    return texts.map(one)


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def extract_json(responses: DataFrame, column: str = "response", into: str = "json") -> DataFrame:
    """The JSON in a response: all of it, a fenced object, or the object at the first brace; else null.

    The first three are plain expressions.  Only what they leave over is sent to
    the JSON decoder.
    """
    text = F.col(column)
    whole = _valid(strip(text))
    fences = [
        _valid(F.nullif(F.regexp_extract(text, f"(?s)```{tag}\\s*(\\{{.*?\\}})\\s*```", 1), F.lit(""))) for tag in ("json", "")
    ]
    easy = responses.withColumn("_easy", F.coalesce(whole, *fences))
    rest = F.when(F.col("_easy").isNull() & text.contains("{"), text)
    return easy.withColumn("_rest", _first_object(rest)).withColumn(into, F.coalesce("_easy", "_rest")).drop("_easy", "_rest")


def parse_responses(responses: DataFrame, kind: str, column: str = "response") -> DataFrame:
    """Add issues, project_issues, summary, assessment, suggested and readable."""
    parsed = extract_json(responses, column, "_json").withColumn("_p", F.from_json("_json", _SHAPE))
    readable = F.col("_json").isNotNull()
    none = F.array().cast(_ISSUES)
    lost = F.lit(UNREADABLE[kind])
    score = F.expr("try_cast(_p.overall_risk_score AS double)")
    return parsed.withColumns({
        "readable": readable,
        "issues": F.coalesce("_p.issues", none),
        "project_issues": F.coalesce("_p.project_level_issues", none),
        "summary": F.when(readable, F.coalesce("_p.summary", F.lit(""))).otherwise(lost if kind == "file" else F.lit("")),
        "assessment": F.when(readable, F.coalesce("_p.overall_assessment", F.lit(""))).otherwise(F.lit("") if kind == "file" else lost),
        "suggested": F.when(readable, score).otherwise(None if kind == "file" else float(UNREADABLE_SCORE)),
    }).drop("_json", "_p")


def _field(name: str, default: str | None) -> Column:
    """A field of an issue; the default stands for a missing field, not for an explicit null."""
    value = F.try_element_at("issue", F.lit(name))
    return F.when(F.map_contains_key("issue", name), value).otherwise(F.lit(default).cast("string"))


def normalise_issues(
    parsed: DataFrame, issues: str, file: Column, file_ord: Column, category: str, missing_file: str | None = None,
) -> DataFrame:
    """Issues of responses as findings; rows with an unknown category or severity are dropped.

    The array is built inside ``inline``: for a column of its own Spark derives a filter on non-empty arrays, and reads every response twice.
    """
    line = _field("line", None)
    number = F.expr("try_cast(try_element_at(issue, 'line') AS double)")
    placed = F.transform(issues, lambda issue, n: F.struct(n.alias("rule_ord"), issue.alias("issue")))
    rows = parsed.select("repo", file.alias("_file"), file_ord.alias("file_ord"), F.inline(placed))
    out = rows.select(
        "repo", "file_ord", F.lit(MODEL_PART).alias("part_ord"), F.col("rule_ord").cast("bigint").alias("rule_ord"),
        _field("category", category).alias("category"), _field("severity", "medium").alias("severity"),
        (F.col("_file") if missing_file is None else _field("file", missing_file)).alias("file"),
        number.cast("int").alias("line"),
        _field("description", "").alias("description"), _field("recommendation", "").alias("recommendation"),
        F.lit(None).cast("string").alias("code_snippet"), F.lit("llm").alias("source"),
        F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("hipaa_reference"),
        F.lit(None).cast("string").alias("compliance_ref"),
        (line.isNull() | (number == F.floor(number))).alias("_line_ok"),
    )
    return out.where(
        F.col("category").isin(CATEGORIES) & F.col("severity").isin(SEVERITIES) & F.col("_line_ok")
        & F.col("file").isNotNull() & F.col("description").isNotNull() & F.col("recommendation").isNotNull(),
    ).select(*FINDINGS.fieldNames())


def file_review_findings(parsed: DataFrame) -> DataFrame:
    """Findings of per-file reviews; the file is the one that was asked about."""
    return normalise_issues(parsed, "issues", F.col("path"), F.col("file_ord"), "bug")


def project_findings(parsed: DataFrame) -> DataFrame:
    """Project-level issues; they are neither suppressed nor scored."""
    return normalise_issues(parsed, "project_issues", F.lit(None).cast("string"), F.lit(None).cast("bigint"), "deployment", "project-wide")


def bundle_findings(parsed: DataFrame, packed: DataFrame) -> DataFrame:
    """Findings of bundle reviews on files that were in the bundle; others are dropped."""
    named = normalise_issues(parsed, "issues", F.lit(None).cast("string"), F.lit(None).cast("bigint"), "bug", "unknown").drop("file_ord")
    included = packed.where("in_bundle").select("repo", F.col("path").alias("file"), "file_ord")
    return named.join(included, ["repo", "file"]).select(*FINDINGS.fieldNames())


def review_summaries(packed: DataFrame, findings: DataFrame) -> DataFrame:
    """The sentence on model findings for each file of a bundle."""
    counted = findings.where(F.col("part_ord") == MODEL_PART).groupBy("repo", F.col("file").alias("path")).agg(F.count("*").alias("n"))
    text = F.when(F.col("n").isNull(), "No AI-detected issues.").otherwise(
        F.concat(F.col("n").cast("string"), F.lit(" AI-detected issue"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(".")),
    )
    return packed.where("in_bundle").select("repo", "path").join(counted, ["repo", "path"], "left").select("repo", "path", text.alias("summary"))
