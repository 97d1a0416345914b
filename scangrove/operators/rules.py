"""Upkeep of the rule catalog: listing, custom rules, patches, checks."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import SCANNERS, SEVERITIES
from ..functions.regexes import jvm_pattern
from ..functions.text import strip
from ..schemas import RULES

PATCHABLE = ["name", "pattern", "severity", "description", "recommendation", "language", "compliance_ref", "enabled"]


def list_rules(rules: DataFrame, scanner: str | None = None, search: str | None = None) -> DataFrame:
    """Rules of a scanner whose name or description contains a text, any case."""
    out = rules
    if scanner is not None:
        out = out.where(F.col("scanner") == scanner)
    if search:
        text = search.lower()
        out = out.where(F.lower("name").contains(text) | F.lower("description").contains(text))
    return out.orderBy("rule_ord")


def find_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("id") == rule_id)


def catalog_counts(rules: DataFrame) -> DataFrame:
    """Rules per scanner, and how many are disabled or custom."""
    return rules.groupBy("scanner").agg(
        F.count("*").alias("total"), F.count_if(~F.col("enabled")).alias("disabled"), F.count_if(~F.col("builtin")).alias("custom"),
    )


def check_pattern(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern cannot be used, or None; it must compile in both regex dialects."""
    try:
        re.compile(pattern)
        spark._jvm.java.util.regex.Pattern.compile(jvm_pattern(pattern, "\\n" in pattern or "\n" in pattern))
    except Exception as error:  # noqa: BLE001 - the JVM error type arrives wrapped
        return f"invalid regex: {str(error).splitlines()[0]}"
    return None


def add_rule(
    rules: DataFrame, name: str, pattern: str, severity: str, description: str, recommendation: str,
    language: str = "*", scanner: str = "security", rule_type: str = "dangerous", compliance_ref: str | None = None,
) -> DataFrame:
    """The catalog plus one custom rule with a fresh id."""
    problem = check_pattern(rules.sparkSession, pattern)
    if problem is None and severity not in SEVERITIES:
        problem = f"unknown severity: {severity}"
    if problem:
        raise ValueError(problem)
    fresh = rules.agg((F.coalesce(F.max("rule_ord"), F.lit(-1)) + 1).alias("rule_ord")).select(
        "rule_ord", F.uuid().alias("id"), *[F.lit(v).cast("string").alias(k) for k, v in (
            ("name", name), ("pattern", pattern), ("severity", severity), ("description", description),
            ("recommendation", recommendation), ("language", language), ("scanner", scanner),
            ("rule_type", rule_type), ("compliance_ref", compliance_ref),
        )], F.lit(True).alias("enabled"), F.lit(False).alias("builtin"),
    )
    # The id must not change each time the plan runs, so the new row is fixed here.
    row = tuple(fresh.select(*RULES.fieldNames()).first())
    return rules.unionByName(rules.sparkSession.createDataFrame([row], RULES))


def patch_rules(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Replace the fields that a patch row sets; null leaves a field alone."""
    have = [c for c in PATCHABLE if c in patches.columns]
    renamed = patches.select("id", *[F.col(c).alias(f"_{c}") for c in have])
    out = rules.join(renamed, "id", "left")
    for c in have:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*RULES.fieldNames())


def unknown_ids(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids that the catalog does not have."""
    return ids.select("id").join(rules.select("id"), "id", "left_anti")


def delete_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    """The catalog without one custom rule."""
    found = find_rule(rules, rule_id).select("builtin").head()
    if found is None:
        raise KeyError(rule_id)
    if found.builtin:
        raise ValueError(f"rule {rule_id} is built in; disable it instead")
    return rules.where(F.col("id") != rule_id)


def set_enabled(rules: DataFrame, enabled: bool) -> DataFrame:
    """I4."""
    return rules.withColumn("enabled", F.lit(enabled))


def extend_catalog(rules: DataFrame, more: DataFrame) -> DataFrame:
    """Append rules whose id is new and keep the others as they are."""
    return rules.unionByName(more.join(rules.select("id"), "id", "left_anti"))


def lint(rules: DataFrame) -> DataFrame:
    """Problems of a catalog as (id, problem) rows."""
    def blank(name: str):
        return F.coalesce(strip(F.col(name)), F.lit("")) == ""

    checks = [(blank(c), f"blank {c}") for c in ("name", "description", "recommendation", "pattern")]
    checks += [
        (~F.col("severity").isin(SEVERITIES), "unknown severity"),
        (~F.col("scanner").isin(SCANNERS), "unknown scanner"),
    ]
    problems = F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in checks]), lambda p: p.isNotNull())
    out = rules.select("id", F.explode(problems).alias("problem"))
    repeated = rules.groupBy("id").count().where("count > 1").select("id", F.lit("id is not unique").alias("problem"))
    return out.unionByName(repeated).unionByName(broken_patterns(rules))


def broken_patterns(rules: DataFrame) -> DataFrame:
    """id, problem of patterns that do not compile in one of the two regex dialects; tried in the tasks, for a catalog of any size."""
    @F.pandas_udf("problem string, jvm string")
    def tried(patterns: pd.Series) -> pd.DataFrame:
        rows = []
        for pattern in patterns:
            try:
                re.compile(pattern or "")
                rows.append((None, jvm_pattern(pattern or "", "\\n" in (pattern or "") or "\n" in (pattern or ""))))
            except re.error as error:
                rows.append((str(error), None))
        return pd.DataFrame(rows, columns=["problem", "jvm"])

    compiled = F.expr("try_reflect('java.util.regex.Pattern', 'compile', t.jvm)")
    why = F.coalesce("t.problem", F.when(F.col("t.jvm").isNotNull() & compiled.isNull(), "not a pattern of the JVM"))
    return (
        rules.select("id", tried("pattern").alias("t")).withColumn("why", why).where(F.col("why").isNotNull())
        .select("id", F.concat(F.lit("invalid regex: "), "why").alias("problem"))
    )
