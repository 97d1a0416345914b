"""Repository references: names, permitted roots, requests without files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How owner and repository are read from a hosting URL.  The
# first pattern wants the name at the end, the second takes what follows it.
REPO_AT_END = "github\\.com/([^/]+)/([^/]+?)(?:\\.git)?/?$"
REPO_ANYWHERE = "github\\.com/([^/]+)/([^/]+?)(?:\\.git)?/?.*"


def is_remote(source: Column) -> Column:
    return source.startswith("http://") | source.startswith("https://")


def repo_name(source: Column) -> Column:
    """``owner/name`` of a hosting URL, ``unknown_repo`` of another URL, else the last path segment."""
    def part(i: int) -> Column:
        at_end = F.regexp_extract(source, REPO_AT_END, i)
        return F.when(source.rlike(REPO_AT_END), at_end).otherwise(F.regexp_extract(source, REPO_ANYWHERE, i))

    owner, name = part(1), F.replace(part(2), F.lit(".git"), F.lit(""))
    remote = F.when((owner != "") & (name != ""), F.concat(owner, F.lit("/"), name)).otherwise("unknown_repo")
    local = F.regexp_extract(source, "([^/]*)/*$", 1)
    return F.when(is_remote(source), remote).otherwise(local)


def describe_sources(sources: DataFrame, column: str = "source") -> DataFrame:
    source = F.col(column)
    return sources.withColumn("source_type", F.when(is_remote(source), "github").otherwise("local")).withColumn("repo_name", repo_name(source))


def within_roots(paths: DataFrame, roots: str | Sequence[str] | None, column: str = "path") -> DataFrame:
    """Paths equal to or below one of the permitted roots; no roots means no restriction."""
    items = roots.split(",") if isinstance(roots, str) else list(roots or [])
    bases = [r.strip().rstrip("/") or "/" for r in items if r.strip()]
    if not bases:
        return paths
    path = F.col(column)
    allowed = F.lit(False)
    for base in bases:
        allowed = allowed | (path == base) | path.startswith(base if base == "/" else base + "/")
    return paths.where(allowed)


def without_files(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested repositories for which there is nothing to analyse."""
    return requested.join(files.select("repo").distinct(), "repo", "left_anti").select(
        "repo", F.lit("no analyzable code files found").alias("problem"),
    )
