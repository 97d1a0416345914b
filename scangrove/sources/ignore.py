"""Ignore files: glob lines as regexes, last matching line decides (A2)."""

from __future__ import annotations

import functools
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..session import stored

#: Lines of all repositories that are compiled in each task, and the lines of a slice if there are more.
MOST_LINES, SLICE = 200_000, 200


def glob_regex(line: str) -> str | None:
    """An anchored regex over relative file paths for one ignore line without its ``!``."""
    anchored = "/" in line.rstrip("/")
    folder_only = line.endswith("/")
    body = line.strip("/")
    if not body:
        return None
    out, i = [], 0
    while i < len(body):
        rest = body[i:]
        if rest == "**":
            out.append(".+")
            i += 2
        elif rest.startswith("**/") and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.+/)?")
            i += 3
        elif rest[0] == "*":
            out.append("[^/]*")
            i += len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            out.append("[^/]")
            i += 1
        elif rest[0] == "[" and (found := re.match(r"\[([!^]?)(\]?[^\]]*)\]", rest)):
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", found.group(2))
            out.append(f"[{'^' if found.group(1) else ''}{inner}]")
            i += found.end()
        else:
            if rest[0] == "\\" and len(rest) > 1:
                i += 1
            out.append(re.escape(body[i]))
            i += 1
    head = "" if anchored else "(?:.+/)?"
    tail = "/.*" if folder_only else "(?:/.*)?"
    return f"\\A{head}{''.join(out)}{tail}\\z"


def used_lines(lines: DataFrame) -> DataFrame:
    """repo, line_no, negated, regex: the lines that say something."""
    @F.pandas_udf(T.StringType())
    def to_regex(globs: pd.Series) -> pd.Series:
        return globs.map(glob_regex)

    text = strip(F.col("pattern"))
    return (
        lines.where((text != "") & ~F.col("pattern").startswith("#"))
        .select("repo", "line_no", text.startswith("!").alias("negated"), to_regex(F.regexp_replace(text, "^!", "")).alias("regex"))
        .where(F.col("regex").isNotNull())
    )


def _runs(lines: list[tuple[bool, str]]) -> list[tuple[bool, str]]:
    """Lines in order as runs of one kind, last first, each one regex."""
    runs = []
    for negated, group in groupby(reversed(lines), key=lambda x: x[0]):
        runs.append((negated, "|".join(f"(?:{regex})" for _, regex in group)))
    return runs


def _last_match(runs: list[tuple[bool, str]], path: str) -> bool | None:
    """Whether the last line that matches ignores the path; none if no line does."""
    return next((not negated for negated, regex in runs if _compiled(regex).search(path)), None)


@functools.lru_cache(maxsize=4096)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex.replace("\\z", "\\Z"))


def drop_ignored(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Files whose last matching ignore line is absent or negated (A2).

    Up to ``MOST_LINES`` lines, those of all repositories are shared with the tasks and compiled there, and nothing is shuffled: only repo
    and path are handed to the expression.  With more lines the paths, without their contents, meet slices of lines.
    """
    used = stored(used_lines(lines), "ignore-lines")
    if used.count() <= MOST_LINES:
        by_repo: dict[str, list[tuple[bool, str]]] = {}
        for r in used.orderBy("repo", "line_no").collect():
            by_repo.setdefault(r["repo"], []).append((r["negated"], r["regex"]))
        shared = files.sparkSession.sparkContext.broadcast({repo: _runs(of_repo) for repo, of_repo in by_repo.items()})

        @F.pandas_udf(T.BooleanType())
        def ignored(repos: pd.Series, paths: pd.Series) -> pd.Series:
            rules = shared.value
            return pd.Series([bool(_last_match(rules.get(repo, []), path)) for repo, path in zip(repos, paths, strict=True)])

        return files.where(~ignored("repo", "path"))
    return files.join(ignored_paths(files.select("repo", "path"), used), ["repo", "path"], "left_anti").select(*files.columns)


def ignored_paths(paths: DataFrame, used: DataFrame) -> DataFrame:
    """repo, path of the ignored files: each path is tried against slices of its repository's lines, and the last match of all slices decides."""
    line = F.struct("line_no", "negated", "regex")
    slices = used.withColumn("slice", F.floor(F.col("line_no") / SLICE)).groupBy("repo", "slice").agg(F.array_sort(F.collect_list(line)).alias("lines"))

    @F.pandas_udf(T.BooleanType())
    def decided(names: pd.Series, rules: pd.Series) -> pd.Series:
        out = []
        for path, of_slice in zip(names, rules, strict=True):
            out.append(_last_match(_runs([(x["negated"], x["regex"]) for x in of_slice]), path))
        return pd.Series(out, dtype="object")

    tried = paths.join(slices, "repo").withColumn("ignored", decided("path", "lines")).where(F.col("ignored").isNotNull())
    last = F.max(F.col("slice") * 2 + F.col("ignored").cast("int")).alias("last")
    return tried.groupBy("repo", "path").agg(last).where(F.col("last") % 2 == 1).select("repo", "path")
