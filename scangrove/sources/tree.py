"""Source trees as tables: reading, filtering and describing files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import count_lines
from ..operators.ordering import first_n_per_group, numbered
from ..schemas import FILES
from ..session import stored
from .ignore import drop_ignored

# --------------------------------------------------------------------------
# What counts as a code file, its language, and the folders that
# are never entered.
# --------------------------------------------------------------------------
CODE_SUFFIXES = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".cpp", ".c", ".h", ".cs", ".rb", ".php", ".swift",
    ".kt", ".scala", ".r", ".m", ".mm", ".sql", ".sh", ".bash", ".ps1", ".yaml", ".yml", ".json", ".xml", ".tf",
    ".dockerfile", ".md", ".rst", ".ini", ".cfg", ".toml",
]
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "React JSX", ".tsx": "React TSX",
    ".java": "Java", ".go": "Go", ".rs": "Rust", ".cpp": "C++", ".c": "C", ".h": "C/C++ Header", ".cs": "C#",
    ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".r": "R", ".sql": "SQL",
    ".sh": "Shell", ".bash": "Bash", ".ps1": "PowerShell", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON",
    ".xml": "XML", ".tf": "Terraform", ".dockerfile": "Dockerfile", ".md": "Markdown", ".rst": "reStructuredText",
    ".ini": "INI", ".cfg": "Config", ".toml": "TOML",
}
SKIPPED_DIRS = [
    "node_modules", "venv", ".venv", "env", "__pycache__", "dist", "build", ".git", ".github", ".vscode", ".idea",
    "target", "vendor", "coverage", "htmlcov", ".tox", ".pytest_cache", ".mypy_cache",
]


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last suffix in lower case; a leading dot alone starts a hidden name, not a suffix."""
    return F.lower(F.regexp_extract(file_name(path), "(?s)^.+(\\.[^.]+)$", 1))


def is_dockerfile(path: Column) -> Column:
    return F.lower(file_name(path)) == "dockerfile"


def is_code_file(path: Column) -> Column:
    """A4."""
    return is_dockerfile(path) | suffix(path).isin(CODE_SUFFIXES)


def detect_language(path: Column) -> Column:
    """A5."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(is_dockerfile(path), "Dockerfile").otherwise(F.coalesce(F.try_element_at(table, suffix(path)), F.lit("Unknown")))


def in_skipped_dir(path: Column, include_hidden: bool = False) -> Column:
    """Whether some folder above the file is never entered (A3)."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)

    def skipped(folder: Column) -> Column:
        named = folder.isin(SKIPPED_DIRS) | folder.endswith(".egg-info")
        return named if include_hidden else named | folder.startswith(".")

    return F.exists(folders, skipped)


def normalise_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\\r\\n?", "\n")).otherwise(text)


def decode(data: Column) -> Column:
    """UTF-8 bytes as text; invalid bytes are dropped, genuine replacement characters stay."""
    raw = data.cast("string")
    # Genuine replacement characters and the escape sign itself are escaped, so that only lost bytes show as replacement characters.
    lost, escape = "\ufffd", "\ufdd0"
    pairs = [(escape, escape + "\ufdd1"), (lost, escape + "\ufdd2")]
    cleaned = raw
    for plain, escaped in pairs:
        cleaned = F.replace(cleaned, F.lit(plain), F.lit(escaped))
    cleaned = F.replace(F.make_valid_utf8(cleaned), F.lit(lost), F.lit(""))
    for plain, escaped in reversed(pairs):
        cleaned = F.replace(cleaned, F.lit(escaped), F.lit(plain))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(cleaned)


def read_text(text: Column, max_chars: int | None = None) -> Column:
    """Text as a scan reads it: unified line ends, then, if asked for, the leading ``max_chars`` characters only."""
    whole = normalise_newlines(text)
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def source_files(
    tree: DataFrame, max_file_kb: int | None = None, include_hidden: bool = False, ignore_lines: DataFrame | None = None,
) -> DataFrame:
    """The files of a tree that are analysed, with their language.

    ``tree`` has repo, file_ord, path, size_bytes, content.  The predicates on
    path and size come before anything touches the content.
    """
    kept = tree.where(_is_source(max_file_kb, include_hidden))
    if ignore_lines is not None:
        kept = drop_ignored(kept, ignore_lines)
    return kept.withColumn("language", detect_language(F.col("path"))).select(*FILES.fieldNames())


def _within(max_file_kb: int | None) -> Column:
    return F.lit(True) if max_file_kb is None else F.col("size_bytes") <= max_file_kb * 1024


def _is_source(max_file_kb: int | None, include_hidden: bool) -> Column:
    path = F.col("path")
    keep = ~in_skipped_dir(path, include_hidden) & is_code_file(path) & _within(max_file_kb)
    return keep if include_hidden else keep & ~file_name(path).startswith(".")


def cap_files(files: DataFrame, max_files: int) -> DataFrame:
    """At most ``max_files`` files of each repository, in path order."""
    return first_n_per_group(files, ["repo"], ["path"], max_files, ["path"])


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root folder, local or by URI, and the folder in its terms."""
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _list_level(root: str, many: bool, hidden: bool):
    """Files and subfolders of some folders; folders that are never entered are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _opened(root)
        for batch in batches:
            for repo, folder, inside in batch.itertuples(index=False):
                rows = []
                for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                    is_folder, name = info.type == pafs.FileType.Directory, info.base_name
                    if many and repo is None:
                        # The folders at the top are the repositories.
                        rows += [(name, info.path, "", None, True)] if is_folder else []
                    elif is_folder:
                        linked = isinstance(fs, pafs.LocalFileSystem) and os.path.islink(info.path)
                        if name not in SKIPPED_DIRS and (hidden or not name.startswith(".")) and not linked:
                            rows.append((repo, info.path, f"{inside}{name}/", None, True))
                    elif info.type == pafs.FileType.File:
                        rows.append((repo, info.path, f"{inside}{name}", info.size, False))
                if rows:
                    yield pd.DataFrame(rows, columns=["repo", "full", "path", "size_bytes", "is_folder"])
    return run


def _read_files(root: str):
    """The bytes of the listed files, a few files at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _opened(root)

        def content(full: str) -> bytes:
            try:
                with fs.open_input_file(full) as f:
                    return f.read()
            except OSError as error:
                return f"[Error reading file: {error}]".encode()

        for batch in batches:
            for i in range(0, len(batch), 16):
                part = batch.iloc[i:i + 16]
                yield part.assign(data=part["full"].map(content)).drop(columns="full")
    return run


def walk_key(path: Column) -> Column:
    """Sorts paths as a walk meets them: the files of a folder by name, then its subfolders by name, each with all that is in it."""
    parts = F.concat(F.lit("\u0001"), F.replace(path, F.lit("/"), F.lit("\u0001")))
    return F.regexp_replace(parts, "\u0001([^\u0001]*)\\z", "\u0000$1")


def list_tree(spark: SparkSession, root: str, many: bool = False, include_hidden: bool = False) -> DataFrame:
    """repo, file_ord, path, size_bytes and full name of all files under a folder, without reading them (A1).

    The folder is one repository, or with ``many`` each folder in it is one.  It is a path that driver and executors can reach, as with a
    mounted share, or a URI of a store that Arrow's file systems know; names starting with ``_`` or ``.`` are seen, unlike by Spark's own
    file sources.  Folders are listed level by level: the folders of each level are dealt to all tasks anew, so a large
    repository is no task of its own, and the driver lists nothing.  ``file_ord`` numbers the files of a repository in walk order.
    """
    base = root.rstrip("/")
    _, top = _opened(base)
    level = spark.createDataFrame([(None if many else base.rsplit("/", 1)[-1], top, "")], "repo string, folder string, inside string")
    levels, folders = [], 1
    while folders:
        tasks = max(1, min(folders, 4 * spark.sparkContext.defaultParallelism))
        listed = level.repartition(tasks).mapInPandas(
            _list_level(base, many, include_hidden), "repo string, full string, path string, size_bytes bigint, is_folder boolean")
        levels.append(stored(listed, "folders"))
        level = levels[-1].where("is_folder").select("repo", F.col("full").alias("folder"), F.col("path").alias("inside"))
        folders = level.count()
    files = reduce(DataFrame.unionByName, levels).where("NOT is_folder").drop("is_folder").withColumn("_walk", walk_key(F.col("path")))
    return numbered(files, ["repo"], ["_walk"], "file_ord").select("repo", "file_ord", "path", "size_bytes", "full")


def read_listed(listed: DataFrame, root: str, max_file_kb: int | None = None) -> DataFrame:
    """The files listed below ``root`` with their text; files above the size limit are kept but not read.

    The list is spread evenly over the tasks that read, so a large repository
    is no hot spot.
    """
    spread_out = listed.repartition(listed.sparkSession.sparkContext.defaultParallelism)
    small = _within(max_file_kb)
    fields = "repo string, file_ord bigint, path string, size_bytes bigint, data binary"
    read = spread_out.where(small).mapInPandas(_read_files(root.rstrip("/")), fields).withColumn("content", read_text(decode(F.col("data")))).drop("data")
    return read.unionByName(spread_out.where(~small).drop("full").withColumn("content", F.lit("")))


def read_tree(
    spark: SparkSession, root: str, many: bool = False, max_file_kb: int | None = None, include_hidden: bool = False,
) -> DataFrame:
    """All files under a folder as a tree table (A1)."""
    return read_listed(list_tree(spark, root, many, include_hidden), root, max_file_kb)


def read_source_files(
    spark: SparkSession, root: str, many: bool = False, max_file_kb: int | None = None, include_hidden: bool = False,
    max_files: int | None = None,
) -> DataFrame:
    """The analysed files under a folder, chosen on the listing alone; no other file is read.

    Only the ignore files at the root of each repository are read beforehand.
    """
    listed = stored(list_tree(spark, root, many, include_hidden), "listing")
    ignored = ignore_file_lines(read_listed(listed.where(F.col("path") == ".gitignore"), root))
    kept = drop_ignored(listed.where(_is_source(max_file_kb, include_hidden)), ignored)
    if max_files is not None:
        kept = cap_files(kept, max_files)
    files = read_listed(kept, root, max_file_kb)
    return files.withColumn("language", detect_language(F.col("path"))).select(*FILES.fieldNames())


def read_objects(spark: SparkSession, root: str, many: bool = False, glob: str | None = None) -> DataFrame:
    """A tree through Spark's binary file source, for stores that only Spark reaches.

    That source passes over names starting with ``_`` or ``.``, so there is no ``__init__.py``; ``read_tree`` sees them.
    ``file_ord`` is a hash of the path, as the order of a walk would take a listing first.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    below = len(re.sub("^[a-z0-9]+:/+", "/", base)) + 2
    inside = F.substr(F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/"), F.lit(below))
    located = reader.load(base).select(
        (F.substring_index(inside, "/", 1) if many else F.lit(base.rsplit("/", 1)[-1])).alias("repo"),
        (F.regexp_replace(inside, "^[^/]*/", "") if many else inside).alias("path"),
        F.col("length").alias("size_bytes"), F.col("content").alias("data"),
    )
    order = F.shiftrightunsigned(F.xxhash64("path"), 1).alias("file_ord")
    return located.select("repo", order, "path", "size_bytes", read_text(decode(F.col("data"))).alias("content"))


def ignore_file_lines(tree: DataFrame) -> DataFrame:
    """The lines of each repository's root ignore file as repo, line_no, pattern."""
    lines = F.posexplode(F.split("content", "\n")).alias("line_no", "pattern")
    return tree.where(F.col("path") == ".gitignore").select("repo", lines)


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files and lines per language, skipped files included.

    Takes files with their content, or with a line_count counted before.
    """
    lines = F.col("line_count") if "line_count" in files.columns else count_lines(F.col("content"))
    return files.groupBy("repo", "language").agg(
        F.count("*").alias("file_count"), F.sum(lines).alias("line_count"), F.min("file_ord").alias("first_seen"),
    )
