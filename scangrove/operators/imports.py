"""The import graph within each repository."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regexes import jvm_pattern
from ..session import stored
from .ordering import skew_join

# Module names that are never looked for in the repository.
OUTSIDE_MODULES = [
    "os", "sys", "re", "json", "typing", "collections", "functools", "pathlib", "itertools", "math", "datetime",
    "time", "logging", "unittest", "asyncio", "threading", "subprocess", "shutil", "tempfile", "io", "abc", "enum",
    "dataclasses", "copy", "weakref", "operator", "contextlib", "warnings", "urllib", "http", "email", "html",
    "textwrap", "string", "struct", "socket", "ssl", "select", "signal", "multiprocessing", "concurrent", "queue",
    "heapq", "bisect", "array", "types", "importlib", "pkgutil", "traceback", "inspect", "dis", "token", "tokenize",
    "symtable", "compileall", "py_compile", "compile", "cgi", "cgitb", "wsgiref", "xmlrpc", "pydoc", "doctest",
    "difflib", "pdb", "profile", "pstats", "timeit", "sched", "calendar", "locale", "gettext", "unicodedata",
    "stringprep", "pprint", "reprlib", "graphlib", "tomllib", "configparser", "argparse", "getopt", "getpass",
    "curses", "platform", "errno", "faulthandler", "tracemalloc", "gc", "sysconfig", "site", "zipimport", "runpy",
    "numpy", "pandas", "scipy", "requests", "urllib3", "httpx", "aiohttp", "flask", "django", "fastapi", "uvicorn",
    "starlette", "pydantic", "sqlalchemy", "alembic", "psycopg2", "pymysql", "redis", "celery", "boto3", "botocore",
    "aws", "azure", "google", "openai", "anthropic", "torch", "tensorflow", "sklearn", "matplotlib", "seaborn",
    "plotly", "yaml", "toml", "click", "typer", "rich", "loguru", "structlog", "pytest", "hypothesis", "tox", "nox",
    "coverage", "mypy", "ruff", "black", "isort", "pylint", "flake8", "gitpython", "github", "pathspec", "pyyaml",
    "python_multipart", "python-dotenv", "dotenv",
]

# Language labels with Python or script imports, the import forms
# of scripts, and the suffixes tried for them.
PYTHON_LABELS = ["python", "py"]
SCRIPT_LABELS = ["javascript", "typescript", "js", "ts", "jsx", "tsx"]
SCRIPT_IMPORT = (
    r"""import\s+(?:[\w*\s{},]*\s+from\s+)?['"]([^'"]+)['"]"""
    r"""|require\(\s*['"]([^'"]+)['"]\s*\)"""
    r"""|import\(\s*['"]([^'"]+)['"]\s*\)"""
)
SCRIPT_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def _modules(source: str) -> list[dict] | None:
    """Imported modules of one Python source, level by level of its syntax tree; none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                out += [{"spec": n.name, "top": n.name.partition(".")[0]} for n in names]
            case ast.ImportFrom(module=None, names=names):
                out += [{"spec": f".{n.name}", "top": None} for n in names]
            case ast.ImportFrom(module=module, level=level):
                out.append({"spec": "." * (level or 0) + module, "top": module.partition(".")[0]})
    return out


_MODULES = T.ArrayType(T.StructType([T.StructField("spec", T.StringType()), T.StructField("top", T.StringType())]))


@F.pandas_udf(_MODULES)
def python_modules(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else _modules(s))


def script_modules(source: Column) -> Column:
    """Relative and root-based module names of scripts in textual order (K2)."""
    pattern = F.lit(jvm_pattern(SCRIPT_IMPORT))
    groups = F.arrays_zip(*[F.regexp_extract_all(source, pattern, F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)])
    specs = F.transform(groups, lambda g: F.concat(g["g1"], g["g2"], g["g3"]))
    return F.filter(specs, lambda s: s.startswith(".") | s.startswith("/"))


def import_names() -> Column:
    """The names that a file imports, from the columns language and content: each once, in order; null for other languages.

    Only files that mention an import at all are handed to the Python parser.
    """
    label, content = F.lower("language"), F.col("content")
    python = label.isin(PYTHON_LABELS) & content.contains("import")
    script = label.isin(SCRIPT_LABELS) & (content.contains("import") | content.contains("require"))
    found = F.filter(python_modules(F.when(python, content)), lambda m: m["top"].isNull() | ~m["top"].isin(OUTSIDE_MODULES))
    # array_distinct keeps the first of equal names in place.
    return F.array_distinct(F.when(python, F.transform(found, lambda m: m["spec"])).when(script, script_modules(F.when(script, content))))


def import_edges(files: DataFrame) -> DataFrame:
    """repo, path, language, spec, spec_ord: the imports of every file, from one read of the contents."""
    return edges_of(files.select("repo", "path", "language", import_names().alias("specs")))


def edges_of(named: DataFrame) -> DataFrame:
    return named.select("repo", "path", "language", F.posexplode("specs").alias("spec_ord", "spec"))


def _normalised(parts: Column) -> Column:
    """Path parts without ``.`` and with ``..`` applied; null when they leave the repository."""
    return F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(p == "..", F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(p))),
    )


def _python_candidates() -> Column:
    spec = F.col("spec")
    dots = F.length(spec) - F.length(F.ltrim(spec, F.lit(".")))
    names = F.split(F.ltrim(spec, F.lit(".")), "\\.")
    above = F.size("_folder") - (dots - 1)
    start = F.when(dots == 0, F.array().cast("array<string>")).when(above >= 0, F.slice("_folder", 1, F.greatest(above, F.lit(0))))
    stem = F.array_join(F.filter(F.concat(start, names), lambda p: p != ""), "/")
    return F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))


def _script_candidates() -> Column:
    """From the columns ``_exact``, the path as written, and ``_stem``, the same without its suffix."""
    below = F.when(F.col("_exact") == "", "").otherwise(F.concat("_exact", F.lit("/")))
    return F.when(F.col("_exact").isNotNull(), F.array(
        *[F.concat("_stem", F.lit(s)) for s in SCRIPT_SUFFIXES], F.col("_exact"),
        *[F.concat(below, F.lit(f"index{s}")) for s in SCRIPT_SUFFIXES],
    ))


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The edges with ``target_path``: the first candidate that exists in the repository, else null.

    Candidates are joined with the file list by path.  A module that very many
    files import is spread over several tasks.
    """
    folder = F.split("path", "/")
    candidates = F.when(F.lower("language").isin(PYTHON_LABELS), _python_candidates()).otherwise(_script_candidates())
    start = F.when(F.col("spec").startswith("/"), F.array().cast("array<string>")).otherwise(F.col("_folder"))
    tried = (
        edges.withColumn("_folder", F.slice(folder, 1, F.size(folder) - 1))
        .withColumn("_exact", F.array_join(_normalised(F.concat(start, F.split("spec", "/"))), "/"))
        .withColumn("_stem", F.regexp_replace("_exact", "^((?:.*/)?[^/]+)\\.[^./]+$", "$1"))
        .select("repo", "path", "spec_ord", F.posexplode(candidates).alias("prio", "target_path"))
    )
    existing = files.select("repo", F.col("path").alias("target_path")).distinct()
    found = skew_join(tried, existing, ["repo", "target_path"], "inner", ["path", "spec_ord"])
    best = found.groupBy("repo", "path", "spec_ord").agg(F.min_by("target_path", "prio").alias("target_path"))
    return edges.join(best, ["repo", "path", "spec_ord"], "left")


def import_graph(files: DataFrame) -> DataFrame:
    """The resolved imports of all files, as a stored table: contents are read and parsed once."""
    return graph_of(stored(files.select("repo", "path", "language", import_names().alias("specs")), "imports"))


def graph_of(named: DataFrame) -> DataFrame:
    """The same from a stored table of all files with their ``specs``."""
    return stored(resolve_imports(stored(edges_of(named), "import-edges"), named.select("repo", "path")), "import-targets")


def degrees(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Imports of and by each file (K8)."""
    pairs = resolved.where(F.col("target_path").isNotNull()).select("repo", "path", "target_path").distinct()
    out = pairs.groupBy("repo", "path").agg(F.count("*").alias("out_degree"))
    into = pairs.groupBy("repo", F.col("target_path").alias("path")).agg(F.count("*").alias("in_degree"))
    zero = F.lit(0)
    return files.select("repo", "path").join(out, ["repo", "path"], "left").join(into, ["repo", "path"], "left").select(
        "repo", "path", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"),
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    """Imports without a file, and how many files ask for them (K8)."""
    return resolved.where(F.col("target_path").isNull()).groupBy("repo", "spec").agg(F.count("*").alias("importers"))
