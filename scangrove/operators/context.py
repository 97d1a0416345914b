"""Excerpts of imported files for the review of a file, within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN
from ..session import stored
from ..sources.tree import file_name
from .imports import graph_of, import_names
from .ordering import skew_join

# Budget, line limits, and the layout of the block.
CONTEXT_TOKENS = 2_000
FOOTER_TOKENS = 8
LONG_EXCERPT, SHORT_EXCERPT = 100, 30
HEADER = (
    "\n## Imported Context\n\nThe following definitions are imported into this file. "
    "Review them alongside the main content for accuracy.\n\n"
)
_AROUND = len("### `` (from ``)\n\n```\n\n```\n\n")


def _tokens(chars) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN).cast("bigint")


def excerpt(content: Column, name: Column, lines: int) -> Column:
    """The first lines of a file, with a note where it was cut (K6)."""
    whole = _lines(content)
    return _excerpt(whole, F.size(whole), name, lines)


def _lines(content: Column) -> Column:
    return F.split(F.regexp_replace(content, "\\n\\z", ""), "\n")


def _excerpt(first: Column, n_lines: Column, name: Column, lines: int) -> Column:
    note = F.concat(F.lit(f"\n... [truncated at {lines} of "), name, F.lit("]"))
    head = F.array_join(F.slice(first, 1, lines), "\n")
    return F.when(n_lines > lines, F.concat(head, note)).otherwise(head)


def module_facts(files: DataFrame) -> DataFrame:
    """All that imports and context blocks need of each file, from one read of the contents.

    The imported names, the first lines, how many lines there are, and the lengths of both excerpts.  Store it: only its lines are shuffled.
    """
    shown = files.select(
        "repo", "path", "language", import_names().alias("specs"), file_name(F.col("path")).alias("name"), _lines(F.col("content")).alias("_all"),
        F.col("content").isin("", "\n").alias("empty"),
    ).select("repo", "path", "language", "specs", "name", "empty", F.slice("_all", 1, LONG_EXCERPT).alias("head"), F.size("_all").alias("n_lines"))
    sizes = [F.length(_excerpt(F.col("head"), F.col("n_lines"), F.col("name"), n)).alias(kind)
             for kind, n in (("long", LONG_EXCERPT), ("short", SHORT_EXCERPT))]
    return shown.select("*", *sizes)


def file_heads(modules: DataFrame) -> DataFrame:
    """What an import of a file may show; empty files have no row."""
    return modules.where(~F.col("empty")).select("repo", F.col("path").alias("target_path"), "name", "head", "n_lines", "long", "short")


def context_choices(resolved: DataFrame, heads: DataFrame, max_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """Which imports of each file get a long or a short excerpt (the decisions of K7).

    Taken on the lengths in ``heads`` alone; no text is moved for imports that do not fit.
    """
    lengths = heads.select("repo", "target_path", "long", "short")
    # A target counts where it is imported first; an empty one is passed over.
    edges = resolved.where(F.col("target_path").isNotNull()).groupBy("repo", "path", "target_path").agg(
        F.min(F.struct("spec_ord", "spec")).alias("e"),
    ).select("repo", "path", "target_path", "e.*")
    sized = skew_join(edges, lengths, ["repo", "target_path"], "inner", ["path"])
    fixed = F.length("spec") + F.length(file_name(F.col("target_path"))) + _AROUND
    entry = F.struct(
        "spec_ord", "spec", "target_path", _tokens(fixed + F.col("long")).alias("long_cost"), _tokens(fixed + F.col("short")).alias("short_cost"),
    )
    start = -(-len(HEADER) // CHARS_PER_TOKEN) + FOOTER_TOKENS

    def step(acc: Column, x: Column) -> Column:
        fits_long = acc["used"] + x["long_cost"] <= max_tokens
        fits_short = acc["used"] + x["short_cost"] <= max_tokens
        cost = F.when(fits_long, x["long_cost"]).otherwise(x["short_cost"])
        picked = F.struct(
            x["spec_ord"].alias("spec_ord"), x["spec"].alias("spec"), x["target_path"].alias("target_path"),
            F.when(fits_long, LONG_EXCERPT).otherwise(SHORT_EXCERPT).alias("lines"), cost.alias("cost"),
        )
        return F.when(fits_long | fits_short, F.struct(
            (acc["used"] + cost).alias("used"), F.concat(acc["kept"], F.array(picked)).alias("kept"),
        )).otherwise(acc)

    empty = F.struct(
        F.lit(start).cast("bigint").alias("used"),
        F.array().cast("array<struct<spec_ord:int,spec:string,target_path:string,lines:int,cost:bigint>>").alias("kept"),
    )
    return (
        sized.groupBy("repo", "path").agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select("repo", "path", F.explode(F.aggregate("_entries", empty, step)["kept"]).alias("k"))
        .select("repo", "path", "k.*")
    )


def context_blocks(files: DataFrame, max_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """repo, path, context for every file; empty where nothing fits (K7).  The contents are read once."""
    everyone = files.select("repo", "path")
    if max_tokens <= 0:
        return everyone.withColumn("context", F.lit(""))
    modules = stored(module_facts(files), "modules")
    resolved, heads, everyone = graph_of(modules.select("repo", "path", "language", "specs")), file_heads(modules), modules.select("repo", "path")
    choices = stored(context_choices(resolved, heads, max_tokens), "context-choices")
    texts = heads.select("repo", "target_path", "name", "head", "n_lines").join(choices.select("repo", "target_path").distinct(), ["repo", "target_path"], "left_semi")
    chosen = skew_join(choices, texts, ["repo", "target_path"], "inner", ["path"])
    name = F.col("name")
    text = F.when(F.col("lines") == LONG_EXCERPT, _excerpt(F.col("head"), F.col("n_lines"), name, LONG_EXCERPT)).otherwise(
        _excerpt(F.col("head"), F.col("n_lines"), name, SHORT_EXCERPT),
    )
    section = F.concat(F.lit("### `"), "spec", F.lit("` (from `"), name, F.lit("`)\n\n```\n"), text, F.lit("\n```\n\n"))
    blocks = (
        chosen.select("repo", "path", F.struct("spec_ord", section.alias("text")).alias("s"))
        .groupBy("repo", "path").agg(F.array_sort(F.collect_list("s")).alias("_s"))
        .select("repo", "path", F.concat(F.lit(HEADER), F.array_join(F.transform("_s", lambda s: s["text"]), "")).alias("context"))
    )
    return everyone.join(blocks, ["repo", "path"], "left").withColumn("context", F.coalesce("context", F.lit("")))
