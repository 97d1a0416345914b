"""Prompt tables for a batch review by an external model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbered_listing
from ..schemas import REPORT_ORDER
from .ordering import first_n_per_group, skew_join

# Key version, and the numbers of files and issues a project prompt lists.
PROMPT_VERSION = "v1"
PROMPT_FILES = 30
PROMPT_ISSUES = 20
ISSUE_CHARS = 100


def framework_block(ids: Sequence[str] | None, instructions: Mapping[str, str], one: str = "", many: str = "") -> str:
    """The instruction texts of some frameworks under a header, parted by rules (L1).

    ``one`` and ``many`` are header texts with ``{names}`` in them.  Ids are
    taken in any case and with blanks around; an unknown id is an error.
    """
    wanted = [i.strip().lower() for i in ids or [] if i and i.strip()]
    unknown = [i for i in wanted if i not in instructions]
    if unknown:
        raise ValueError(f"unknown framework {unknown[0]!r}; known are {sorted(instructions)}")
    if not wanted:
        return ""
    header = (one if len(wanted) == 1 else many).format(names=", ".join(i.upper() for i in wanted))
    rule = "\n\n---\n\n"
    return f"{header}\n\n{rule.join(instructions[i] for i in wanted)}{rule}"


def file_prompts(files: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """One prompt per file, with its context block if there is one (L2)."""
    prompt = F.concat(
        F.lit("File: "), "path", F.lit("\nLanguage: "), "language", F.lit("\n\n```\n"), "content", F.lit("\n```"),
    )
    if contexts is None:
        return files.select("repo", "path", prompt.alias("user_prompt"))
    context = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("\n"), "context")).otherwise("")
    return files.join(contexts, ["repo", "path"], "left").select("repo", "path", F.concat(prompt, context).alias("user_prompt"))


def bundle_prompts(packed: DataFrame) -> DataFrame:
    """One prompt per repository with the numbered listings of its bundle (L3).

    The bundle has a token budget, so the collected text is limited in size.
    """
    listing = F.struct("late", "token_count", "file_ord", numbered_listing(F.col("path"), F.col("language"), F.col("content")).alias("text"))
    return (
        packed.where("in_bundle").groupBy("repo").agg(F.array_sort(F.collect_list(listing)).alias("_l"), F.count("*").alias("bundle_files"))
        .select("repo", "bundle_files", F.concat(
            F.lit("Analyze the following codebase:\n"), F.array_join(F.transform("_l", lambda x: x["text"]), ""),
        ).alias("user_prompt"))
    )


def project_prompts(summaries: DataFrame, representative: DataFrame) -> DataFrame:
    """One prompt per repository with file summaries and notable issues, both limited in number.

    ``summaries`` has repo, file_ord, path, language, summary, issue_count.
    """
    files = first_n_per_group(summaries, ["repo"], ["file_ord"], PROMPT_FILES, ["file_ord"])
    file_text = F.concat(
        F.lit("### "), "path", F.lit(" ("), "language", F.lit(")\nSummary: "), "summary",
        F.lit("\nIssues found: "), F.col("issue_count").cast("string"), F.lit("\n\n"),
    )
    file_part = files.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("file_ord", file_text.alias("text")))).alias("_f"))
    order = ["severity", "category", *REPORT_ORDER]
    issues = first_n_per_group(representative, ["repo"], order, PROMPT_ISSUES, REPORT_ORDER)
    issue_text = F.concat(
        F.lit("- ["), F.upper("severity"), F.lit("] "), "category", F.lit(": "), F.substring("description", 1, ISSUE_CHARS), F.lit("\n"),
    )
    issue_part = issues.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(*order, issue_text.alias("text")))).alias("_i"))
    body = F.array_join(F.transform("_f", lambda x: x["text"]), "")
    notable = F.when(F.col("_i").isNotNull(), F.concat(
        F.lit("\n## Notable Issues\n\n"), F.array_join(F.transform("_i", lambda x: x["text"]), ""),
    )).otherwise("")
    return file_part.join(issue_part, "repo", "left").select("repo", F.concat(
        F.lit("## File Summaries\n\n"), body, notable, F.lit("\n\nProvide your project-level assessment."),
    ).alias("user_prompt"))


def cache_key(provider: Column, model: Column, max_tokens: Column, system: Column, user: Column, version: str = PROMPT_VERSION) -> Column:
    """H4."""
    return F.sha2(F.concat_ws("\0", F.lit(version), provider, model, max_tokens.cast("string"), system, user), 256)


def with_keys(prompts: DataFrame, provider: str, model: str, system: str, max_tokens: int = 4096) -> DataFrame:
    lit = F.lit
    return prompts.withColumn("key", cache_key(lit(provider), lit(model), lit(max_tokens), lit(system), F.col("user_prompt")))


def look_up(keyed: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """Each distinct prompt once with its unexpired response, or null where the model must be asked.

    Equal prompts collapse before the join, on both sides of the shuffle.
    """
    distinct = keyed.groupBy("key").agg(F.min("user_prompt").alias("user_prompt"), F.count("*").alias("uses"))
    known = responses.groupBy("key").agg(F.max(F.struct("expires_at", "response")).alias("r")).select("key", "r.*")
    alive = F.col("expires_at") >= now
    return distinct.join(known, "key", "left").select(
        "key", "user_prompt", "uses", F.when(alive, F.col("response")).alias("response"),
        F.when(alive, "hit").when(F.col("expires_at").isNotNull(), "expired").otherwise("absent").alias("outcome"),
    )


def work_table(looked_up: DataFrame) -> DataFrame:
    """The prompts an external worker has to answer."""
    return looked_up.where(F.col("outcome") != "hit").select("key", "user_prompt")


def spread_responses(keyed: DataFrame, answered: DataFrame) -> DataFrame:
    """The response of each prompt row; a prompt shared by very many rows is spread over several tasks."""
    return skew_join(
        keyed.drop("user_prompt"), answered.select("key", "response"), ["key"], "left", ["repo", "path"],
    )


def cache_statistics(looked_up: DataFrame) -> DataFrame:
    """Hits, misses, stores and evictions of one batch; an expired entry is an eviction and a miss."""
    missed = F.count_if(F.col("outcome") != "hit")
    return looked_up.agg(
        F.count_if(F.col("outcome") == "hit").alias("hits"), missed.alias("misses"), missed.alias("stores"),
        F.count_if(F.col("outcome") == "expired").alias("evictions"),
    )


def store_responses(responses: DataFrame, fresh: DataFrame, now: Column, ttl_seconds: int = 7 * 24 * 3600) -> DataFrame:
    """The response table with new answers replacing old ones of the same key."""
    new = fresh.select("key", (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).cast("timestamp").alias("expires_at"), "response")
    return responses.join(new.select("key"), "key", "left_anti").unionByName(new)


def keep_latest(responses: DataFrame, max_entries: int = 1024) -> DataFrame:
    """The entries that expire last, at most so many."""
    return responses.orderBy(F.col("expires_at").desc(), "key").limit(max_entries)


def unexpired(responses: DataFrame, now: Column) -> DataFrame:
    """The entries that may still be used; written over the table they evict the others."""
    return responses.where(F.col("expires_at") >= now)


def response_size(responses: DataFrame, now: Column) -> DataFrame:
    """Entries of a response table, and how many of them have expired."""
    return responses.agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") < now).alias("expired"))
