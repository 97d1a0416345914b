"""URL filter: rules for hosts and paths, and a character language-model ratio for what no rule fits.

The longest rule that fits decides.  URLs that a rule accepts or rejects train two variable-order Markov models over a reduced
alphabet (lower-case letters, one sign for all digits, common punctuation, one sign for the rest): the probability of a
character after up to three others, each order smoothed with the next shorter one by the number of different continuations.  A URL's
score is the difference of its log likelihoods divided by its length; the limit is the middle between the mean scores of accepted and
rejected training URLs.

Only DataFrame operations.  The n-gram table has at most ``len(ALPHABET) ** 4`` rows whatever the input, so joining it by broadcast is
bounded; the characters of a URL are scored and added up in the task that reads it.

Null and empty URLs, and those without ``://``, have an empty host and path and fit no rule.  A null or empty URL is blocked; any
other is judged by its characters.  Without training URLs of both kinds the score is 0 and the limit 0, and the verdict is allow.
Repeated rows give repeated results; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangrove.llm.tokens import picked
from scangrove.session import stored

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_RULES = 1_000
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LETTERS + "0:/.-_?=&#%+~" + "*" + "^"    # digits are 0, anything else *, ^ stands before a URL
ORDER = 4


def lowered(text: Column) -> Column:
    return F.translate(text, LETTERS.upper(), LETTERS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, "(?s)^.*?://", ""), "?", 1)).otherwise("")
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "#", 1)
    host = F.substring_index(rest, "/", 1)
    return lowered(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def decide(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def signs(url: Column) -> Column:
    """A URL in the reduced alphabet, after as many starting signs as a character looks back."""
    reduced = F.regexp_replace(F.regexp_replace(lowered(url), "[0-9]", "0"), f"[^{LETTERS}0:/.\\-_?=&#%+~]", "*")
    return F.concat(F.lit("^" * (ORDER - 1)), reduced)


def grams(rows: DataFrame) -> DataFrame:
    """A row for each character of ``signs``: the character with those before it, as ``gram``."""
    at = F.explode(F.sequence(F.lit(1), F.length("signs") - (ORDER - 1)))
    return rows.where(F.length("signs") >= ORDER).select("*", at.alias("at")).withColumn("gram", F.substring("signs", F.col("at"), ORDER)).drop("at", "signs")


def ratios(counts: DataFrame) -> DataFrame:
    """Per gram the log of its probability when accepted over that when rejected; ``counts`` has gram, allow and block."""
    table = counts.withColumn("p_allow", F.lit(1.0 / len(ALPHABET))).withColumn("p_block", F.lit(1.0 / len(ALPHABET)))
    for order in range(1, ORDER + 1):
        last, before = F.substring("gram", ORDER - order + 1, order), F.substring("gram", ORDER - order + 1, order - 1)
        table = table.withColumn("last", last).withColumn("before", before)
        units = counts.groupBy(last.alias("last"), before.alias("before")).agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"))
        contexts = units.groupBy("before").agg(*(
            f(F.col(f"n_{k}")).alias(f"{x}_{k}") for k in ("allow", "block")
            for x, f in (("all", F.sum), ("kinds", lambda c: F.sum((c > 0).cast("long"))))
        ))
        table = table.join(units.drop("before"), "last").join(contexts, "before")
        for k in ("allow", "block"):
            smoothed = (F.col(f"n_{k}") + F.col(f"kinds_{k}") * F.col(f"p_{k}")) / (F.col(f"all_{k}") + F.col(f"kinds_{k}"))
            table = table.withColumn(f"p_{k}", F.when(F.col(f"all_{k}") > 0, smoothed).otherwise(F.col(f"p_{k}")))
        table = table.select(*counts.columns, "p_allow", "p_block")
    return table.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and score (null where the URL is)."""
    host, path = host_and_path(F.col("url"))
    rows = picked(pages, page_id=page_id, url=url).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = decide(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), says.alias("says"), signs(F.col("url")).alias("signs"))
    sums = lambda k: F.sum((F.col("says") == k).cast("long"))
    counts = stored(
        grams(rows.select("says", "signs")).groupBy("gram").agg(F.coalesce(sums("allow"), F.lit(0)).alias("allow"), F.coalesce(sums("block"), F.lit(0)).alias("block")), "url_grams",
    )
    table = stored(ratios(counts), "url_ratios")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    keys = ["row", "page_id", "url", "host", "path", "rule", "says"]
    scored = grams(numbered.select(*keys, "signs")).join(F.broadcast(table), "gram").groupBy(*keys).agg(F.sum("ratio").alias("total"), F.count("*").alias("length"))
    scored = scored.select("page_id", "host", "path", "rule", "says", (F.col("total") / F.col("length")).alias("score"))
    blank = rows.where("url IS NULL OR length(url) = 0").select("page_id", "host", "path", "rule", "says", F.lit(None).cast("double").alias("score"))
    scored = stored(scored.union(blank), "url_scores")
    ends = scored.groupBy().pivot("says", ["allow", "block"]).agg(F.avg("score"), F.count("score")).first()
    both = ends is not None and bool(ends[1]) and bool(ends[3])
    limit = (ends[0] + ends[2]) / 2 if both else 0.0
    score = F.col("score") if both else F.when(F.col("score").isNotNull(), F.lit(0.0))
    guess = F.when(F.coalesce(score >= limit, F.lit(False)), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", guess).alias("verdict"), score.alias("score"))


def url_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    return judge(pages)
