"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import SEVERITIES, Rule, active, builtin_rules, rules_frame
from ..functions import text as X
from ..functions.text import description_hash
from ..operators import compliance, context, imports, packing, prompts, responses, score
from ..operators import findings as V
from ..operators import marks as M
from ..operators import rules as R
from ..operators.scan import facts_of, hits_of, manifest_findings, scan_files, scan_rules, token_gate
from ..schemas import FINDINGS, REPORT_ORDER, RESPONSES, RULES
from ..session import fresh_path, stored
from ..sources import repos, tree
from ..sources.tables import clear_table, read_table, replace_table
from ..streaming import scan as stream
from . import corpus, exports
from . import review as W
from .report import Analysis, analyse, report_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

HIT = ["repo", "file", "line", "rule_id"]
FIELDS = ["category", "severity", "description", "recommendation", "code_snippet", "source", "hipaa_reference", "compliance_ref"]
NOW = "TIMESTAMP '2024-01-04 00:00:00'"


def query(name: str):
    """Register a query; whole numbers are returned as bigint."""
    def register(build):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            small = (T.IntegerType, T.ShortType, T.ByteType)
            return df.select(*[
                F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name) for f in df.schema
            ])
        QUERIES[name] = run
        return build
    return register


def hits(spark: SparkSession, sf_dir: str, rules=None) -> DataFrame:
    return scan_rules(corpus.files(spark, sf_dir), rules)


def analysis(spark: SparkSession, sf_dir: str, store: bool = False) -> Analysis:
    return analyse(corpus.tree(spark, sf_dir), corpus.files(spark, sf_dir), corpus.marks(spark, sf_dir), store=store)


def model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.file_review_findings(responses.parse_responses(corpus.reviews(spark, sf_dir), "file"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.suppress(hits(spark, sf_dir), corpus.marks(spark, sf_dir))


def scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The kept hits and the facts about all files, from one stored scan."""
    both = stored(scan_files(corpus.files(spark, sf_dir)), "scan")
    return M.suppress(hits_of(both), corpus.marks(spark, sf_dir)), token_gate(facts_of(both))


def project_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project-level issues: the notes of all model reviews, lifted to the project."""
    return model_findings(spark, sf_dir).withColumn("file", F.lit("project-wide")).withColumn("line", F.lit(None).cast("int"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle of each repository; sizes and hits come from one read of the texts."""
    return packed_scan(stored(scan_files(corpus.files(spark, sf_dir)), "scan"))


def packed_scan(both: DataFrame) -> DataFrame:
    with_hits = hits_of(both).select("repo", F.col("file").alias("path")).distinct()
    return packing.pack_bundle(token_gate(facts_of(both), bundle=True), with_hits, 9_000)


# ---------------------------------------------------------------- sources

@query("a2_ignore_lines")
def _(spark, sf):
    lines = F.array(*[F.lit(x) for x in ("*.md", "!/src/1/*.md", "# a note", "src/3/", "f1?.py")])
    ignored = corpus.tree(spark, sf).select("repo").distinct().select("repo", F.posexplode(lines).alias("line_no", "pattern"))
    return tree.source_files(corpus.tree(spark, sf), ignore_lines=ignored).select("repo", "file_ord", "path")


@query("a3_directory_pruning")
def _(spark, sf):
    return corpus.tree(spark, sf).where(~tree.in_skipped_dir(F.col("path"))).select("repo", "file_ord", "path")


@query("a4_code_files")
def _(spark, sf):
    return corpus.tree(spark, sf).where(tree.is_code_file(F.col("path"))).select("repo", "path")


@query("a5_language_detection")
def _(spark, sf):
    return corpus.tree(spark, sf).select("repo", "path", tree.detect_language(F.col("path")).alias("language"))


@query("a6_size_filter")
def _(spark, sf):
    return tree.source_files(corpus.tree(spark, sf), max_file_kb=2).select("repo", "path", "language", "size_bytes")


@query("a7_file_cap")
def _(spark, sf):
    return tree.cap_files(corpus.files(spark, sf), 20).select("repo", "path")


@query("a8_read_text")
def _(spark, sf):
    text = tree.read_text(F.col("html"))
    return corpus.table(spark, sf, "pages").select("page_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


@query("a8_decoded_bytes")
def _(spark, sf):
    """Texts as bytes with an invalid sequence and the characters that decoding itself uses."""
    broken = F.unhex(corpus.pick(["FF", "E282", "C0AF", ""], F.col("doc_id")))
    data = F.concat(F.encode("text", "utf-8"), F.encode(F.lit("\ufdd0"), "utf-8"), broken, F.encode(F.lit("\ufdd2\ufffdz"), "utf-8"))
    text = tree.read_text(tree.decode(data))
    return corpus.table(spark, sf, "documents").select("doc_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def mark_file(spark, sf) -> str:
    """Marks as a file of JSON lines, each fifth broken."""
    path = fresh_path(spark, "marks")
    number = F.regexp_replace("id", "mark-", "").cast("bigint")
    line = F.to_json(F.struct("*"))
    corpus.marks(spark, sf).select(F.when(number % 5 == 4, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    return path


@query("a10_loaded_marks")
def _(spark, sf):
    return M.load_marks(spark, mark_file(spark, sf)).select("id", "repo", "file_path", "rule_id", "description_hash", "reason", "marked_by")


@query("a10_unread_marks")
def _(spark, sf):
    return M.unread_marks(spark, mark_file(spark, sf)).groupBy("problem").agg(F.count("*").alias("marks"))


@query("a11_repo_references")
def _(spark, sf):
    n = F.col("page_id").cast("string")
    source = (
        F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://github.com/owner"), n, F.lit("/repo"), n, F.lit(".git")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://github.com/owner"), n, F.lit("/repo"), n, F.lit("/tree/main")))
        .when(F.col("page_id") % 4 == 3, F.concat(F.lit("/srv/checkouts/repo"), n, F.lit("/")))
        .otherwise(F.col("url"))
    )
    return repos.describe_sources(corpus.table(spark, sf, "pages").select("page_id", source.alias("source")))


@query("a12_allowed_roots")
def _(spark, sf):
    paths = corpus.tree(spark, sf).select("repo", F.concat(F.lit("/"), "path").alias("path"))
    return repos.within_roots(paths, "/src/1, /src/3/,/node_modules,")


@query("a13_repos_without_files")
def _(spark, sf):
    asked = corpus.table(spark, sf, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string"), F.lit("-0")).alias("repo")).distinct()
    return repos.without_files(asked, corpus.files(spark, sf))


# ---------------------------------------------------------------- filters and projections

def exploded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(X.split_lines(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


@query("b1_lines")
def _(spark, sf):
    return exploded(corpus.files(spark, sf), "repo", "path").select("repo", "path", "line", F.md5("text").alias("digest"))


@query("b2_comment_lines")
def _(spark, sf):
    return exploded(corpus.files(spark, sf), "repo", "path").where(X.is_comment(F.col("text"))).select("repo", "path", "line")


@query("b3_stripped_lines")
def _(spark, sf):
    pages = corpus.table(spark, sf, "pages").select("page_id", F.col("html").alias("content"))
    return exploded(pages, "page_id").select("page_id", "line", F.md5(X.strip(F.col("text"))).alias("digest"))


@query("b4_active_rules")
def _(spark, sf):
    return hits(spark, sf, active(builtin_rules(), "security", "secret")).select(*HIT)


@query("b5_rule_listing")
def _(spark, sf):
    listed = R.list_rules(rules_frame(spark), search="CREDENTIAL")
    used = hits(spark, sf).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return listed.join(used, listed.id == used.rule_id, "left").select(
        "id", "name", "scanner", "severity", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("b6_severity_threshold")
def _(spark, sf):
    return score.at_least(hits(spark, sf), "high").select(*HIT, "severity")


@query("b7_issue_search")
def _(spark, sf):
    return V.search_findings(hits(spark, sf), "INJECTION", ["critical", "high"]).select(*HIT, "severity")


@query("b8_issues_by_category")
def _(spark, sf):
    return V.issues_of_category(model_findings(spark, sf), project_issues(spark, sf), "performance").select("repo", "file", "severity", "description")


@query("b9_token_gate")
def _(spark, sf):
    return token_gate(corpus.files(spark, sf), 1_000).select("repo", "path", "token_count", "analyzed", "skip_reason")


@query("b10_findings")
def _(spark, sf):
    return hits(spark, sf).select(*HIT, *FIELDS)


@query("b11_model_findings")
def _(spark, sf):
    return model_findings(spark, sf).select("repo", "file", "line", "category", "severity", "description", "recommendation", "source")


@query("b12_analyzed_and_skipped")
def _(spark, sf):
    gated = token_gate(corpus.files(spark, sf), 500)
    return gated.where("analyzed").groupBy("repo").agg(F.count("*").alias("files")).withColumn("kind", F.lit("analyzed")).unionByName(
        gated.where("not analyzed").groupBy("repo").agg(F.count("*").alias("files")).withColumn("kind", F.lit("skipped")))


# ---------------------------------------------------------------- matching and joins

@query("c1_line_rules")
def _(spark, sf):
    return hits(spark, sf, [r for r in builtin_rules() if not r.multiline]).select(*HIT)


@query("c2_whole_file_rules")
def _(spark, sf):
    return hits(spark, sf, [r for r in builtin_rules() if r.multiline]).select(*HIT)


@query("c3_language_scope")
def _(spark, sf):
    found = scan_rules(corpus.files(spark, sf), active(builtin_rules(), "security", "dangerous"), carry=["language"])
    return found.groupBy("rule_id", "language").agg(F.count("*").alias("hits"))


@query("c1_document_scan")
def _(spark, sf):
    docs = corpus.spread(corpus.table(spark, sf, "documents").select("doc_id", "source", "text"))
    files = docs.select(
        F.col("source").alias("repo"), F.col("doc_id").alias("file_ord"), F.col("doc_id").cast("string").alias("path"),
        F.lit("Markdown").alias("language"), tree.read_text(F.col("text")).alias("content"))
    return scan_rules(files).select(*HIT, "code_snippet")


@query("c1_page_scan")
def _(spark, sf):
    files = corpus.table(spark, sf, "pages").select(
        F.lit("web").alias("repo"), F.col("page_id").alias("file_ord"), F.col("url").alias("path"),
        F.lit("HTML").alias("language"), tree.read_text(F.col("html")).alias("content"))
    return scan_rules(files).select(F.col("file_ord").alias("page_id"), "line", "rule_id", "code_snippet")


@query("c1_conversation_scan")
def _(spark, sf):
    files = corpus.table(spark, sf, "conversations").select(
        F.col("role").alias("repo"), F.col("turn").alias("file_ord"), F.concat_ws("/", "conv_id", "turn").alias("path"),
        F.lit("Markdown").alias("language"), tree.read_text(F.col("text")).alias("content"))
    return scan_rules(files).select(*HIT)


@query("c4_suppress_by_rule")
def _(spark, sf):
    return kept(spark, sf).select(*HIT)


@query("c5_suppress_by_description")
def _(spark, sf):
    return M.suppress(model_findings(spark, sf), corpus.marks(spark, sf)).select("repo", "file", "line", "description")


@query("c6_checklists")
def _(spark, sf):
    a = analysis(spark, sf)
    return compliance.checklists(a.findings, a.repos).select(
        "repo", "framework", "section", "title", "findings_count", "status", "worst_severity")


def identified(spark, sf, a: Analysis | None = None):
    a = analysis(spark, sf, True) if a is None else a
    return stored(exports.sarif_ids(V.report_multiset(a.findings)), "identified")


@query("c7_rule_metadata")
def _(spark, sf):
    some = rules_frame(spark, [r for r in builtin_rules() if r.scanner != "cis"])
    return exports.sarif_rules(identified(spark, sf), some).drop("at")


@query("c9_bundle_findings")
def _(spark, sf):
    parsed = responses.parse_responses(corpus.reviews(spark, sf), "bundle")
    notes = parsed.withColumn("issues", F.transform("issues", lambda i: F.map_concat(i, F.create_map(F.lit("file"), F.col("path")))))
    return responses.bundle_findings(notes, packed(spark, sf)).select("repo", "file", "line", "description", "severity")


@query("c10_manifests")
def _(spark, sf):
    return manifest_findings(corpus.tree(spark, sf)).select("repo", "file", "severity", "description", "recommendation")


def keyed(spark, sf):
    """Prompts that are whole documents, some of them equal."""
    docs = corpus.table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("user_prompt"))
    return prompts.with_keys(docs, "provider", "model", "Be brief.", 4096)


def stored_responses(spark, sf):
    """Cached responses to the documents with an event of the same number; they expire at the event's time plus two days."""
    docs = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("user_prompt"))
    cached = prompts.with_keys(docs, "provider", "model", "Be brief.", 4096)
    return cached.join(corpus.table(spark, sf, "events").select("event_id", "ts"), "event_id").groupBy("key").agg(
        F.max(F.col("ts") + F.expr("INTERVAL 2 DAYS")).cast("timestamp").alias("expires_at"),
    ).select("key", "expires_at", F.concat(F.lit("answer "), "key").alias("response"))


def looked_up(spark, sf):
    return prompts.look_up(keyed(spark, sf), stored_responses(spark, sf), F.expr(NOW))


@query("c11_response_lookup")
def _(spark, sf):
    return looked_up(spark, sf).select("key", "uses", "outcome", "response")


# ---------------------------------------------------------------- aggregates

@query("d1_language_breakdown")
def _(spark, sf):
    return tree.language_breakdown(corpus.files(spark, sf))


@query("d2_risk_score")
def _(spark, sf):
    a = analysis(spark, sf)
    return score.scores(a.findings, a.repos).select("repo", "issues", "risk_score")


@query("d2_risk_score_with_suggestion")
def _(spark, sf):
    found = hits(spark, sf, active(builtin_rules(), "gdpr"))
    every = corpus.files(spark, sf).select("repo").distinct()
    hint = corpus.files(spark, sf).groupBy("repo").agg((F.max("file_ord") % 160 - 20.5).alias("suggested"))
    return score.scores(found, every, hint, static_only=False).select("repo", "issues", "risk_score", "risk_band", "assessment")


@query("d3_checklist_totals")
def _(spark, sf):
    a = analysis(spark, sf)
    return compliance.checklists(a.findings, a.repos).groupBy("framework", "section", "status").agg(
        F.count("*").alias("repos"), F.sum("findings_count").alias("findings"))


@query("d4_assessment")
def _(spark, sf):
    a = analysis(spark, sf)
    return score.scores(a.findings, a.repos).select("repo", "critical", "high", "medium", "low", "info", "assessment")


@query("d5_file_counts")
def _(spark, sf):
    return score.file_counts(token_gate(corpus.files(spark, sf)))


@query("d6_framework_summary")
def _(spark, sf):
    a = analysis(spark, sf)
    return compliance.framework_summary(compliance.checklists(a.findings, a.repos))


@query("d7_file_rollup")
def _(spark, sf):
    found, facts = scanned(spark, sf)
    rolled = V.file_rollup(facts, found)
    ids = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["rule_id"], i["line"])), " ")
    return rolled.select("repo", "path", "language", "token_count", "issue_count", "has_critical", "has_high", F.coalesce(ids, F.lit("")).alias("issue_list"))


@query("d8_category_facets")
def _(spark, sf):
    return V.category_facets(hits(spark, sf).unionByName(model_findings(spark, sf)))


@query("d9_catalog_usage")
def _(spark, sf):
    used = hits(spark, sf).select(F.col("rule_id").alias("id"), "repo").groupBy("id").agg(F.count("*").alias("n"))
    patched = R.set_enabled(rules_frame(spark), True).withColumn("enabled", F.col("rule_type") != "secret")
    counted = R.catalog_counts(patched)
    return counted.join(rules_frame(spark).join(used, "id").groupBy("scanner").agg(F.sum("n").alias("findings")), "scanner", "left")


@query("d10_gate")
def _(spark, sf):
    found = hits(spark, sf, active(builtin_rules(), "gdpr"))
    return score.gate(found, corpus.files(spark, sf), "medium", "high")


@query("d11_cache_statistics")
def _(spark, sf):
    return prompts.cache_statistics(looked_up(spark, sf))


@query("d12_risk_bands")
def _(spark, sf):
    found = hits(spark, sf, active(builtin_rules(), "soc2"))
    return score.scores(found, corpus.files(spark, sf)).groupBy("risk_band").agg(F.count("*").alias("repos"))


@query("d13_mark_count")
def _(spark, sf):
    return M.mark_count(corpus.marks(spark, sf))


@query("d2_order_volume")
def _(spark, sf):
    """The score at volume: orders as findings of their customer."""
    orders = corpus.table(spark, sf, "orders")
    severity = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    found = orders.select(F.col("o_custkey").cast("string").alias("repo"), F.lit("security").alias("category"), severity.alias("severity"))
    return score.scores(found, found).select("repo", "issues", "critical", "high", "risk_score", "risk_band")


# ---------------------------------------------------------------- order-dependent

@query("e1_synthetic_ids")
def _(spark, sf):
    found = hits(spark, sf).unionByName(model_findings(spark, sf)).unionByName(manifest_findings(corpus.tree(spark, sf)))
    return exports.sarif_ids(V.report_multiset(stored(found, "findings"))).where("rule_id IS NULL").select("repo", "place", "file", "line", "description", "sarif_rule_id")


@query("e2_first_issue_per_rule")
def _(spark, sf):
    firsts = exports.sarif_rules(identified(spark, sf), rules_frame(spark))
    return firsts.select("repo", "id", F.col("at.file_ord").alias("file_ord"), F.col("at.line").alias("line"))


@query("e3_distinct_imports")
def _(spark, sf):
    return imports.import_edges(corpus.module_tree(spark, sf)).select("path", "spec_ord", "spec")


@query("e4_bundle_packing")
def _(spark, sf):
    return packed(spark, sf).select("repo", "path", "token_count", "in_bundle")


@query("e5_first_mark_wins")
def _(spark, sf):
    first = corpus.marks(spark, sf)
    again = first.withColumn("id", F.concat(F.lit("again-"), "id")).withColumn("marked_at", F.col("marked_at") - F.expr("INTERVAL 1 DAY"))
    return M.add_marks(first.where("marked_by IS NULL"), first.unionByName(again)).select("id", "repo", "file_path", "rule_id", "description_hash")


@query("e6_latest_responses")
def _(spark, sf):
    return prompts.keep_latest(stored_responses(spark, sf), 100).select("key")


@query("f1_languages_by_files")
def _(spark, sf):
    files = corpus.files(spark, sf).withColumn("repo", F.lit("all"))
    return tree.language_breakdown(files).select("language", "file_count", "line_count").orderBy(F.desc("file_count"))


@query("f2_representatives")
def _(spark, sf):
    return V.representatives(kept(spark, sf).unionByName(model_findings(spark, sf)), 25).select("repo", "severity", "category", "file", "line", "description")


@query("f4_by_severity")
def _(spark, sf):
    return V.by_severity_order(kept(spark, sf)).select(*HIT, "severity")


@query("f5_report_order")
def _(spark, sf):
    return V.in_report_order(analysis(spark, sf).findings).select("repo", *REPORT_ORDER, "file", "rule_id")


@query("g1_scanner_union")
def _(spark, sf):
    return hits(spark, sf).groupBy("source").agg(F.count("*").alias("findings"), F.count_distinct("repo").alias("repos"))


@query("g2_report_multiset")
def _(spark, sf):
    a = analysis(spark, sf)
    return V.report_multiset(a.findings, project_issues(spark, sf)).groupBy("repo", "place").agg(F.count("*").alias("issues"))


@query("g2_sarif_multiset")
def _(spark, sf):
    return V.report_multiset(analysis(spark, sf).findings, repeat="sarif_cli").groupBy("repo", "place").agg(F.count("*").alias("issues"))


@query("g3_extended_catalog_scan")
def _(spark, sf):
    base = rules_frame(spark, [r for r in builtin_rules() if r.scanner == "pci"])
    more = [Rule(900, "pci-004", "n", "never", "low", "d", "r", "*", "pci", "compliance", None),
            Rule(901, "word-des", "Word", "(?i)des", "info", "the word", "none", "*", "cis", "compliance", "CIS v8 3 words")]
    return hits(spark, sf, R.extend_catalog(base, rules_frame(spark, more))).select(*HIT)


# ---------------------------------------------------------------- scalar functions

@query("h1_token_estimates")
def _(spark, sf):
    return corpus.table(spark, sf, "conversations").select("conv_id", "turn", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("h2_line_counts")
def _(spark, sf):
    return corpus.table(spark, sf, "pages").select("page_id", X.count_lines(F.col("html")).alias("lines"))


@query("h3_description_hashes")
def _(spark, sf):
    return corpus.table(spark, sf, "benchmark").select("item_id", description_hash(F.col("text")).alias("hash"))


@query("h4_cache_keys")
def _(spark, sf):
    return keyed(spark, sf).select("path", "key")


@query("h5_sarif_levels")
def _(spark, sf):
    return hits(spark, sf).groupBy("severity", X.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))


@query("h6_slugs")
def _(spark, sf):
    return corpus.table(spark, sf, "benchmark").select("item_id", X.slug(F.col("text")).alias("slug"))


@query("h8_compliance_labels")
def _(spark, sf):
    return hits(spark, sf).groupBy(X.compliance_label(F.col("compliance_ref")).alias("label")).agg(F.count("*").alias("n"))


@query("h9_numbered_listings")
def _(spark, sf):
    listing = X.numbered_listing(F.col("path"), F.col("language"), F.col("content"))
    return corpus.files(spark, sf).select("repo", "path", F.length(listing).alias("chars"), F.md5(listing).alias("digest"))


@query("h10_locations")
def _(spark, sf):
    return analysis(spark, sf).findings.select(
        "repo", X.location(F.col("file"), F.col("line")).alias("location"), X.severity_tag(F.col("severity")).alias("tag"), "rule_id")


# ---------------------------------------------------------------- table upkeep

def pci_rules(spark):
    return rules_frame(spark, [r for r in builtin_rules() if r.scanner == "pci"])


@query("i1_added_rule_scan")
def _(spark, sf):
    more = R.add_rule(pci_rules(spark), "Word", "(?i)des", "info", "the word", "none", scanner="cis", rule_type="compliance")
    return hits(spark, sf, more).select("repo", "file", "line", "severity", "description")


@query("i3_deleted_rule_scan")
def _(spark, sf):
    own = [Rule(900, "word-des", "Word", "(?i)des", "info", "the word", "none", "*", "cis", "compliance", None),
           Rule(901, "word-key", "Key", "(?i)key", "low", "the key", "none", "*", "cis", "compliance", None)]
    more = rules_frame(spark, own).withColumn("builtin", F.lit(False))
    return hits(spark, sf, R.delete_rule(R.extend_catalog(pci_rules(spark), more), "word-des")).select(*HIT)


@query("i5_catalog_lint")
def _(spark, sf):
    """A catalog with a rule for each document, with some of everything that can be wrong."""
    n = F.col("doc_id")
    made = {
        "rule_ord": n, "id": F.concat(F.lit("n-"), (n - F.when(n % 10 == 9, 1).otherwise(0)).cast("string")), "name": F.when(n % 7 == 3, "  ").otherwise(F.col("source")),
        "pattern": F.when(n % 4 == 0, F.concat("source", F.lit("("))).when(n % 4 == 2, "").when(n % 3 == 1, F.concat(F.lit("(?i)"), "source", F.lit("\\s+\\w"))).otherwise(F.col("source")),
        "severity": corpus.pick([*SEVERITIES, "urgent"], n), "description": F.when(n % 11 == 5, "\n").otherwise(F.lit("a document")), "recommendation": F.when(n % 9 != 1, "none"),
        "language": F.lit("*"), "scanner": corpus.pick(["pci", "cis", "other"], n), "rule_type": F.lit("compliance"),
        "compliance_ref": F.lit(None), "enabled": F.lit(True), "builtin": F.lit(False),
    }
    rules = corpus.table(spark, sf, "documents").select(*[made[f.name].cast(f.dataType).alias(f.name) for f in RULES])
    return R.lint(rules).select("id", F.substring_index("problem", ":", 1).alias("problem"))


@query("i9_cleared_marks")
def _(spark, sf):
    return M.suppress(hits(spark, sf), M.clear(corpus.marks(spark, sf))).select(*HIT)


def response_table(spark, sf) -> str:
    """The cached responses as a stored table."""
    path = fresh_path(spark, "responses")
    replace_table(stored_responses(spark, sf), path)
    return path


@query("i9_cleared_responses")
def _(spark, sf):
    """Entries of a response table as it is, cleared, and filled again by the answers to all prompts."""
    path = response_table(spark, sf)
    kept = read_table(spark, path, RESPONSES).agg(F.count("*").alias("entries"))
    clear_table(spark, path, RESPONSES)
    cleared = read_table(spark, path, RESPONSES)
    asked = prompts.work_table(prompts.look_up(keyed(spark, sf), cleared, F.expr(NOW)))
    replace_table(prompts.store_responses(cleared, asked.select("key", F.lit("fresh").alias("response")), F.expr(NOW)), path)
    refilled = read_table(spark, path, RESPONSES).agg(F.count("*").alias("refilled"))
    return kept.join(cleared.agg(F.count("*").alias("cleared"))).join(refilled)


@query("i9_response_size")
def _(spark, sf):
    """Entries, expired entries, and entries left once those are gone."""
    path = response_table(spark, sf)
    size = prompts.response_size(read_table(spark, path, RESPONSES), F.expr(NOW))
    replace_table(prompts.unexpired(read_table(spark, path, RESPONSES), F.expr(NOW)), path)
    return size.join(read_table(spark, path, RESPONSES).agg(F.count("*").alias("left_over")))


@query("i2_patched_catalog_scan")
def _(spark, sf):
    patch = spark.sql("SELECT * FROM VALUES ('pci-004', 'low', true), ('owasp-005', NULL, false), ('cis-020', 'info', NULL) t(id, severity, enabled)")
    return hits(spark, sf, R.patch_rules(rules_frame(spark), patch)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("i4_disabled_catalog_scan")
def _(spark, sf):
    off = R.set_enabled(rules_frame(spark), False)
    on = spark.sql("SELECT * FROM VALUES ('pci-000', true), ('sec-secret-001', true) t(id, enabled)")
    return hits(spark, sf, R.patch_rules(off, on)).select(*HIT)


@query("i6_added_marks")
def _(spark, sf):
    old = corpus.marks(spark, sf)
    new = old.withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("rule_id", F.when(F.col("rule_id") == "pci-004", "cis-020").otherwise(F.col("rule_id")))
    broken = old.withColumn("id", F.concat(F.lit("bad-"), "id")).withColumn("rule_id", F.lit(None).cast("string")).withColumn("description_hash", F.lit(None).cast("string"))
    return M.add_marks(old, new.unionByName(broken)).select("id", "repo", "file_path", "rule_id", "description_hash")


@query("i6_invalid_marks")
def _(spark, sf):
    both = corpus.marks(spark, sf).withColumn("rule_id", F.coalesce("rule_id", F.lit("pci-004")))
    return M.invalid_marks(both).select("id", "problem")


@query("i7_removed_marks")
def _(spark, sf):
    ids = corpus.table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("mark-"), F.col("doc_id").cast("string")).alias("id"))
    return M.remove_marks(corpus.marks(spark, sf), ids).select("id", "repo", "file_path")


@query("i7_removal_results")
def _(spark, sf):
    ids = corpus.table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("mark-"), F.col("doc_id").cast("string")).alias("id"))
    return M.removal_result(corpus.marks(spark, sf), ids)


@query("i8_mark_list")
def _(spark, sf):
    return M.list_marks(corpus.marks(spark, sf)).select("id", "repo", "file_path", "rule_id", "description_hash", "reason", "marked_by")


# ---------------------------------------------------------------- reports

@query("j1_sarif_results")
def _(spark, sf):
    return exports.sarif_results(identified(spark, sf)).drop(*REPORT_ORDER)


@query("j2_sarif_rules")
def _(spark, sf):
    return exports.sarif_rules(identified(spark, sf), rules_frame(spark)).drop("at")


def header(a: Analysis):
    return score.file_counts(a.files).select(
        "repo", "total_files_analyzed", F.lit("local").alias("source_type"), F.lit("static").alias("analysis_mode"))


@query("j3_sarif_document")
def _(spark, sf):
    """The document's rules and results, as read back from its text."""
    a = analysis(spark, sf, True)
    return exports.sarif_fields(exports.sarif_document(identified(spark, sf, a), rules_frame(spark), header(a)))


def per_file_review(spark, sf) -> W.Review:
    return W.per_file_review(
        corpus.tree(spark, sf), corpus.files(spark, sf), corpus.reviews(spark, sf), corpus.project_answers(spark, sf), corpus.marks(spark, sf))


def bundle_review(spark, sf) -> W.Review:
    return W.bundle_review(corpus.tree(spark, sf), corpus.files(spark, sf), corpus.bundle_answers(spark, sf), corpus.marks(spark, sf), budget=9_000)


@query("j4_json_report")
def _(spark, sf):
    """Reports, files and issues, as read back from the text of the documents."""
    made = per_file_review(spark, sf)
    pieces = exports.json_report(W.review_rows(made), made.files, made.findings, made.project, "high", F.lit("2024-01-01T00:00:00"))
    return exports.json_fields(pieces)


@query("j5_text_report")
def _(spark, sf):
    a = analysis(spark, sf, True)
    return exports.text_report(a.findings, report_rows(a), "high")


@query("j6_markdown_report")
def _(spark, sf):
    a = analysis(spark, sf, True)
    return exports.markdown_report(a.findings, report_rows(a), a.files, None, F.lit("2024-01-01T00:00:00"))


@query("j7_report_rows")
def _(spark, sf):
    rows = report_rows(analysis(spark, sf, True))
    langs = F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["language"], x["file_count"], x["line_count"])), " ")
    fails = F.size(F.filter("checklist", lambda c: c["status"] == "fail"))
    return rows.select(
        "repo", "issues", "critical", "high", "risk_score", "risk_band", "total_files_analyzed", "total_files_skipped",
        langs.alias("languages"), fails.alias("sections_failing"))


def review_summary(made: W.Review):
    fails = F.size(F.filter("checklist", lambda c: c["status"] == "fail"))
    return W.review_rows(made).select(
        "repo", "issues", "critical", "high", "risk_score", "risk_band", "assessment", "total_files_analyzed", "total_files_skipped", "project_issues",
        fails.alias("sections_failing"), F.aggregate("languages", F.lit(0).cast("bigint"), lambda n, x: n + x["line_count"]).alias("lines"), "analysis_mode")


@query("j7_per_file_report")
def _(spark, sf):
    return review_summary(per_file_review(spark, sf))


@query("j7_bundle_report")
def _(spark, sf):
    return review_summary(bundle_review(spark, sf))


def entry_columns(made: W.Review):
    return W.file_entries(made).select("repo", "path", "token_count", "analyzed", "skip_reason", "summary", "issues", "model_issues")


@query("j7_per_file_entries")
def _(spark, sf):
    return entry_columns(per_file_review(spark, sf))


@query("j7_bundle_entries")
def _(spark, sf):
    return entry_columns(bundle_review(spark, sf))


@query("j8_stored_findings_export")
def _(spark, sf):
    """A stored report is exported again without a scan."""
    path = fresh_path(spark, "findings")
    analysis(spark, sf).findings.write.parquet(path)
    again = spark.read.schema(FINDINGS).parquet(path)
    return exports.sarif_results(exports.sarif_ids(V.report_multiset(again))).drop(*REPORT_ORDER)


# ---------------------------------------------------------------- imports and context

@query("k1_python_imports")
def _(spark, sf):
    return imports.import_edges(corpus.module_tree(spark, sf).where("language = 'Python'")).select("path", "spec_ord", "spec")


@query("k2_script_imports")
def _(spark, sf):
    return imports.import_edges(corpus.module_tree(spark, sf).where("language = 'JavaScript'")).select("path", "spec_ord", "spec")


@query("k3_language_dispatch")
def _(spark, sf):
    labels = F.when(F.col("file_ord") % 3 == 0, "React JSX").when(F.col("file_ord") % 3 == 1, F.upper("language")).otherwise("ts")
    files = corpus.module_tree(spark, sf).withColumn("language", labels)
    return imports.import_edges(files).groupBy("language").agg(F.count("*").alias("imports"))


def resolved(spark, sf):
    return imports.import_graph(corpus.module_tree(spark, sf))


@query("k4_python_targets")
def _(spark, sf):
    return resolved(spark, sf).where("language = 'Python'").select("path", "spec", "target_path")


@query("k5_script_targets")
def _(spark, sf):
    return resolved(spark, sf).where("language = 'JavaScript'").select("path", "spec", "target_path")


@query("c8_import_resolution")
def _(spark, sf):
    return resolved(spark, sf).groupBy("language", F.col("target_path").isNotNull().alias("found")).agg(F.count("*").alias("n"))


@query("k6_excerpts")
def _(spark, sf):
    name = tree.file_name(F.col("path"))
    return corpus.module_tree(spark, sf).select("path", F.md5(context.excerpt(F.col("content"), name, 5)).alias("digest"))


@query("k7_context_blocks")
def _(spark, sf):
    files = corpus.module_tree(spark, sf)
    return context.context_blocks(files, 1_500).select("path", F.length("context").alias("chars"), F.md5("context").alias("digest"))


@query("k8_degrees")
def _(spark, sf):
    return imports.degrees(resolved(spark, sf), corpus.module_tree(spark, sf))


@query("k8_unresolved")
def _(spark, sf):
    return imports.unresolved(resolved(spark, sf))


# ---------------------------------------------------------------- prompts and responses

@query("l2_file_prompts")
def _(spark, sf):
    made = W.review_prompts(corpus.files(spark, sf))
    return made.select("repo", "path", F.length("user_prompt").alias("chars"), F.md5("user_prompt").alias("digest"))


@query("l2_context_prompts")
def _(spark, sf):
    """Prompts of modules with excerpts of what they import."""
    made = W.review_prompts(corpus.module_tree(spark, sf), 1_500, 2_000)
    return made.select("path", F.length("user_prompt").alias("chars"), F.md5("user_prompt").alias("digest"))


def bundle_texts(spark, sf):
    """The files of each bundle with their texts; the paths are chosen first, and only then are texts moved."""
    both = stored(scan_files(corpus.files(spark, sf)), "scan")
    late = hits_of(both).select("repo", F.col("file").alias("path")).distinct().withColumn("late", F.lit(False))
    chosen = packed_scan(both).where("in_bundle").select("repo", "path", "token_count", "in_bundle")
    chosen = stored(chosen.join(late, ["repo", "path"], "left").withColumn("late", F.coalesce("late", F.lit(True))), "chosen")
    return packing.with_texts(corpus.files(spark, sf), chosen)


@query("l3_bundle_prompts")
def _(spark, sf):
    made = prompts.bundle_prompts(bundle_texts(spark, sf))
    return made.select("repo", "bundle_files", F.length("user_prompt").alias("chars"), F.md5("user_prompt").alias("digest"))


def summaries(spark, sf, found, facts):
    read = responses.parse_responses(corpus.reviews(spark, sf), "file").select("repo", "path", "file_ord", "summary")
    counted = V.file_rollup(facts, found).where("analyzed").select("repo", "path", "language", "issue_count")
    return read.join(counted, ["repo", "path"])


@query("l4_project_prompts")
def _(spark, sf):
    found, facts = scanned(spark, sf)
    made = prompts.project_prompts(summaries(spark, sf, found, facts), V.representatives(found))
    return made.select("repo", F.length("user_prompt").alias("chars"), F.md5("user_prompt").alias("digest"))


@query("l5_work_table")
def _(spark, sf):
    return prompts.work_table(looked_up(spark, sf))


@query("l5_spread_responses")
def _(spark, sf):
    return prompts.spread_responses(keyed(spark, sf), looked_up(spark, sf)).select("repo", "path", "key", "response")


@query("l6_parsed_responses")
def _(spark, sf):
    parsed = responses.parse_responses(corpus.reviews(spark, sf), "file")
    return parsed.select("repo", "path", "readable", "summary", F.size("issues").alias("issues"))


@query("h11_extracted_json")
def _(spark, sf):
    return responses.extract_json(corpus.reviews(spark, sf)).groupBy(F.col("json").isNotNull().alias("found"), (F.col("file_ord") % 6).alias("form")).agg(
        F.count("*").alias("n"))


@query("l7_review_summaries")
def _(spark, sf):
    found = M.suppress(model_findings(spark, sf), corpus.marks(spark, sf))
    return responses.review_summaries(packed(spark, sf), found)


@query("l8_excluded_from_bundle")
def _(spark, sf):
    return packing.mark_excluded(packed(spark, sf)).select("repo", "path", "analyzed", "in_bundle", "skip_reason")


# ---------------------------------------------------------------- streams

def arriving(spark, sf):
    docs = stream.arriving_files(spark, f"{sf}/documents.parquet", corpus.table(spark, sf, "documents").schema,
                                 partitions=spark.sparkContext.defaultParallelism)
    return docs.select(
        F.col("source").alias("repo"), F.col("doc_id").alias("file_ord"), F.col("doc_id").cast("string").alias("path"),
        F.lit("Markdown").alias("language"), F.octet_length("text").cast("bigint").alias("size_bytes"), tree.read_text(F.col("text")).alias("content"))


@query("n1_stream_scan")
def _(spark, sf):
    return stream.run_to_table(stream.stream_findings(arriving(spark, sf)), "findings").select(*HIT)


@query("n2_stream_suppression")
def _(spark, sf):
    known = corpus.marks(spark, sf).withColumn("repo", F.regexp_replace("repo", "-.*", "")).withColumn("file_path", F.regexp_replace("id", "mark-", ""))
    return stream.run_to_table(stream.stream_findings(arriving(spark, sf), known), "kept").select(*HIT)


@query("n3_stream_counters")
def _(spark, sf):
    counts = stream.running_counts(stream.stream_findings(arriving(spark, sf)))
    return stream.run_to_table(counts, "counts", "complete")


@query("n3_stream_progress")
def _(spark, sf):
    known = corpus.table(spark, sf, "documents").select(F.col("source").alias("repo"), "doc_id")
    return stream.run_progress(arriving(spark, sf), "progress", known)


@query("n4_stream_unchanged")
def _(spark, sf):
    events = stream.arriving_files(spark, f"{sf}/events.parquet", corpus.table(spark, sf, "events").schema)
    files = events.select(F.lit("r").alias("repo"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("content"),
                          F.col("ts").cast("timestamp").alias("ts"))
    return stream.run_to_table(stream.changed_only(files, "ts").select("path", "content"), "fresh")
