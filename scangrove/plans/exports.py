"""Reports as files: SARIF, JSON, text and Markdown.

A report is a table of text pieces ordered by (repo, section, pos).  No
repository is ever gathered in one row; ``write_reports`` range-partitions the
pieces, so a large report simply spans several part files whose names sort in
reading order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import severity_rank
from ..functions.text import location, sarif_level, severity_tag, slug
from ..operators.findings import FILE_LIST, report_multiset
from ..operators.ordering import numbered
from ..operators.score import at_least
from ..schemas import REPORT_ORDER
from ..session import stored
from ..sources.tree import language_breakdown

TOOL, TOOL_VERSION = "scangrove", "1.0.0"

# SARIF version and schema, and the lengths texts are cut to.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0-rtm.5.json"
SNIPPET_CHARS = 500
SHORT_CHARS = 120

CATALOG = 100_000

# Issues in the same place of a report are told apart by these, so that one place never holds many of them in one range.
TIES = ["file", "rule_id", "description"]


def sarif_ids(listed: DataFrame) -> DataFrame:
    """Listed issues with ``sarif_rule_id``: the rule, or a running ``llm-0000`` id where there is none."""
    ruled, free = listed.where(F.col("rule_id").isNotNull()), listed.where(F.col("rule_id").isNull())
    counted = numbered(free, ["repo"], ["place", *REPORT_ORDER, *TIES], "_n")
    synthetic = F.concat(F.lit("llm-"), F.lpad(F.col("_n").cast("string"), F.greatest(F.lit(4), F.length(F.col("_n").cast("string"))), F.lit("0")))
    return ruled.withColumn("sarif_rule_id", F.col("rule_id")).unionByName(counted.withColumn("sarif_rule_id", synthetic).drop("_n"))


def sarif_results(identified: DataFrame) -> DataFrame:
    """The flat columns of SARIF results."""
    has_line = F.col("line").isNotNull()
    return identified.select(
        "repo", "place", *REPORT_ORDER, F.col("sarif_rule_id").alias("rule_id"), sarif_level(F.col("severity")).alias("level"),
        F.col("description").alias("message"),
        F.when(F.coalesce("file", F.lit("")) == "", "<unknown>").otherwise(F.col("file")).alias("uri"),
        F.col("line").alias("start_line"),
        F.when(has_line & (F.col("code_snippet") != ""), F.substring("code_snippet", 1, SNIPPET_CHARS)).alias("snippet"),
        "category", "source", F.nullif("compliance_ref", F.lit("")).alias("compliance_ref"),
        F.nullif("hipaa_reference", F.lit("")).alias("hipaa_reference"),
    )


def _order_key() -> Column:
    """The place of an issue in a report as one number of fixed width, so that its minimum is a hash aggregate.

    One digit for the place, 19 for the file, 2 for the part, 7 for the rule and 9 for the line: 38 in all.
    """
    def digits(name: str, n: int) -> Column:
        return F.lpad((F.coalesce(F.col(name).cast("bigint"), F.lit(-1).cast("bigint")) + 1).cast("string"), n, "0")
    return F.concat(digits("place", 1), digits("file_ord", 19), digits("part_ord", 2), digits("rule_ord", 7), digits("line", 9)).cast("decimal(38,0)")


def first_issues(identified: DataFrame) -> DataFrame:
    """repo, id, at, s: the first issue of each rule in a report.

    Issues without a rule have an id of their own and are their own first.  Of the others the least order key is found by a hash
    aggregate, and the row that has it is fetched; the list of firsts is built into a hash table, so no issues are sorted.
    """
    about = F.struct("description", "recommendation", "severity", "compliance_ref", "rule_id").alias("s")
    fields = ["repo", F.col("sarif_rule_id").alias("id"), F.struct("place", *REPORT_ORDER).alias("at"), about]
    ruled = identified.where(F.col("rule_id").isNotNull()).withColumn("_key", _order_key())
    firsts = ruled.groupBy("repo", "sarif_rule_id").agg(F.min("_key").alias("_key")).hint("shuffle_hash")
    picked = ruled.join(firsts, ["repo", "sarif_rule_id", "_key"]).select(*fields).distinct()
    return identified.where(F.col("rule_id").isNull()).select(*fields).unionByName(picked)


def sarif_rules(identified: DataFrame, rules: DataFrame) -> DataFrame:
    """Descriptors of the rules a report refers to, in order of first use.

    ``rules`` is a catalog; one of up to ``CATALOG`` rules is sent to the issues instead of moving them.
    """
    used = first_issues(identified)
    known = rules.select(F.col("id"), F.struct("name", "description", "recommendation", "severity", "scanner", "rule_type", "compliance_ref", "language").alias("r"))
    found = used.join(F.broadcast(known) if rules.count() <= CATALOG else known, "id", "left")
    hit = F.col("r").isNotNull()
    return found.select(
        "repo", "id", "at", F.when(hit, slug(F.col("r.name"))).otherwise(F.col("id")).alias("name"),
        F.when(hit, F.col("r.name")).otherwise(F.substring("s.description", 1, SHORT_CHARS)).alias("short"),
        F.coalesce("r.description", "s.description").alias("full"),
        F.coalesce("r.recommendation", "s.recommendation").alias("help"),
        sarif_level(F.coalesce("r.severity", "s.severity")).alias("level"),
        F.coalesce("r.scanner", F.lit("llm")).alias("scanner"), F.coalesce("r.rule_type", F.lit("ai-detected")).alias("rule_type"),
        F.nullif(F.when(hit, F.col("r.compliance_ref")).otherwise(F.col("s.compliance_ref")), F.lit("")).alias("compliance_ref"),
        F.nullif(F.nullif("r.language", F.lit("")), F.lit("*")).alias("language"),
    )


def _lines(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("repo", "section", "pos", "text") for f in frames])


def _section(df: DataFrame, section: int, text: Column, pos: Column | None = None) -> DataFrame:
    return df.select("repo", F.lit(section).alias("section"), (F.lit(0) if pos is None else pos).cast("bigint").alias("pos"), text.alias("text"))


def sarif_document(identified: DataFrame, rules: DataFrame, header: DataFrame, information_uri: str | None = None) -> DataFrame:
    """The pieces of one SARIF document per repository.

    ``header`` has repo, source_type, analysis_mode, total_files_analyzed.  ``information_uri`` is the tool's address, if it shall have one.
    """
    def struct(**fields: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    def text(c) -> Column:
        return struct(text=F.col(c))

    # Rule descriptors without a catalog entry number as many as such issues, so they get positions like results do.
    entries = stored(sarif_rules(identified, rules).select("*", "at.*"), "sarif-rules")
    rule_json = F.to_json(struct(
        id=F.col("id"), name=F.col("name"), shortDescription=text("short"), fullDescription=text("full"),
        help=struct(text=F.col("help"), markdown=F.col("help")), defaultConfiguration=struct(level=F.col("level")),
        properties=struct(scanner=F.col("scanner"), ruleType=F.col("rule_type"), complianceRef=F.col("compliance_ref"), language=F.col("language")),
    ))
    region = F.when(F.col("start_line").isNotNull(), struct(
        startLine=F.col("start_line"), snippet=F.when(F.col("snippet").isNotNull(), text("snippet")),
    ))
    result_json = F.to_json(struct(
        ruleId=F.col("rule_id"), level=F.col("level"), message=text("message"),
        locations=F.array(struct(physicalLocation=struct(artifactLocation=struct(uri=F.col("uri")), region=region))),
        properties=struct(category=F.col("category"), source=F.col("source"), complianceRef=F.col("compliance_ref"), hipaaReference=F.col("hipaa_reference")),
    ))

    comma = F.when(F.col("pos") > 0, ",").otherwise("")
    driver = F.to_json(struct(name=F.lit(TOOL), version=F.lit(TOOL_VERSION), informationUri=F.lit(information_uri).cast("string")))
    opening = F.concat(
        F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":'),
        F.expr("substring(d, 1, length(d) - 1)"), F.lit(',"rules":['),
    )
    invocation = F.to_json(struct(executionSuccessful=F.lit(True), properties=struct(
        repoName=F.col("repo"), sourceType=F.col("source_type"), analysisMode=F.col("analysis_mode"), filesAnalyzed=F.col("total_files_analyzed"),
    )))
    return _lines(
        _section(header.withColumn("d", driver), 0, opening),
        _section(numbered(entries, ["repo"], ["place", *REPORT_ORDER, "id"], "pos"), 1, F.concat(comma, rule_json), F.col("pos")),
        _section(header, 2, F.concat(F.lit(']}},"invocations":['), invocation, F.lit('],"results":['))),
        _section(numbered(sarif_results(identified), ["repo"], ["place", *REPORT_ORDER, "rule_id", "message"], "pos"), 3, F.concat(comma, result_json), F.col("pos")),
        _section(header, 4, F.lit("]}]}")),
    )


ISSUE_FIELDS = ["category", "severity", "file", "line", "description", "recommendation", "code_snippet", "source", "rule_id", "hipaa_reference", "compliance_ref"]
CHECKLISTS = {"hipaa": "HIPAA", "pci": "PCI-DSS", "gdpr": "GDPR", "soc2": "SOC 2", "owasp": "OWASP Top 10", "cis": "CIS Controls v8"}
_ALL = {"ignoreNullFields": "false"}


def json_report(
    report: DataFrame, files: DataFrame, findings: DataFrame, project: DataFrame | None = None, threshold: str = "low",
    generated_at: Column | None = None,
) -> DataFrame:
    """The pieces of one JSON document per repository, with the issues of a severity or worse.

    ``report`` has the rows of a report, ``files`` all files with their facts.  Issues are nested in the entries of their files, though
    no file or repository is held in a row: an entry is an opening piece, a piece for each issue, and a closing one.
    """
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if generated_at is None else generated_at
    shown = at_least(findings, threshold)
    issue = F.to_json(F.struct(*ISSUE_FIELDS), _ALL)

    def listed(df: DataFrame, section: int) -> DataFrame:
        placed = numbered(df, ["repo"], [*REPORT_ORDER, *TIES], "pos")
        return _section(placed, section, F.concat(F.when(F.col("pos") > 0, ",").otherwise(""), issue), F.col("pos"))

    def opened(row: Column) -> Column:
        return F.regexp_replace(row, "\\}\\z", "")

    def checklist(framework: str) -> Column:
        names = ["section", "title", "description", "findings_count", "status", "worst_severity"]
        names = names if framework == "HIPAA" else ["framework", *names]
        return F.transform(F.filter("checklist", lambda c: c["framework"] == framework), lambda c: F.struct(*[c[n].alias(n) for n in names]))

    head = F.to_json(F.struct(
        F.col("repo").alias("repo_name"), F.lit("local").alias("source_type"), "languages", F.col("risk_score").alias("overall_risk_score"),
        F.col("assessment").alias("overall_assessment"),
    ), _ALL)
    tail = F.to_json(F.struct(
        *[checklist(name).alias(f"{key}_checklist") for key, name in CHECKLISTS.items()],
        F.struct("total_files_analyzed", "total_files_skipped", "total_issues_found", "analysis_mode").alias("metadata"),
        stamp.alias("generated_at"),
    ), _ALL)
    with_summary = files if "summary" in files.columns else files.withColumn("summary", F.lit(""))
    entry = F.to_json(F.struct(F.col("path").alias("file_path"), "language", "size_bytes", "summary", "token_count", "analyzed", "skip_reason"), _ALL)
    place = ["file_ord", "file", "_kind", *REPORT_ORDER[1:], "rule_id", "description"]

    def piece(df: DataFrame, kind: int, path: str, text: Column) -> DataFrame:
        """Opening, issue or closing pieces of files' entries, with the columns that order them."""
        have = {"file": F.col(path), "_kind": F.lit(kind), "_text": text}
        return df.select("repo", *[have.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(_PLACE[c]).alias(c) for c in [*place, "_text"]])

    in_files = numbered(shown.where(F.col("part_ord") >= 0), ["repo", "file_ord", "file"], [*REPORT_ORDER[1:], "rule_id", "description"], "_n")
    comma = F.when(F.col("_n") > 0, ",").otherwise("")
    entries = numbered(
        piece(with_summary, 0, "path", F.concat(opened(entry), F.lit(',"issues":[')))
        .unionByName(piece(in_files, 1, "file", F.concat(comma, issue))).unionByName(piece(with_summary, 2, "path", F.lit("]}"))),
        ["repo"], place, "pos",
    )
    between = F.when((F.col("_kind") == 0) & (F.col("pos") > 0), ",").otherwise("")
    parts = [
        _section(report, 0, F.concat(opened(head), F.lit(',"file_analyses":['))),
        _section(entries, 1, F.concat(between, F.col("_text")), F.col("pos")),
        _section(report, 2, F.lit('],"project_level_issues":[')),
        _section(report, 4, F.lit('],"security_findings":[')),
        listed(shown.where(F.col("category") == "security"), 5),
        _section(report, 6, F.concat(F.lit("],"), F.substring(tail, 2, 1 << 30))),
    ]
    return _lines(*parts, *([] if project is None else [listed(at_least(project, threshold), 3)]))


_PLACE = {"file_ord": "bigint", "file": "string", "_kind": "int", "part_ord": "int", "rule_ord": "bigint", "line": "int", "rule_id": "string", "description": "string", "_text": "string"}


_SARIF = (
    "id string, ruleId string, level string, defaultConfiguration struct<level: string>, message struct<text: string>, "
    "shortDescription struct<text: string>, fullDescription struct<text: string>, help struct<markdown: string>, "
    "properties struct<scanner: string, source: string, complianceRef: string>, locations array<struct<physicalLocation: struct<"
    "artifactLocation: struct<uri: string>, region: struct<startLine: string, snippet: struct<text: string>>>>>"
)


def sarif_fields(pieces: DataFrame) -> DataFrame:
    """What the rules and results in the pieces of a SARIF document say, read back from their JSON, which is parsed once a piece."""
    bare = F.ltrim("text", F.lit(","))
    told = pieces.where("section IN (1, 3)").select("repo", "section", "pos", (F.col("text") != bare).alias("comma"), F.from_json(bare, _SARIF).alias("j"))
    def get(path: str) -> Column:
        return F.col(f"j.{path}")
    where = F.get("j.locations", F.lit(0))["physicalLocation"]
    return told.select(
        "repo", "section", "pos", "comma", F.coalesce(get("id"), get("ruleId")).alias("rule_id"),
        F.coalesce(get("level"), get("defaultConfiguration.level")).alias("level"), F.coalesce(get("message.text"), get("fullDescription.text")).alias("text"),
        get("shortDescription.text").alias("short"), get("help.markdown").alias("help"), F.coalesce(get("properties.scanner"), get("properties.source")).alias("source"),
        get("properties.complianceRef").alias("compliance_ref"), where["artifactLocation"]["uri"].alias("uri"),
        where["region"]["startLine"].cast("bigint").alias("start_line"), where["region"]["snippet"]["text"].alias("snippet"),
    )


def json_fields(pieces: DataFrame) -> DataFrame:
    """What the pieces of a JSON report say, read back: a row for each report, file and issue."""
    bare = F.ltrim("text", F.lit(","))
    shut = F.when(bare.endswith(":["), F.concat(bare, F.lit("]}"))).otherwise(bare)
    told = pieces.where("section IN (0, 1, 3, 5)").withColumn("j", shut).where("j != ']}'")
    def get(path: str) -> Column:
        return F.get_json_object("j", f"$.{path}")
    return told.select(
        "repo", "section", "pos", F.col("text").startswith(",").alias("comma"), F.coalesce(get("file"), get("file_path")).alias("file"),
        get("line").cast("bigint").alias("line"), get("severity").alias("severity"), get("rule_id").alias("rule_id"),
        F.coalesce(get("description"), get("overall_assessment"), get("summary")).alias("text"),
        F.coalesce(get("overall_risk_score"), get("token_count")).cast("bigint").alias("number"), get("skip_reason").alias("skip_reason"),
    )


def _optional(label: str, column: str) -> Column:
    return F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(label), column))


def text_report(findings: DataFrame, report: DataFrame, threshold: str = "low", project: DataFrame | None = None) -> DataFrame:
    """The plain text report, one piece per issue."""
    shown = at_least(report_multiset(findings, project), threshold)
    counts = shown.groupBy("repo").agg(F.count("*").alias("shown"))
    head = report.select("repo", "total_files_analyzed").join(counts, "repo", "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    title = F.concat(
        F.lit(f"{TOOL} scan: "), "repo", F.lit("\nfiles analyzed: "), F.col("total_files_analyzed").cast("string"),
        F.lit("  issues shown: "), F.col("shown").cast("string"), F.lit("\n"),
    )
    block = F.concat_ws(
        "\n",
        F.concat(severity_tag(F.col("severity")), F.lit("  "), "description"),
        F.concat(F.lit("  at "), location(F.col("file"), F.col("line")), F.lit("  ["), "source", F.lit("]")),
        _optional("  rule: ", "rule_id"), _optional("  compliance: ", "compliance_ref"), _optional("  fix: ", "recommendation"),
        F.when(F.coalesce("code_snippet", F.lit("")) != "", F.concat(F.lit("  ```\n  "), "code_snippet", F.lit("\n  ```"))),
        F.lit(""),
    )
    issues = numbered(shown, ["repo"], ["place", *REPORT_ORDER, *TIES], "pos")
    return _lines(
        _section(head, 0, title),
        _section(issues, 1, block, F.col("pos")),
        _section(head.where("shown = 0"), 1, F.lit("No findings at or above the selected threshold.")),
    )


def markdown_report(
    findings: DataFrame, report: DataFrame, files: DataFrame, project: DataFrame | None = None, generated_at: Column | None = None,
) -> DataFrame:
    """The Markdown report: summary, languages, then file and project issues by severity, each once."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if generated_at is None else generated_at
    title = F.concat(
        F.lit("# Assessment Report\n\n**Repository:** `"), "repo", F.lit("`  \n**Risk Score:** "), F.col("risk_score").cast("string"),
        F.lit("/100  \n**Generated:** "), stamp, F.lit("\n\n## Executive Summary\n\n"), "assessment",
        F.lit("\n\n## Language Breakdown\n\n| Language | Files | Lines |\n|----------|-------|-------|"),
    )
    # Few languages per repository; their order is by files, then first seen.
    order = Window.partitionBy("repo").orderBy(F.desc("file_count"), "first_seen", "language")
    languages = language_breakdown(files).withColumn("rank", F.row_number().over(order) - 1)
    row = F.concat(F.lit("| "), "language", F.lit(" | "), F.col("file_count").cast("string"), F.lit(" | "), F.col("line_count").cast("string"), F.lit(" |"))
    shown = report_multiset(findings, project).where(F.col("place") >= FILE_LIST).withColumn("_s", -severity_rank(F.col("severity")))
    issues = numbered(shown, ["repo"], ["_s", "place", *REPORT_ORDER, *TIES], "pos")
    block = F.concat(
        F.lit("### ["), F.upper("severity"), F.lit("] "), location(F.col("file"), F.col("line")), F.lit("\n\n- **Category:** "), "category",
        F.lit("\n- **Description:** "), "description", F.lit("\n- **Recommendation:** "), "recommendation", F.lit("\n"),
    )
    return _lines(
        _section(report, 0, title),
        _section(languages, 1, row, F.col("rank")),
        _section(report, 2, F.lit("\n## Issues\n")),
        _section(issues, 3, block, F.col("pos")),
    )


def write_reports(pieces: DataFrame, path: str) -> None:
    """Write each repository's pieces in order, as text under ``repo=…``; part names sort in reading order."""
    keys = ["repo", "section", "pos"]
    pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).select("repo", "text").write.partitionBy("repo").text(path)
