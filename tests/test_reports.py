import datetime as dt
import hashlib
import json
import time
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from scangrove.catalog import rules_frame
from scangrove.operators.findings import report_multiset
from scangrove.operators.packing import EXCLUDED_REASON
from scangrove.operators.responses import UNREADABLE
from scangrove.operators.scan import scan_rules
from scangrove.plans import exports, review
from scangrove.plans.report import analyse, report_rows
from scangrove.schemas import FINDINGS, MARKS


@pytest.fixture(scope="module")
def analysis(make_files):
    files = make_files([
        ("requirements.txt", "Unknown", "flask"), ("a.py", "Python", "cvv = '123'\nx = \"é\"\neval(x)\n"), ("sub/b.py", "Python", "print(1)"),
        ("big.py", "Python", "y = 1\n" * 9000),
    ], repo="my repo")
    clean = make_files([("c.py", "Python", "x = 1")], repo="clean")
    whole = files.union(clean)
    return analyse(whole, whole.where("path != 'requirements.txt'"), store=True)


def written(pieces, path):
    exports.write_reports(pieces, str(path))
    out = {}
    for folder in Path(path).glob("repo=*"):
        text = "".join(p.read_text() for p in sorted(folder.glob("part-*.txt")))
        out[folder.name.removeprefix("repo=").replace("%20", " ")] = text
    return out


def header(analysis):
    return report_rows(analysis).select("repo", "total_files_analyzed", F.lit("local").alias("source_type"), "analysis_mode")


def test_sarif_document(spark, analysis, tmp_path):
    identified = exports.sarif_ids(report_multiset(analysis.findings))
    docs = written(exports.sarif_document(identified, rules_frame(spark), header(analysis)), tmp_path / "sarif")
    assert set(docs) == {"my repo", "clean"}
    doc = json.loads(docs["my repo"])
    assert doc["version"] == "2.1.0" and doc["$schema"].endswith("sarif-2.1.0-rtm.5.json")
    run = doc["runs"][0]
    props = run["invocations"][0]["properties"]
    assert props == {"repoName": "my repo", "sourceType": "local", "analysisMode": "static", "filesAnalyzed": 2}
    # One manifest note, then three findings twice.
    assert [r["ruleId"] for r in run["results"]] == ["llm-0000", "sec-danger-000", "pci-001", "cis-014"] + ["sec-danger-000", "pci-001", "cis-014"]
    first, second = run["results"][:2]
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "requirements.txt"}} and first["level"] == "warning"
    assert second["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "snippet": {"text": "eval(x)"}}
    assert "complianceRef" not in second["properties"] and run["results"][2]["properties"]["complianceRef"].startswith("PCI-DSS")
    rules = {r["id"]: r for r in run["tool"]["driver"]["rules"]}
    assert list(rules) == ["llm-0000", "sec-danger-000", "pci-001", "cis-014"]
    assert rules["sec-danger-000"]["properties"] == {"scanner": "security", "ruleType": "dangerous", "language": "Python"}
    assert rules["pci-001"]["name"] == "CVV_CVC_Storage" and rules["llm-0000"]["properties"] == {"scanner": "llm", "ruleType": "ai-detected"}
    assert json.loads(docs["clean"])["runs"][0]["results"] == []


def test_json_report(analysis, tmp_path):
    pieces = exports.json_report(report_rows(analysis), analysis.files, analysis.findings, None, "medium")
    docs = {repo: json.loads(text) for repo, text in written(pieces, tmp_path / "json").items()}
    doc = docs["my repo"]
    assert list(doc) == [
        "repo_name", "source_type", "languages", "overall_risk_score", "overall_assessment", "file_analyses", "project_level_issues", "security_findings",
        "hipaa_checklist", "pci_checklist", "gdpr_checklist", "soc2_checklist", "owasp_checklist", "cis_checklist", "metadata", "generated_at"]
    assert doc["overall_risk_score"] == 25 + 5 + 10 + 5 + 4 + 1 and doc["metadata"]["total_files_skipped"] == 1 and doc["project_level_issues"] == []
    assert sum(len(v) for k, v in doc.items() if k.endswith("_checklist")) == 39 and "framework" not in doc["hipaa_checklist"][0]
    entries = {f["file_path"]: f for f in doc["file_analyses"]}
    assert list(entries) == ["a.py", "sub/b.py", "big.py"] and not entries["big.py"]["analyzed"] and entries["big.py"]["skip_reason"].startswith("File too large")
    assert [i["severity"] for i in entries["a.py"]["issues"]] == ["high", "critical"] and entries["sub/b.py"]["issues"] == []
    assert list(entries["a.py"]["issues"][0]) == exports.ISSUE_FIELDS and entries["a.py"]["issues"][0]["hipaa_reference"] is None
    assert [i["severity"] for i in doc["security_findings"]] == ["medium", "high", "critical"]
    assert [f["file_path"] for f in docs["clean"]["file_analyses"]] == ["c.py"] and docs["clean"]["security_findings"] == []


def test_json_report_of_a_file_with_many_issues(spark, analysis, tmp_path):
    """A file's issues span several part files and still nest in its entry."""
    one = analysis.findings.where("file = 'a.py'").limit(1)
    many = one.drop("rule_ord").crossJoin(spark.range(3000).withColumnRenamed("id", "rule_ord")).select(*FINDINGS.fieldNames())
    doc = json.loads(written(exports.json_report(report_rows(analysis), analysis.files, many), tmp_path / "many")["my repo"])
    assert {f["file_path"]: len(f["issues"]) for f in doc["file_analyses"]} == {"a.py": 3000, "sub/b.py": 0, "big.py": 0}


def test_first_issues_need_no_sort(spark, analysis):
    identified = exports.sarif_ids(report_multiset(analysis.findings))
    plan = exports.sarif_rules(identified, rules_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "HashAggregate" in plan


@pytest.fixture(scope="module")
def reviewed(spark, make_files):
    files = make_files([("a.py", "Python", "eval(x)\n"), ("b.py", "Python", "zz = 123"), ("big.py", "Python", "y = 1\n" * 9000), ("c.py", "Python", "z")], repo="r")
    tree = files.union(make_files([("requirements.txt", "Unknown", "flask")], repo="r"))
    issue = '{"category":"bug","severity":"%s","line":2,"description":"%s","recommendation":"mend"}'
    marks = spark.createDataFrame(
        [("m1", "r", "b.py", None, "sha256:" + hashlib.sha256(b"known").hexdigest(), None, None, None), ("m2", "r", "a.py", "sec-danger-000", None, None, None, None)], MARKS)
    return files, tree, issue, marks


def test_per_file_review(spark, reviewed, tmp_path):
    files, tree, issue, marks = reviewed
    answers = spark.createDataFrame([
        ("r", "a.py", '{"issues":[%s],"summary":"Fine."}' % (issue % ("high", "new"))), ("r", "b.py", '{"issues":[%s,%s]}' % (issue % ("low", "known"), issue % ("urgent", "odd"))),
        ("r", "big.py", '{"issues":[%s]}' % (issue % ("high", "too large to be asked"))), ("r", "gone.py", '{"issues":[%s]}' % (issue % ("high", "no file"))), ("r", "c.py", "no object"),
    ], "repo string, path string, response string")
    project = spark.createDataFrame([("r", '{"project_level_issues":[{"description":"all"}],"overall_assessment":"So so.","overall_risk_score":77.9}'), ("other", "{}")], "repo string, response string")
    made = review.per_file_review(tree, files, answers, project, marks)
    row, = review.review_rows(made).collect()
    # The hit in a.py and the known note are marked; the new note, the manifest and what the scan finds in big.py stay.
    assert (row.issues, row.high, row.medium, row.risk_score, row.assessment, row.project_issues) == (2, 1, 1, 77, "So so.", 1)
    assert (row.total_files_analyzed, row.total_files_skipped, row.analysis_mode) == (3, 1, "per_file")
    got = {r.path: (r.analyzed, r.summary, r.issues, r.model_issues) for r in review.file_entries(made).collect()}
    assert got == {"a.py": (True, "Fine.", 1, 1), "b.py": (True, "", 0, 0), "big.py": (False, "", 0, 0), "c.py": (True, UNREADABLE["file"], 0, 0)}
    doc = json.loads(written(exports.json_report(review.review_rows(made), made.files, made.findings, made.project), tmp_path / "r")["r"])
    assert doc["overall_assessment"] == "So so." and [i["description"] for i in doc["project_level_issues"]] == ["all"] and doc["project_level_issues"][0]["category"] == "deployment"
    assert [(f["file_path"], [i["description"] for i in f["issues"]]) for f in doc["file_analyses"] if f["issues"]] == [("a.py", ["new"])]


def test_review_without_answers(spark, reviewed):
    files, tree, _, _ = reviewed
    none = spark.createDataFrame([], "repo string, path string, response string")
    row, = review.review_rows(review.per_file_review(tree, files, none, none)).collect()
    assert row.assessment == "Analysis found 2 issues, including 1 high severity" and row.project_issues == 0 and row.risk_score == 10 + 5 + 4


def test_bundle_review(spark, reviewed):
    files, tree, issue, marks = reviewed
    named = lambda file, text: (issue % ("high", text)).replace("{", '{"file":"%s",' % file)
    answer = '{"issues":[%s,%s,%s],"overall_assessment":"","overall_risk_score":5}' % (named("a.py", "one"), named("b.py", "known"), named("c.py", "left out"))
    answers = spark.createDataFrame([("r", answer)], "repo string, response string")
    # a.py has a hit, though a marked one, and comes first; then the small ones as long as they fit.
    made = review.bundle_review(tree, files, answers, marks, budget=3)
    got = {r.path: (r.analyzed, r.in_bundle, r.summary, r.model_issues, r.skip_reason) for r in review.file_entries(made).collect()}
    assert got["a.py"] == (True, True, "1 AI-detected issue.", 1, None) and got["c.py"] == (True, True, "1 AI-detected issue.", 1, None)
    assert got["b.py"] == (True, False, "", 0, EXCLUDED_REASON) and got["big.py"][0] is False and got["big.py"][4] == "File too large (13500 tokens)"
    row, = review.review_rows(made).collect()
    assert (row.issues, row.risk_score, row.assessment) == (3, 10 + 10 + 4, "Analysis found 3 issues, including 2 high severity")
    unread = review.bundle_review(tree, files, answers.withColumn("response", F.lit("?")), marks)
    row, = review.review_rows(unread).collect()
    assert (row.risk_score, row.assessment) == (50, UNREADABLE["bundle"])


def test_prompts_pass_the_gate_and_carry_context(spark, make_files):
    files = make_files([("a.py", "Python", "import b\n"), ("b.py", "Python", "def f(): pass\n"), ("big.py", "Python", "x = 1\n" * 9000)], repo="r")
    made = {r.path: r.user_prompt for r in review.review_prompts(files, 500).collect()}
    assert set(made) == {"a.py", "b.py"} and "## Imported Context" in made["a.py"] and "def f(): pass" in made["a.py"] and "Imported" not in made["b.py"]


def test_text_report(analysis, tmp_path):
    texts = written(exports.text_report(analysis.findings, report_rows(analysis), "high"), tmp_path / "text")
    assert texts["clean"] == "scangrove scan: clean\nfiles analyzed: 1  issues shown: 0\n\nNo findings at or above the selected threshold.\n"
    lines = texts["my repo"].splitlines()
    assert lines[:4] == ["scangrove scan: my repo", "files analyzed: 2  issues shown: 4", "",
                         "    HIGH  Use of eval() can lead to arbitrary code execution."]
    assert lines[4:6] == ["  at a.py:3  [security_scanner]", "  rule: sec-danger-000"] and lines[7:10] == ["  ```", "  eval(x)", "  ```"]


def test_markdown_report(analysis, tmp_path):
    text = written(exports.markdown_report(analysis.findings, report_rows(analysis), analysis.files), tmp_path / "md")["my repo"]
    assert "**Risk Score:** 50/100" in text and "| Python | 3 | 9004 |" in text
    heads = [line for line in text.splitlines() if line.startswith("### ")]
    assert heads == ["### [CRITICAL] a.py:1", "### [HIGH] a.py:3", "### [LOW] sub/b.py:1"]


def test_stored_findings_give_the_same_export(spark, analysis, tmp_path):
    analysis.findings.write.parquet(str(tmp_path / "f"))
    again = spark.read.schema(FINDINGS).parquet(str(tmp_path / "f"))
    a, b = (exports.sarif_results(exports.sarif_ids(report_multiset(f))) for f in (analysis.findings, again))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_part_files_of_a_large_report_are_in_order(spark, tmp_path):
    pieces = spark.range(5000).select(
        F.lit("r").alias("repo"), (F.col("id") % 3).cast("int").alias("section"), F.col("id").alias("pos"), F.format_string("%d %05d", F.col("id") % 3, F.col("id")).alias("text"))
    lines = written(pieces.repartition(4), tmp_path / "big")["r"].splitlines()
    assert lines == sorted(lines) and len(lines) == 5000


def test_streams_give_the_batch_results(spark):
    from scangrove.plans.queries import QUERIES

    batch = QUERIES["c1_document_scan"](spark, SF).drop("code_snippet")
    stream = QUERIES["n1_stream_scan"](spark, SF)
    assert batch.exceptAll(stream).count() == stream.exceptAll(batch).count() == 0
    assert QUERIES["n3_stream_counters"](spark, SF).agg(F.sum("findings")).first()[0] == batch.count()


def test_stream_skips_unchanged_files(spark, tmp_path):
    from scangrove.streaming import scan as stream

    schema = "repo string, path string, content string, ts timestamp"
    t = "2024-01-01 00:00:0"
    rows = [("r", "a", "x", 1), ("r", "a", "x", 2), ("r", "b", "x", 3), ("r", "a", "y", 4)]
    for i, (repo, path, content, s) in enumerate(rows):
        df = spark.createDataFrame([(repo, path, content)], "repo string, path string, content string")
        df.withColumn("ts", F.lit(f"{t}{s}").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = stream.arriving_files(spark, str(tmp_path / "in"), spark.read.schema(schema).parquet(str(tmp_path / "in")).schema)
    got = stream.run_to_table(stream.changed_only(arriving, "ts"), "changed")
    assert sorted((r.path, r.content) for r in got.collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def arrive(spark, folder, rows):
    """Each row as a file of its own."""
    for path, content, second in rows:
        df = spark.createDataFrame([("r", path, content, dt.datetime(2024, 1, 1, 0, 0, second))], "repo string, path string, content string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(folder)


def test_state_of_unchanged_files_is_one_hash_a_file(spark, tmp_path):
    """A file that changes back counts as changed; a file that is not seen for long is forgotten."""
    from scangrove.streaming import scan as stream

    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    arrive(spark, folder, [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("a", "x", 4), ("b", "x", 5), ("c", None, 6)])
    schema = spark.read.parquet(folder).schema

    def run():
        fresh = stream.changed_only(stream.arriving_files(spark, folder, schema), "ts", "2 seconds")
        query = fresh.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).format("parquet").option("path", out).start()
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    assert run()[-1] == 3
    got = sorted(((r.path, r.content) for r in spark.read.parquet(out).collect()), key=str)
    assert got == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", None)]
    time.sleep(4)
    arrive(spark, folder, [("d", "x", 7)])
    run()
    time.sleep(2)
    arrive(spark, folder, [("e", "x", 8)])
    assert run()[-1] <= 2


def test_repeated_batch_changes_no_progress(spark, make_files, tmp_path):
    from scangrove.streaming import scan as stream

    out = str(tmp_path / "counts")
    write = stream.count_batches(out)
    first, second = make_files([("a.py", "Python", "eval(x)"), ("b.py", "Python", "")]), make_files([("c.py", "Python", "eval(y)\ncvv = '123'")])
    known = first.union(second).union(make_files([("d.py", "Python", "later")]))
    for batch, files in ((0, first), (1, second), (1, second), (0, first)):
        write(files, batch)
    row, = stream.progress(spark, out, known).collect()
    counts = {r["severity"]: r["count"] for r in scan_rules(first.union(second)).groupBy("severity").count().collect()}
    assert (row.files_known, row.files_scanned) == (4, 3)
    assert {s: row[s] for s in ("critical", "high", "medium", "low", "info") if row[s]} == counts


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    from scangrove.sources import tables

    path, schema = str(tmp_path / "t"), spark.range(0).schema
    assert tables.read_table(spark, path, schema).count() == 0
    tables.replace_table(spark.range(5), path)
    reader = tables.read_table(spark, path, schema)
    tables.replace_table(reader.union(spark.range(5, 8)), path)
    assert reader.count() == 5 and tables.read_table(spark, path, schema).count() == 8
    # A version that was never finished, and a lock that was left behind, are passed over.
    (tmp_path / "t" / "v-unfinished").mkdir()
    (tmp_path / "t" / "lock-000000000003").touch()
    tables.clear_table(spark, path, schema)
    assert tables.read_table(spark, path, schema).count() == 0 and reader.count() == 5
    assert tables.drop_old_versions(spark, path) == 2 and len(list((tmp_path / "t").glob("v-*"))) == 2


def test_run_folder_is_deleted(spark):
    from scangrove import session

    with session.run_folder(spark) as folder:
        df = session.stored(spark.range(3), "x")
        assert df.count() == 3 and folder in df.inputFiles()[0] and Path(folder.removeprefix("file://")).exists()
    assert not Path(folder.removeprefix("file://")).exists() and folder not in session.fresh_path(spark, "y")
