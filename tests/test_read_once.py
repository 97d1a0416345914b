"""Texts and documents are read once: line counts come from the scan's lines, a response and a piece of SARIF are parsed once."""

from pyspark.sql import functions as F

from scangrove.catalog import builtin_rules
from scangrove.functions.text import count_lines
from scangrove.operators.responses import file_review_findings, parse_responses
from scangrove.operators.scan import facts_of, scan_files
from scangrove.plans.exports import sarif_fields

TEXTS = ["", "\n", "\n\n", "a", "a\n", "a\r\n", "a\r\n\r\nb", "a\r", "eval(x) b\x85", "x\x1c\x1dcvv = '123'", " ", None]


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_line_counts_come_from_the_lines_of_the_scan(spark, capsys):
    rows = [("r", i, f"f{i}.py", "Python", 1, text) for i, text in enumerate(TEXTS)]
    files = spark.createDataFrame(rows, "repo string, file_ord long, path string, language string, size_bytes long, content string")
    want = sorted(map(tuple, files.select("file_ord", count_lines(F.col("content"))).collect()))
    for rules in (builtin_rules(), []):
        scanned = scan_files(files, rules)
        assert sorted(map(tuple, facts_of(scanned).select("file_ord", "line_count").collect())) == want
    assert "RLIKE(substring(content" not in plan(scan_files(files), capsys)


def test_responses_are_read_once(spark, capsys):
    issue = '{"issues":[{"category":"bug","severity":"low","line":3,"description":"d","recommendation":"r"},{"description":"x"}],"summary":"s"}'
    texts = [issue, f"Here: {issue} }}", '{"issues":[]}', "nothing", None]
    asked = spark.createDataFrame([("r", f"f{i}", i, t) for i, t in enumerate(texts)], "repo string, path string, file_ord long, response string")
    found = file_review_findings(parse_responses(asked.where("file_ord >= 0"), "file"))
    got = sorted((r.file, r.rule_ord, r.description, r.severity, r.line) for r in found.collect())
    assert got == sorted((f, n, d, s, line) for f in ("f0", "f1") for n, d, s, line in ((0, "d", "low", 3), (1, "x", "medium", None)))
    assert plan(found, capsys).count("ArrowEvalPython") == 1


def test_pieces_of_sarif_are_parsed_once(spark, capsys):
    rule = '{"id":"a","name":"n","shortDescription":{"text":"s"},"fullDescription":{"text":"f"},"help":{"text":"h","markdown":"h \\"q\\""},' \
           '"defaultConfiguration":{"level":"note"},"properties":{"scanner":"pci","complianceRef":"c"}}'
    result = ',{"ruleId":"a","level":"error","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"u"},' \
             '"region":{"startLine":7,"snippet":{"text":"x\\ny"}}}}],"properties":{"category":"security","source":"pci_scanner"}}'
    bare = '{"ruleId":"b","level":"note","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"u"}}}],"properties":{}}'
    rows = [("r", 0, 0, "head"), ("r", 1, 0, rule), ("r", 3, 1, result), ("r", 3, 0, bare), ("r", 3, 2, ",not json"), ("r", 3, 3, None)]
    read = sarif_fields(spark.createDataFrame(rows, "repo string, section int, pos long, text string"))
    assert sorted(map(tuple, read.collect()), key=str) == sorted([
        ("r", 1, 0, False, "a", "note", "f", "s", 'h "q"', "pci", "c", None, None, None),
        ("r", 3, 1, True, "a", "error", "m", None, None, "pci_scanner", None, "u", 7, "x\ny"),
        ("r", 3, 0, False, "b", "note", "m", None, None, None, None, "u", None, None),
        ("r", 3, 2, True, *[None] * 10), ("r", 3, 3, *[None] * 11),
    ], key=str)
    found = plan(read, capsys)
    assert "get_json_object" not in found and found.count("from_json") == 1
