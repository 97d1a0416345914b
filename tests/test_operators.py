import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scangrove.catalog import builtin_rules, rules_frame
from scangrove.functions.text import description_hash
from scangrove.operators import compliance, context, imports, packing, prompts, responses, score
from scangrove.operators import findings as V
from scangrove.operators import marks as M
from scangrove.operators import rules as R
from scangrove.operators.ordering import first_n_per_group, heavy_keys, numbered, skew_join
from scangrove.plans.exports import sarif_ids
from scangrove.schemas import FINDINGS, MARKS, RESPONSES

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def found(spark):
    def make(rows):
        """Findings from dicts; what is left out gets a plain value."""
        base = {"repo": "r", "part_ord": 0, "rule_ord": 0, "category": "security", "severity": "low", "file": "a.py", "line": 1,
                "description": "d", "recommendation": "fix", "source": "s"}
        full = [{**base, "file_ord": i, **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r.get(n) for n in FINDINGS.fieldNames()) for r in full], FINDINGS)
    return make


def repos(spark, *names):
    return spark.createDataFrame([(n,) for n in names or ("r",)], "repo string")


# ---------------------------------------------------------------- score, checklists

@pytest.mark.parametrize("severities, suggested, expected", [
    ("critical high medium low info", None, 50), ("critical high medium low info", 80.9, 80), ("critical high medium low info", 10.0, 50),
    ("critical critical critical critical", None, 100), ("", None, 0), ("", 130.0, 100), ("low", -3.5, 1),
])
def test_score(spark, found, severities, suggested, expected):
    hint = spark.createDataFrame([("r", suggested)], "repo string, suggested double")
    row = score.scores(found([{"severity": s} for s in severities.split()]), repos(spark), hint).first()
    assert row.risk_score == expected


def test_assessment(spark, found):
    def sentence(*severities, static=False):
        return score.scores(found([{"severity": s} for s in severities]), repos(spark), static_only=static).first().assessment
    assert sentence("low") == "Analysis found 1 issue"
    assert sentence("critical", "high", "high") == "Analysis found 3 issues, including 1 critical and 2 high severity"
    assert sentence() == "Analysis found 0 issues"
    assert sentence("high", static=True).startswith("Static analysis found 1 issue, including 1 high severity. No LLM-based")


def failing(checklist):
    return {(r.framework, r.section): (r.findings_count, r.worst_severity) for r in checklist.where("status = 'fail'").collect()}


def test_checklists(spark, found):
    def one(ref, hipaa=False, n=1):
        rows = found([{"compliance_ref": ref, "hipaa_reference": ref if hipaa else None, "severity": s} for s in ("low", "high")[:n]])
        every = compliance.checklists(rows, repos(spark))
        assert every.count() == 39
        return failing(every)
    assert one("§164.312(e)(1) — Transmission Security", True, 2) == {
        ("HIPAA", "§164.312(e)(1)"): (2, "high"), ("PCI-DSS", "Req 4"): (2, "high")}
    assert one("SOC 2 CC7.3 — Audit Logging") == {("SOC 2", "CC7.3"): (1, "low"), ("PCI-DSS", "Req 10"): (1, "low")}
    assert one("GDPR Art. 5(1)(e) — Storage Limitation") == {("GDPR", "Art. 5"): (1, "low"), ("GDPR", "Art. 5(1)(e)"): (1, "low")}
    assert one("PCI-DSS Req 3.5 — Encryption of Stored Data") == {}
    assert one("PCI-DSS Req 4.2 — Transmission Security") == {("PCI-DSS", "Req 4"): (1, "low")}
    passed = compliance.checklists(found([]), repos(spark)).collect()
    assert len(passed) == 39 and all(r.worst_severity is None and r.findings_count == 0 for r in passed)


def test_gate(spark, found):
    rows = found([{"repo": "x", "severity": "medium"}, {"repo": "y", "severity": "critical"}])
    def codes(*a):
        return {r.repo: r.exit_code for r in score.gate(rows, repos(spark, "x", "y", "z"), *a).collect()}
    assert codes() == {"x": 1, "y": 1, "z": 0}
    assert codes("low", "high") == {"x": 0, "y": 1, "z": 0}
    assert codes("critical", "low") == {"x": 0, "y": 1, "z": 0}


# ---------------------------------------------------------------- marks

def marks(spark, *rows):
    return spark.createDataFrame([(f"m{i}", "r", f, rule, h, "", DAY + dt.timedelta(days=i), "u") for i, (f, rule, h) in enumerate(rows)], MARKS)


def test_suppression(spark, found):
    hashed = spark.range(1).select(description_hash(F.lit("dd")).alias("h")).first().h
    rows = found([{"file": "a.py", "rule_id": "r1"}, {"file": "a.py", "rule_id": "r2"}, {"file": "b.py", "rule_id": "r1"},
                  {"file": "a.py", "description": "dd"}, {"file": "b.py", "description": "dd"}, {"file": "a.py", "description": "dd", "rule_id": "r3"},
                  {"repo": "other", "file": "a.py", "rule_id": "r1"}])
    kept = M.suppress(rows, marks(spark, ("a.py", "r1", None), ("a.py", "r1", None), ("a.py", None, hashed)))
    assert sorted(r.file_ord for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert kept.columns == rows.columns


def test_mark_upkeep(spark, tmp_path):
    old = marks(spark, ("a.py", "r1", None), ("b.py", None, "sha256:x"))
    new = marks(spark, ("a.py", "r1", None), ("c.py", "r1", None), ("c.py", "r1", None), ("", "r1", None), ("d.py", None, None), ("e.py", "r", "h"))
    new = new.withColumn("id", F.concat(F.lit("n"), "id"))
    assert {r.id: r.problem.split()[0] for r in M.invalid_marks(new).collect()} == {"nm3": "file_path", "nm4": "exactly", "nm5": "exactly"}
    both = M.add_marks(old, new)
    assert [r.id for r in M.list_marks(both).collect()] == ["m0", "m1", "nm1"]
    gone = spark.createDataFrame([("m0",), ("zz",)], "id string")
    assert {r.id for r in M.remove_marks(both, gone).collect()} == {"m1", "nm1"}
    assert {r.id: r.removed for r in M.removal_result(both, gone).collect()} == {"m0": True, "zz": False}
    assert M.clear(both).count() == 0 and M.mark_count(both).first()[0] == 3
    assert M.load_marks(spark, None).count() == M.load_marks(spark, str(tmp_path / "none")).count() == 0
    path = tmp_path / "marks.json"
    path.write_text('{"id":"1","repo":"r","file_path":"a","rule_id":"x"}\nnot json\n')
    assert M.load_marks(spark, str(path)).count() == 1
    left = M.unread_marks(spark, str(path))
    assert left.count() > 0 and left.where('problem IS NULL').count() == 0
    assert M.unread_marks(spark, None).count() == 0


# ---------------------------------------------------------------- catalog

def test_catalog_upkeep(spark):
    rules = rules_frame(spark)
    assert R.lint(rules).count() == 0
    more = R.add_rule(rules, "Mine", r"needle\d", "low", "d", "r")
    mine = more.where("not builtin").first()
    assert mine.rule_ord == 146 and mine.enabled and mine.language == "*" and more.where("not builtin").first().id == mine.id
    for bad in ("(", "(?P<x>a)(?P=x"):
        with pytest.raises(ValueError):
            R.add_rule(rules, "Bad", bad, "low", "d", "r")
    assert R.delete_rule(more, mine.id).count() == 146
    with pytest.raises(ValueError):
        R.delete_rule(more, "pci-000")
    with pytest.raises(KeyError):
        R.delete_rule(more, "nope")
    patch = spark.createDataFrame([("pci-000", None, "low"), ("zz", "x", "low")], "id string, name string, severity string")
    row = R.find_rule(R.patch_rules(rules, patch), "pci-000").first()
    assert row.severity == "low" and row.name == "Cardholder PAN in Source Code"
    assert [r.id for r in R.unknown_ids(rules, patch).collect()] == ["zz"]
    assert R.extend_catalog(rules, more).count() == 147
    broken = rules.limit(1).withColumn("name", F.lit(" ")).withColumn("severity", F.lit("x")).withColumn("pattern", F.lit("["))
    assert {r.problem.split(":")[0] for r in R.lint(broken.union(broken)).collect()} == {"blank name", "unknown severity", "invalid regex", "id is not unique"}
    counts = {r.scanner: (r.total, r.disabled, r.custom) for r in R.catalog_counts(more).collect()}
    assert counts["security"] == (39, 0, 1) and sum(c[0] for c in counts.values()) == 147
    assert R.list_rules(rules, "cis", "CREDENTIAL").count() == sum(
        r.scanner == "cis" and ("credential" in r.name.lower() or "credential" in r.description.lower()) for r in builtin_rules())


# ---------------------------------------------------------------- order-dependent

def greedy(items, budget):
    """First fit in the order (no hits last, tokens, position)."""
    kept = []
    for late, tokens, i in sorted(items):
        if tokens <= budget:
            kept.append(i)
            budget -= tokens
    return set(kept)


def test_packing_is_first_fit(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for case in range(150):
        items = [(rng.random() < 0.5, rng.choice([0, 1, 2, 2, 3, 5, 8, 13]), i) for i in range(rng.randint(1, 14))]
        expected[f"r{case}"] = greedy(items, 20)
        rows += [(f"r{case}", f"p{i}", i, tokens, True, late) for late, tokens, i in items]
    files = spark.createDataFrame(rows, "repo string, path string, file_ord bigint, token_count bigint, analyzed boolean, late boolean")
    packed = packing.pack_bundle(files, files.where("not late"), 20).where("in_bundle").collect()
    got = {}
    for r in packed:
        got.setdefault(r.repo, set()).add(r.file_ord)
    assert {k: got.get(k, set()) for k in expected} == expected


def test_packing_example_and_reason(spark):
    files = spark.createDataFrame([("r", p, i, t, True, None) for i, (p, t) in enumerate([("a", 7), ("b", 4), ("c", 3), ("d", 6)])],
                                  "repo string, path string, file_ord bigint, token_count bigint, analyzed boolean, skip_reason string")
    packed = packing.mark_excluded(packing.pack_bundle(files, files.where("path in ('a', 'b')"), 10)).collect()
    assert {r.path for r in packed if r.in_bundle} == {"b", "c"}
    assert {r.path: r.skip_reason for r in packed if r.skip_reason} == dict.fromkeys("ad", packing.EXCLUDED_REASON)


def test_hot_groups(spark):
    """One key with a third of the rows: numbering, limits and joins give what plain windows and joins give."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
        F.col("id").alias("file_ord"), (F.col("id") % 7).cast("int").alias("line"), F.lit(0).alias("place"))
    df = df.union(df)
    df = df.withColumn("copy", F.monotonically_increasing_id()).cache()
    placed = numbered(df.repartition(13), ["key"], ["place", "file_ord", "line", "copy"], "n")
    summed = {(r.copy, r.key): r.before for r in numbered(df, ["key"], ["file_ord", "copy"], "before", "line").collect()}
    by_key = {}
    for r in placed.collect():
        by_key.setdefault(r.key, []).append((r.file_ord, r.copy, r.line, r.n))
    for key, rows in by_key.items():
        total = 0
        for i, (_, copy, line, n) in enumerate(sorted(rows)):
            assert (n, summed[copy, key]) == (i, total)
            total += line
    first = first_n_per_group(df, ["key"], ["file_ord", "copy"], 5, ["copy"], salts=4).groupBy("key").count().collect()
    assert len(first) == 51 and all(r["count"] == 5 for r in first)
    names = df.select("key").distinct().withColumn("name", F.upper("key")).where("key != 'k7'").cache()
    for how, n in (("inner", df.where("key != 'k7'").count()), ("left", df.count())):
        joined = skew_join(df, names, ["key"], how, ["file_ord"], salts=8)
        assert joined.count() == n and joined.where("name != upper(key)").count() == 0


def test_numbering_edge_cases(spark):
    """Nulls come first and are a group of their own; no keys, one row, no rows, and a group over many ranges."""
    rows = [(None, 2), ("a", None), (None, None), ("a", 1), ("b", 1)]
    df = spark.createDataFrame(rows, "k string, o int")
    assert {(r.k, r.o): r.n for r in numbered(df, ["k"], ["o"], "n").collect()} == {(None, None): 0, (None, 2): 1, ("a", None): 0, ("a", 1): 1, ("b", 1): 0}
    assert [r.n for r in numbered(df, [], ["k", "o"], "n").orderBy("n").collect()] == list(range(5))
    assert numbered(df.where("false"), ["k"], ["o"], "n").collect() == []
    wide = spark.range(20_000).select(F.lit("r").alias("k"), F.xxhash64("id").alias("o")).repartition(40)
    got = numbered(wide, ["k"], ["o"], "n").agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (20_000, 0, 19_999)


def test_a_million_project_issues(spark):
    """Issues of one repository without a file order, in one place of the report, spread over the ranges."""
    issues = spark.range(1_000_000).select(
        F.lit("r").alias("repo"), F.lit(3).alias("place"), F.lit(None).cast("bigint").alias("file_ord"), F.lit(2).alias("part_ord"),
        (F.col("id") % 5).alias("rule_ord"), F.lit(None).cast("int").alias("line"), F.lit("project-wide").alias("file"),
        F.lit(None).cast("string").alias("rule_id"), F.concat(F.lit("note "), "id").alias("description"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        named = sarif_ids(issues)
        got = named.agg(F.count_distinct("sarif_rule_id"), F.min("sarif_rule_id"), F.max(F.length("sarif_rule_id"))).first()
        largest = named.select(F.input_file_name().alias("part")).groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert tuple(got) == (1_000_000, "llm-0000", 10) and largest < 400_000


def test_heavy_keys_are_few(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 15_000, -1).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in heavy_keys(df, ["k"]).collect()] == [(-1, 15_000)]
    assert heavy_keys(spark.range(30_000).select((F.col("id") % 15_000).alias("k")), ["k"]).count() == 0


def test_report_multiset(found):
    rows = found([{"part_ord": -1, "file_ord": -1}, {"rule_id": "x"}, {"rule_id": "y"}])
    assert V.report_multiset(rows).count() == 5
    assert V.report_multiset(rows, repeat="sarif_cli").count() == 7
    assert V.report_multiset(rows, repeat="unique").count() == 3
    bug = found([{"category": "bug"}])
    assert [r.place for r in V.report_multiset(bug, bug).orderBy("place").collect()] == [2, 3]


def test_search_and_rollup(spark, found, make_files):
    rows = found([{"severity": "info", "description": "Injection"}, {"severity": "low", "description": "SQL injection", "line": 3},
                  {"severity": "critical", "file": "INJECTION.py"}, {"severity": "high", "description": "x"}])
    assert [r.severity for r in V.search_findings(rows, "injection").collect()] == ["critical", "low"]
    files = make_files([("a.py", "Python", "x"), ("z.py", "Python", "x")])
    rolled = {r.path: r for r in V.file_rollup(files, rows).collect()}
    assert (rolled["a.py"].issue_count, rolled["a.py"].has_high, rolled["a.py"].has_critical) == (3, True, False)
    assert [i.severity for i in rolled["a.py"].issues] == ["info", "low", "high"]
    assert (rolled["z.py"].issue_count, rolled["z.py"].has_high, rolled["z.py"].issues) == (0, False, None)


# ---------------------------------------------------------------- imports and context

def specs(make_files, path, language, content):
    return [r.spec for r in imports.import_edges(make_files([(path, language, content)])).orderBy("spec_ord").collect()]


def test_python_imports(make_files):
    code = ("def f():\n    import late.mod\nimport os, pkg.a\nfrom . import x, y\nfrom .. import up\nfrom ..m.n import z\nfrom json import loads\n"
            "from .re import q\nfrom pkg.a import b\nimport pkg.a\nfrom (broken")
    assert specs(make_files, "a.py", "Python", code) == []
    code = code.rsplit("\n", 1)[0]
    assert specs(make_files, "a.py", "Python", code) == ["pkg.a", ".x", ".y", ".up", "..m.n", "late.mod"]
    assert specs(make_files, "a.rb", "Ruby", "import pkg") == []


def test_script_imports(make_files):
    code = "import a from './a'\nimport {b, c} from \"../b\"\nimport './side'\nconst x = require( '/root/x' )\nimport('./lazy')\nimport r from 'react'\nimport './a'\n"
    assert specs(make_files, "a.ts", "TypeScript", code) == ["./a", "../b", "./side", "/root/x", "./lazy"]
    assert specs(make_files, "a.jsx", "React JSX", code) == []


@pytest.mark.parametrize("path, language, code, target", [
    ("pkg/a.py", "Python", "from .b import x", "pkg/b.py"), ("pkg/a.py", "Python", "from ..top import x", "top.py"),
    ("pkg/a.py", "Python", "from ...out import x", None), ("a.py", "Python", "import pkg", "pkg/__init__.py"),
    ("a.py", "Python", "import pkg.sub.c", "pkg/sub/c.py"), ("web/a.js", "JavaScript", "import './b'", "web/b.ts"),
    ("web/a.js", "JavaScript", "import './b.js'", "web/b.ts"), ("web/a.js", "JavaScript", "import '../top.py'", "top.py"),
    ("web/a.js", "JavaScript", "import './dir'", "web/dir/index.js"), ("web/a.js", "JavaScript", "import '/web/b'", "web/b.ts"),
    ("web/a.js", "JavaScript", "import './x/../b'", "web/b.ts"), ("web/a.js", "JavaScript", "import '../../b'", None),
    ("web/a.js", "JavaScript", "import './c.svc'", "web/c.js"),
])
def test_import_targets(make_files, path, language, code, target):
    others = ["pkg/b.py", "top.py", "pkg/__init__.py", "pkg/sub/c.py", "web/b.ts", "web/b.js", "web/dir/index.js", "web/c.js"]
    files = make_files([(path, language, code)] + [(p, "Text", "") for p in others])
    row = imports.resolve_imports(imports.import_edges(files), files).first()
    assert row.target_path == target


def python_context(order, texts, budget):
    """The block by the definition, for comparison."""
    def cut(text, n):
        lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")
        return "\n".join(lines[:n] + [f"... [truncated at {n} of {name}]"]) if len(lines) > n else "\n".join(lines)
    tokens = lambda s: -(-len(s) // 4)
    used, out = tokens(context.HEADER) + 8, ""
    for spec, name in order:
        for n in (100, 30):
            text = f"### `{spec}` (from `{name}`)\n\n```\n{cut(texts[name], n)}\n```\n\n"
            if texts[name] and used + tokens(text) <= budget:
                used, out = used + tokens(text), out + text
                break
    return context.HEADER + out if out else ""


@pytest.mark.parametrize("budget", [0, 60, 120, 200, 400, 700, 2000])
def test_context_blocks(make_files, budget):
    texts = {"long.py": "".join(f"line number {i}\n" for i in range(140)), "mid.py": "m = 1\n" * 60, "tiny.py": "t = 1", "void.py": "", "one.py": "\n"}
    code = "import long, mid, void, one\nimport tiny\nfrom . import mid"
    files = make_files([("a.py", "Python", code)] + [(n, "Python", t) for n, t in texts.items()])
    got = {r.path: r.context for r in context.context_blocks(files, budget).collect()}
    texts["one.py"] = ""
    order = [("long", "long.py"), ("mid", "mid.py"), ("void", "void.py"), ("one", "one.py"), ("tiny", "tiny.py")]
    assert got["a.py"] == (python_context(order, texts, budget) if budget else "")
    assert got["mid.py"] == ""


# ---------------------------------------------------------------- prompts and responses

def test_framework_block():
    texts = {"hipaa": "H", "pci": "P"}
    assert prompts.framework_block([" HIPAA ", ""], texts, "Focus: {names}") == "Focus: HIPAA\n\nH\n\n---\n\n"
    assert prompts.framework_block(["pci", "hipaa"], texts, "", "All: {names}") == "All: PCI, HIPAA\n\nP\n\n---\n\nH\n\n---\n\n"
    assert prompts.framework_block(None, texts) == prompts.framework_block(["  "], texts) == ""
    with pytest.raises(ValueError):
        prompts.framework_block(["iso"], texts)


def test_cache(spark):
    asked = spark.createDataFrame([("r", "a", "P1"), ("r", "b", "P1"), ("r", "c", "P2"), ("r", "d", "P3")], "repo string, path string, user_prompt string")
    keyed = prompts.with_keys(asked, "p", "m", "sys")
    k = {r.user_prompt: r.key for r in keyed.collect()}
    import hashlib
    assert k["P1"] == hashlib.sha256(b"v1\0p\0m\x004096\0sys\0P1").hexdigest() and len(set(k.values())) == 3
    cache = spark.createDataFrame([(k["P1"], DAY + dt.timedelta(days=1), "one"), (k["P2"], DAY - dt.timedelta(days=1), "two")], RESPONSES)
    looked = prompts.look_up(keyed, cache, F.lit(DAY)).cache()
    assert {r.user_prompt: (r.outcome, r.uses, r.response) for r in looked.collect()} == {
        "P1": ("hit", 2, "one"), "P2": ("expired", 1, None), "P3": ("absent", 1, None)}
    assert {r.user_prompt for r in prompts.work_table(looked).collect()} == {"P2", "P3"}
    assert tuple(prompts.cache_statistics(looked).first()) == (1, 2, 2, 1)
    assert {r.path: r.response for r in prompts.spread_responses(keyed, looked).collect()} == {"a": "one", "b": "one", "c": None, "d": None}
    fresh = spark.createDataFrame([(k["P2"], "new")], "key string, response string")
    after = prompts.store_responses(cache, fresh, F.lit(DAY))
    assert {r.response: r.expires_at for r in after.collect()} == {"one": DAY + dt.timedelta(days=1), "new": DAY + dt.timedelta(days=7)}
    assert [r.response for r in prompts.keep_latest(after, 1).collect()] == ["new"]


@pytest.mark.parametrize("text, expected", [
    ('{"a": 1}', '{"a": 1}'), (' \n{"a": 1} ', '{"a": 1}'), ('x ```json\n{"a": {"b": 2}}\n``` y', '{"a": {"b": 2}}'), ('```\n{"a": 1}\n```', '{"a": 1}'),
    ('text {"a": "}{", "b": "\\"}"} more }', '{"a": "}{", "b": "\\"}"}'), ("none", None), ("{broken", None), ("{bad} {\"a\": 1}", None), ("", None),
])
def test_json_extraction(spark, text, expected):
    assert responses.extract_json(spark.createDataFrame([(text,)], "response string")).first().json == expected


def test_response_findings(spark):
    body = ('{"issues":[{"category":"bug","severity":"high","line":3,"description":"d","recommendation":"r"},{"description":"only"},'
            '{"category":"odd"},{"severity":"urgent"},{"category":null},{"line":"7"},{"line":"x"},{"line":2.5},{"description":null}],'
            '"project_level_issues":[{"description":"p"},{"file":"a.py","category":"performance"}],"overall_risk_score":70,"overall_assessment":"A"}')
    rows = spark.createDataFrame([("r", "a.py", 0, body), ("r", "b.py", 1, "junk")], "repo string, path string, file_ord bigint, response string")
    parsed = responses.parse_responses(rows, "bundle").cache()
    got = responses.file_review_findings(parsed).orderBy("rule_ord").collect()
    assert [(r.category, r.severity, r.line, r.description, r.source) for r in got] == [
        ("bug", "high", 3, "d", "llm"), ("bug", "medium", None, "only", "llm"), ("bug", "medium", 7, "", "llm")]
    project = responses.project_findings(parsed).orderBy("rule_ord").collect()
    assert [(r.category, r.file) for r in project] == [("deployment", "project-wide"), ("performance", "a.py")]
    first, second = parsed.orderBy("path").collect()
    assert (first.suggested, first.assessment, first.readable) == (70.0, "A", True)
    assert (second.suggested, second.readable, len(second.issues)) == (50.0, False, 0) and second.assessment.startswith("[Parse Error]")
    packed = spark.createDataFrame([("r", "a.py", 0, True), ("r", "unknown", 1, False)], "repo string, path string, file_ord bigint, in_bundle boolean")
    assert responses.bundle_findings(parsed, packed).count() == 0
    named = parsed.withColumn("issues", F.transform("issues", lambda i: F.map_concat(i, F.create_map(F.lit("file"), F.lit("a.py")))))
    assert responses.bundle_findings(named, packed).count() == 3
    said = responses.review_summaries(packed, responses.bundle_findings(named, packed)).first()
    assert said.summary == "3 AI-detected issues."
