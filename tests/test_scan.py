import random
import re

import pytest
from pyspark.sql import functions as F

from scangrove.catalog import Rule, active, builtin_rules, rules_frame
from scangrove.functions.regexes import folded, jvm_pattern, required_literals
from scangrove.functions.text import WHITESPACE
from scangrove.operators.rules import set_enabled
from scangrove.operators.scan import manifest_findings, scan_rules, token_gate
from scangrove.plans.snippets import CONTENTS, LINES

# The six rules whose word boundary is written out in our catalog.
BOUNDARY_RULES = {"sec-danger-000", "sec-danger-001", "sec-danger-006", "sec-danger-009", "sec-danger-014", "sec-danger-020"}


def python_scan(rules, language, content):
    """What the rules mean, by Python's own regexes, for comparison."""
    found = set()
    for r in rules:
        if r.multiline:
            m = re.search(r.pattern, content, re.M | re.S)
            if m:
                found.add((r.id, content[:m.start()].count("\n") + 1))
            continue
        if r.rule_type != "secret" and r.language not in ("*", language):
            continue
        for i, line in enumerate(content.splitlines(), 1):
            if not line.strip().startswith(("#", "//", "*", "<!--")) and re.search(r.pattern, line):
                found.add((r.id, i))
    return found


def scanned(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.file, set()).add((row.rule_id, row.line))
    return out


def test_sample_lines_and_contents(make_files):
    rows = [(f"l{i}", lang, line) for i, (lang, line, _) in enumerate(LINES)]
    rows += [(f"c{i}", lang, text) for i, (lang, text, _, _) in enumerate(CONTENTS)]
    found = scanned(scan_rules(make_files(rows)))
    covered = set()
    for i, (_, line, ids) in enumerate(LINES):
        assert found.get(f"l{i}", set()) == {(r, 1) for r in ids.split()}, line
        covered |= set(ids.split())
    for i, (_, text, ids, at) in enumerate(CONTENTS):
        assert found.get(f"c{i}", set()) == {(r, at) for r in ids.split()}, text
        covered |= set(ids.split())
    assert covered == {r.id for r in builtin_rules()}
    assert covered >= BOUNDARY_RULES


def test_same_as_python_on_mangled_text(make_files):
    """Recombined samples, odd white space, line ends, case variants and marks: JVM and Python agree."""
    rng = random.Random(7)
    samples = [(lang, line) for lang, line, _ in LINES] + [(lang, text) for lang, text, _, _ in CONTENTS]
    odd = list(WHITESPACE) + ["\r\n", "é", "²", "́", "‿", "ſ", "K", "İ", "ı", "😀", "_", "٣", "\x08", "ß", "=", "\"", "'"]
    rows = []
    for i in range(1500):
        lang, text = rng.choice(samples)
        chars = list(text)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(chars))
            what = rng.random()
            if what < 0.4:
                chars.insert(k, rng.choice(odd))
            elif what < 0.6:
                chars[k] = rng.choice(odd)
            elif what < 0.8:
                chars[k] = {"s": "ſ", "k": "K", "i": "ı"}.get(chars[k].lower(), chars[k].swapcase())
            elif len(chars) > 1:
                del chars[k]
        other = rng.choice(samples)[1] if rng.random() < 0.5 else ""
        rows.append((f"f{i}", lang, "".join(chars) + rng.choice(["", "\n", " ", "\x0c"]) + other))
    rules = builtin_rules()
    found = scanned(scan_rules(make_files(rows)))
    for path, lang, content in rows:
        assert found.get(path, set()) == python_scan(rules, lang, content), (path, lang, content)


def test_required_literals_never_lose_a_match(spark):
    """Every text a rule matches holds one of its literals once folded."""
    rng = random.Random(3)
    texts = {line for _, line, _ in LINES} | {text for _, text, _, _ in CONTENTS}
    for text in list(texts):
        for _ in range(20):
            texts.add("".join(rng.choice([c, c.swapcase(), {"s": "ſ", "k": "K", "i": "İ"}.get(c.lower(), c)]) for c in text))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded(F.col("t")).alias("f"))
    pairs = [(r.t, r.f) for r in df.collect()]
    checked = 0
    for rule in builtin_rules():
        needs = required_literals(rule.pattern)
        for text, low in pairs:
            if needs and re.search(rule.pattern, text, re.M | re.S if rule.multiline else 0):
                checked += 1
                assert any(n in low for n in needs), (rule.id, text)
    assert checked > 1000


@pytest.mark.parametrize("pattern, literals", [
    (r"foo(bar|baz)?", ["foo"]), (r"(?i)A[bc]d", ["abd", "acd"]), (r"x*y", None), (r"(ab|cd)+", ["ab", "cd"]), (r"é+abc", ["abc"]),
])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_pattern_translation():
    assert jvm_pattern(r"a\sb") == "(?Ud)a[\\s\\x1c-\\x1f]b"
    assert jvm_pattern(r"[\s&&[x]") == "(?Ud)[\\s\\x1c-\\x1f\\&\\&\\[x]"
    assert jvm_pattern(r"(?i)\bab\n", True).startswith("(?Umsd)(?i)(?=[a])(?<!")


def test_language_and_rule_scope(make_files, spark):
    files = make_files([("a.py", "Python", "eval(x)"), ("a.rb", "Ruby", "eval(x)\ntoken = 'ghp_" + "a1" * 18 + "'")])
    found = scanned(scan_rules(files))
    assert found == {"a.py": {("sec-danger-000", 1)}, "a.rb": {("sec-secret-005", 2)}}
    custom = [Rule(0, "mine", "n", "(?i)needle", "info", "d", "r", "Ruby", "cis", "custom", "CIS v8 4.9"),
              Rule(1, "off", "n", "eval", "low", "d", "r", "*", "pci", "compliance", None, False),
              Rule(2, "lost", "n", "eval", "low", "d", "r", "*", "security", "other", None)]
    files = make_files([("a.rb", "Ruby", "a\nNEEDLE eval"), ("b.py", "Python", "needle")])
    assert scanned(scan_rules(files, custom)) == {"a.rb": {("mine", 2)}}
    assert scan_rules(files, set_enabled(rules_frame(spark), False)).count() == 0


def test_finding_fields(make_files):
    line = "\t cvv = '123' " + "x" * 200
    row, = scan_rules(make_files([("p.py", "Python", line)])).collect()
    assert row.source == "pci_scanner" and row.category == "security" and row.severity == "critical"
    assert row.code_snippet == line.strip()[:150]
    assert row.compliance_ref == "PCI-DSS Req 3.3 — Prohibited Data" and row.hipaa_reference is None
    assert row.description == "CVV/CVC Storage — PCI-DSS Req 3.3 — Prohibited Data."
    row, = scan_rules(make_files([("p.py", "Python", "fhir_key = 'abcdef1'")])).collect()
    assert row.hipaa_reference == row.compliance_ref == "§164.308(a)(1) — Security Management Process"


def test_line_numbers_of_both_kinds(make_files):
    files = make_files([("a.py", "Python", "a\x0ccvv = '123'\ndef login(u):\n  return u")])
    assert scanned(scan_rules(files)) == {"a.py": {("pci-001", 2), ("hipaa-x-001", 2)}}


def test_first_match_of_whole_file_rules_after_wide_characters(make_files):
    files = make_files([("a.py", "Python", "😀\n\n😀 file.save(p)\nfile.save(q)\n")])
    assert scanned(scan_rules(files)) == {"a.py": {("soc2-006", 3)}}


def test_large_files_are_reported_and_scanned_whole(make_files):
    files = make_files([("big.py", "Python", "x = 1\n" * 10_000 + "cvv = '123'"), ("ok.py", "Python", "y")])
    rows = {r.path: r for r in token_gate(files).collect()}
    assert not rows["big.py"].analyzed and rows["ok.py"].analyzed and rows["ok.py"].skip_reason is None
    n = rows["big.py"].token_count
    assert rows["big.py"].skip_reason == f"File too large ({n} estimated tokens > 8000 limit)"
    assert token_gate(files, bundle=True).where("not analyzed").first().skip_reason == f"File too large ({n} tokens)"
    assert scanned(scan_rules(files)) == {"big.py": {("pci-001", 10_001)}}
    assert scan_rules(files, max_tokens=8_000).count() == 0


def test_manifests(make_files):
    found = manifest_findings(make_files([("pom.xml", "XML", ""), ("sub/go.mod", "Unknown", ""), ("Gemfile", "Unknown", "")])).collect()
    assert {(r.file, r.severity, r.line, r.rule_id) for r in found} == {("pom.xml", "medium", None, None), ("Gemfile", "medium", None, None)}
    assert {r.description for r in found} >= {"Ruby dependencies file found. Dependencies may contain known vulnerabilities."}


def test_scan_has_no_shuffle(make_files):
    plan = scan_rules(make_files([("a.py", "Python", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_catalog_shape():
    rules = builtin_rules()
    assert len(rules) == 146 and len(active(rules, "pci")) == 12 and sum(r.multiline for r in rules) == 11


def test_one_read_gives_hits_and_facts(spark):
    from scangrove.functions.text import count_lines, estimate_tokens
    from scangrove.operators.scan import facts_of, hits_of, scan_files
    from scangrove.schemas import FILES

    texts = ["password = 'hunter2hunter2'\neval(x)\n", "", None, "plain", "x\n" * 30_000 + "eval(y)\n", "def delete_user(a):\n    go()\n"]
    files = spark.createDataFrame([("r", i, f"f{i}.py", "Python", 1, t) for i, t in enumerate(texts)], FILES)
    both = scan_files(files)
    assert sorted(map(str, hits_of(both).collect())) == sorted(map(str, scan_rules(files).collect()))
    assert hits_of(both).where("file = 'f4.py' AND line = 30001").count() > 0
    want = files.select("repo", "file_ord", "path", "language", "size_bytes", estimate_tokens(F.col("content")), count_lines(F.col("content")))
    assert sorted(map(tuple, facts_of(both).collect())) == sorted(map(tuple, want.collect()))
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # the rules are broadcast, nothing is shuffled
    assert facts_of(scan_files(files, [])).count() == len(texts) and hits_of(scan_files(files, [])).count() == 0
    assert {r.language for r in scan_rules(files, carry=["language"]).collect()} == {"Python"}
