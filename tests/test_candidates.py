"""The first pass of a scan: which lines it leaves to the rules."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from scangrove.catalog import Rule, builtin_rules
from scangrove.functions.regexes import loose_pattern, required_literals
from scangrove.operators import findings as V
from scangrove.operators import scan as S
from scangrove.plans.snippets import CONTENTS, LINES


def rule(i, pattern, language="*"):
    return Rule(i, f"own-{i}", "n", pattern, "info", "d", "r", language, "cis", "custom", None)


def test_only_lines_with_candidates_become_rows(make_files):
    rules = S.scannable(builtin_rules())
    text = "\n".join(["plain words here"] * 500 + ["cvv = '123'"] + ["more of them"] * 500 + ["4111111111111111 and 123-45-6789"])
    rows = S.candidate_lines(make_files([("a.py", "Python", text)]), rules).collect()
    assert sorted(r.line for r in rows) == [501, 1002]
    found = {(r.rule_id, r.line) for r in S.scan_rules(make_files([("a.py", "Python", text)])).collect()}
    assert found >= {("pci-001", 501), ("pci-000", 1002), ("hipaa-014", 1002)}


@pytest.mark.parametrize("window", [7, 64, 1 << 21])
def test_candidates_across_windows(monkeypatch, window):
    """Literals at the edges of windows, lines and files, and in case variants, are seen; nothing is seen across lines."""
    monkeypatch.setattr(S, "_WINDOW", window)
    rules = [rule(0, "abcdef"), rule(1, "iv"), rule(2, "(?i)skip"), rule(3, "ab", "Go"), rule(4, "x.*y\\n?"),
             rule(5, "(?i)key\\n?"), rule(6, "a\\nb")]
    files = [["abcdef", "", "iv", "ab"], [], ["i", "v", "abc", "def"], ["ſKip İv", "KEY ab"], None, ["xabcdefiv" * 9]]
    languages = ["Go", "Go", "Python", None, "Go", "Python"]
    got = S.literal_finder(rules)(pa.array(files, pa.list_(pa.string())), pa.array(languages)).to_pylist()
    bits = lambda m: {i for i in range(len(rules)) if m >> i & 1}
    assert [{x["line"]: bits(x["m0"]) for x in g["lines"]} for g in got] == [
        {0: {0, 3}, 2: {1}, 3: {3}}, {}, {}, {0: {1, 2}}, {}, {0: {0, 1}}]
    assert [bits(g["f0"]) for g in got] == [{4, 6}, {4, 6}, {4, 6}, {4, 5, 6}, {4, 6}, {4, 6}]


def test_loose_patterns_lose_no_match():
    rng = random.Random(5)
    patterns = [r.pattern for r in builtin_rules() if not r.multiline] + [r"\b\d{2,}x?", r"(a|[b-d]){2,3}?e$", r"^7+\b"]
    loose = {p: loose_pattern(p) for p in patterns}
    assert {p for p, q in loose.items() if q} >= {r.pattern for r in builtin_rules() if not r.multiline and not required_literals(r.pattern)}
    texts = [x for _, x, _ in LINES] + [x for _, x, _, _ in CONTENTS] + ["٣٣٣-٣٣-٣٣٣٣", "123-45-6789", "abde", "7777"]
    texts += ["".join(rng.choice("0123456789-'ab cdex٣4") for _ in range(12)) for _ in range(3000)]
    for pattern, text in loose.items():
        if text:
            passed = pc.match_substring_regex(pa.array(texts), text).to_pylist()
            assert all(ok or not re.search(pattern, t) for ok, t in zip(passed, texts, strict=True)), pattern
    assert loose_pattern("(?i)abc") is None and loose_pattern("a[^b]") is None and loose_pattern("é") is None


def test_sorted_findings_are_computed_once(spark, make_files):
    """A sort samples its input; what lies below, a scan perhaps, must not run again for it."""
    found = S.scan_rules(make_files([(f"f{i}.py", "Python", "cvv = '123'\neval(x)") for i in range(20)]))
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = V.search_findings(found.mapInPandas(count, found.schema), severities=["critical", "high"]).collect()
    assert seen.value == found.count() and len(rows) >= 20
    seen.value = 0
    assert len(V.in_report_order(found.mapInPandas(count, found.schema).where(F.lit(True))).collect()) == seen.value
