"""What a scan does for each line: rules are gone through in groups, and plain texts are cut without a regex."""

import random
import re

from pyspark.sql import functions as F

from scangrove.catalog import Rule, builtin_rules
from scangrove.functions.text import split_lines
from scangrove.operators import scan as S


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_rules_are_tried_in_groups(spark, make_files, capsys):
    """Only groups with a candidate are gone through; rules at the edges of groups and masks are found, each once."""
    rules = [Rule(i, f"own-{i}", "n", f"word{i}x" + ("\\n?" if i % 9 == 0 else ""), "info", "d", "r", "*", "cis", "custom", None)
             for i in range(140)]
    text = "\n".join([" ".join(f"word{i}x" for i in (0, 7, 8, 61, 62, 63, 69, 70, 123, 124, 139)), "nothing", "word7x word8x word9x"])
    scanned = S.scan_files(make_files([("a.py", "Python", text), ("b.py", "Python", "")]), rules)
    got = sorted((r.file, r.line, int(r.rule_id[4:])) for r in S.hits_of(scanned).collect())
    line = {i: 1 for i in (0, 7, 8, 61, 62, 69, 70, 123, 124, 139)} | {63: 1}
    assert got == sorted([("a.py", n, i) for i, n in line.items()] + [("a.py", 3, i) for i in (7, 8, 9)])
    assert sorted(r.path for r in S.facts_of(scanned).collect()) == ["a.py", "b.py"]
    found = plan(S.scan_files(make_files([("a.py", "Python", text)])), capsys)
    count = len(S.scannable(builtin_rules()))
    guards = len(re.findall(r"CASE WHEN NOT \(\(_m\d+#\d+L & \d+\) = 0\) THEN array\(", found))
    assert guards == sum(-(-min(S._BITS, count - at) // S._GROUP) for at in range(0, count, S._BITS)) < count / 7


def test_plain_texts_are_cut_without_a_regex(spark, capsys):
    rng = random.Random(3)
    breaks = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    texts = ["", "\n", "a\n\nb\n", "a\r\nb", "\r\n\r\n", None, *["".join(rng.choice(b) for _ in range(9)) for b in ["a\n", "aé\r\n", *("ab\n" + c for c in breaks)] * 20]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", split_lines(F.col("text")).alias("lines"))
    assert {r.id: r.lines for r in rows.collect()} == {i: None if t is None else t.splitlines() for i, t in enumerate(texts)}
    assert re.search(r"ELSE split\(text#\d+, \n, -1\)", plan(rows, capsys))
