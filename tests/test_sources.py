import random
import re

import pytest
from pyspark.sql import functions as F

from scangrove.functions import text as X
from scangrove.sources import ignore, tree
from scangrove.sources.ignore import glob_regex
from scangrove.sources.repos import describe_sources, within_roots, without_files

ODD_TEXTS = ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\x1fb", "\n\n", "a\n\n", "\r\n", "\x85", "é\n😀"]


def test_lines_and_counts_as_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "i int, t string")
    rows = df.select("i", X.split_lines(F.col("t")).alias("l"), X.count_lines(F.col("t")).alias("n"), X.estimate_tokens(F.col("t")).alias("k")).collect()
    for r in rows:
        t = ODD_TEXTS[r.i]
        assert r.l == t.splitlines() and r.n == len(t.splitlines()) and r.k == -(-len(t) // 4), repr(t)


def test_strip_as_python(spark):
    texts = [f"{c}a{c}b{c}" for c in X.WHITESPACE] + ["​ x", "﻿x ", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(X.strip(F.col("t")).alias("s")).collect()] == [t.strip() for t in texts]


@pytest.mark.parametrize("path, code, language", [
    ("a.py", True, "Python"), ("x/Dockerfile", True, "Dockerfile"), ("DOCKERFILE", True, "Dockerfile"), (".env", False, "Unknown"),
    ("a.b.TSX", True, "React TSX"), ("a.m", True, "Unknown"), ("a.bash", True, "Bash"), ("Makefile", False, "Unknown"),
    ("d.py/readme", False, "Unknown"), (".hidden.py", True, "Python"), ("a.", False, "Unknown"), ("x.dockerfile", True, "Dockerfile"),
])
def test_paths(spark, path, code, language):
    row = spark.range(1).select(tree.is_code_file(F.lit(path)).alias("c"), tree.detect_language(F.lit(path)).alias("l")).first()
    assert (row.c, row.l) == (code, language)


@pytest.mark.parametrize("path, skipped, with_hidden", [
    ("src/a.py", False, False), ("node_modules/a.py", True, True), ("x/.git/y/a.py", True, True), (".x/a.py", True, False),
    ("p.egg-info/a.py", True, True), ("build", False, False), ("a/dist/b.py", True, True),
])
def test_skipped_dirs(spark, path, skipped, with_hidden):
    row = spark.range(1).select(tree.in_skipped_dir(F.lit(path)).alias("a"), tree.in_skipped_dir(F.lit(path), True).alias("b")).first()
    assert (row.a, row.b) == (skipped, with_hidden)


def test_decoding_as_python(spark):
    samples = [b"ok", b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x98\x80 \xc3\x28", b"x\xef\xbf\xbdy\xffz", "é�".encode(), b"\xed\xa0\x80a", b"\xc0\xaf"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, b binary")
    for r in df.select("i", tree.decode(F.col("b")).alias("t")).collect():
        assert r.t == samples[r.i].decode("utf-8", errors="ignore"), samples[r.i]


def test_reading_text(spark):
    text = "a\r\nb\rc\n" + "x" * 60_000
    got = spark.range(1).select(tree.read_text(F.lit(text)).alias("t")).first().t
    assert got == text.replace("\r\n", "\n").replace("\r", "\n")


@pytest.fixture(scope="module")
def repo_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for repo in ("one", "two"):
        for path, text in {
            "a.py": "cvv = '123'\r\n", "pkg/b.js": "x", "node_modules/c.js": "x", ".secret.py": "x", ".ci/d.py": "x", "big.py": "x" * 3000,
            "logs/e.py": "x", "logs/keep.py": "x", "notes.txt": "x", "Dockerfile": "FROM x", "gen/x.gen.py": "x", "requirements.txt": "x", "pkg/__init__.py": "x",
        }.items():
            target = root / repo / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(text.encode())
    (root / "one" / ".gitignore").write_text("# comment\n\n*.gen.py\nlogs/*\n!logs/keep.py\n")
    return str(root)


def test_tree_of_many_repositories(spark, repo_dir):
    whole = tree.read_tree(spark, repo_dir, many=True).cache()
    kept = tree.source_files(whole, max_file_kb=2, ignore_lines=tree.ignore_file_lines(whole))
    got = {(r.repo, r.path): r for r in kept.collect()}
    common = {"a.py", "pkg/b.js", "pkg/__init__.py", "Dockerfile", "logs/keep.py"}
    assert {p for r, p in got if r == "one"} == common
    assert {p for r, p in got if r == "two"} == common | {"logs/e.py", "gen/x.gen.py"}
    assert got["one", "a.py"].content == "cvv = '123'\n" and got["one", "a.py"].size_bytes == 13
    direct = tree.read_source_files(spark, repo_dir, many=True, max_file_kb=2)
    assert {(r.repo, r.path, r.content, r.language) for r in direct.collect()} == {(r.repo, r.path, r.content, r.language) for r in got.values()}
    assert tree.read_source_files(spark, repo_dir, many=True, max_files=1).count() == 2
    shown = tree.source_files(tree.read_tree(spark, repo_dir, many=True, include_hidden=True), include_hidden=True)
    assert {".secret.py", ".ci/d.py"} <= {r.path for r in shown.collect()}


def test_walk_order_and_hidden_names_by_uri(spark, tmp_path):
    """A walk meets the files of a folder, then its subfolders; names that Spark's own sources pass over are there, by URI as well."""
    for path in ("b.py", "a/z.py", "a/_x.py", "a/__init__.py", "a/sub/y.py", "a.b/k.py", "_private/p.py", "c.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    want = ["b.py", "c.py", "_private/p.py", "a/__init__.py", "a/_x.py", "a/z.py", "a/sub/y.py", "a.b/k.py"]
    (tmp_path / "loop").symlink_to(tmp_path)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        rows = sorted(tree.read_tree(spark, root).collect(), key=lambda r: r.file_ord)
        assert [(r.file_ord, r.path, r.content) for r in rows] == [(i, p, p) for i, p in enumerate(want)]


def test_a_wide_repository_is_listed_by_all_tasks(spark, tmp_path):
    """Thousands of folders of one repository: the level that holds them is dealt out."""
    for i in range(3000):
        (tmp_path / "repo" / f"d{i}").mkdir(parents=True)
    (tmp_path / "repo" / "d7" / "x.py").write_text("x")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        level = spark.createDataFrame([("r", f"{tmp_path}/repo/d{i}", f"d{i}/") for i in range(3000)], "repo string, folder string, inside string").repartition(32)
        dealt = level.groupBy(F.spark_partition_id().alias("p")).count().agg(F.count("*"), F.max("count")).first()
        assert dealt[0] == 32 and dealt[1] < 200
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [(r.repo, r.path) for r in tree.list_tree(spark, str(tmp_path), many=True).collect()] == [("repo", "d7/x.py")]


def test_many_ignore_lines(spark, make_files, monkeypatch):
    """The last of ten thousand lines that matches decides, with lines shared by the tasks as with slices of lines; no content is shuffled."""
    rng = random.Random(4)
    lines = [rng.choice(["*.py", "!*.py", "f{}.py", "!f{}.py", "d{}/", "!d{}/f{}.py", "d{}/*.js"]).format(*(rng.randrange(60) for _ in "ab")) for _ in range(10_000)]
    paths = [f"d{rng.randrange(60)}/f{rng.randrange(60)}.{rng.choice(['py', 'js', 'md'])}" for _ in range(400)]
    files = make_files([(p, "Python", "text") for p in sorted(set(paths))])
    given = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "repo string, line_no int, pattern string")
    compiled = [(x.startswith("!"), re.compile(glob_regex(x.removeprefix("!")).replace("\\z", "\\Z"))) for x in lines]
    want = sorted(p for p in set(paths) if next((negated for negated, regex in reversed(compiled) if regex.search(p)), True))
    kept = ignore.drop_ignored(files, given)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.path for r in kept.collect()) == want
    monkeypatch.setattr(ignore, "MOST_LINES", 0)
    assert sorted(r.path for r in ignore.drop_ignored(files, given).collect()) == want


def test_large_files_are_listed_but_not_read(spark, repo_dir):
    rows = {r.path: r for r in tree.read_tree(spark, repo_dir + "/two", max_file_kb=2).collect()}
    assert (rows["big.py"].size_bytes, rows["big.py"].content) == (3000, "")


def test_object_source(spark, repo_dir):
    rows = {(r.repo, r.path): r for r in tree.read_objects(spark, repo_dir, many=True).collect()}
    assert rows["one", "a.py"].content == "cvv = '123'\n" and ("two", "logs/e.py") in rows
    one = {r.path: r for r in tree.read_objects(spark, repo_dir + "/one", glob="*.js").collect()}
    assert set(one) == {"pkg/b.js", "node_modules/c.js"}


def test_tree_of_one_repository_and_cap(spark, repo_dir):
    files = tree.source_files(tree.read_tree(spark, repo_dir + "/two"))
    assert {r.repo for r in files.collect()} == {"two"}
    assert [r.path for r in tree.cap_files(files, 3).orderBy("path").collect()] == ["Dockerfile", "a.py", "big.py"]


@pytest.mark.parametrize("line, hits, misses", [
    ("foo", ["foo", "a/foo", "foo/b", "a/foo/b"], ["foox", "xfoo"]),
    ("/foo", ["foo", "foo/x"], ["a/foo"]),
    ("foo/", ["foo/x", "a/foo/x"], ["foo"]),
    ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
    ("*.py", ["x.py", "a/x.py"], ["x.pyc"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab"]),
    ("**/b", ["b", "x/b"], ["xb"]),
    ("a/**", ["a/x", "a/x/y"], ["a"]),
    ("f?o[ab]", ["fxoa", "foob"], ["f/oa", "foo"]),
    ("x[!a]", ["xb"], ["xa"]),
    ("a+b", ["a+b"], ["aab"]),
])
def test_ignore_globs(line, hits, misses):
    import re
    regex = glob_regex(line).replace("\\z", "\\Z")
    assert all(re.search(regex, p) for p in hits) and not any(re.search(regex, p) for p in misses)


def test_repository_names(spark):
    expected = {
        "https://github.com/o/r": ("github", "o/r"), "https://github.com/o/r.git": ("github", "o/r"), "https://github.com/o/r/": ("github", "o/r"),
        "https://example.org/o/r": ("github", "unknown_repo"), "/srv/x/app": ("local", "app"), "http://github.com/o/repo/tree/main": ("github", "o/r"),
    }
    df = describe_sources(spark.createDataFrame([(s,) for s in expected], "source string"))
    assert {r.source: (r.source_type, r.repo_name) for r in df.collect()} == expected


def test_roots(spark):
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",)], "path string")
    assert {r.path for r in within_roots(df, "/a, /c/").collect()} == {"/a", "/a/b", "/c/d"}
    assert within_roots(df, None).count() == within_roots(df, "/").count() == 4


def test_requested_repositories_without_files(spark, make_files):
    asked = spark.createDataFrame([("r",), ("none",)], "repo string")
    assert [r.repo for r in without_files(asked, make_files([("a.py", "Python", "x")])).collect()] == ["none"]


def test_decoding_keeps_the_characters_it_uses_itself(spark):
    from pyspark.sql import functions as F

    samples = [b"a\xef\xb7\x90b\xff", b"\xef\xb7\x90\xff\xef\xb7\x92", b"\xef\xb7\x90\xef\xb7\x91\xef\xbf\xbd\xc0", b"\xff", b""]
    df = spark.createDataFrame(list(enumerate(map(bytearray, samples))), "i int, b binary")
    for r in df.select("i", tree.decode(F.col("b")).alias("t")).collect():
        assert r.t == samples[r.i].decode("utf-8", errors="ignore"), samples[r.i]
