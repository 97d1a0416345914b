"""Rule matching: files and a rule catalog in, findings out.

One pass over the files.  The literals that any rule needs are looked up in the
lines of a file at once (numpy, in an Arrow UDF) and leave a short list of
candidate rules per line, kept as bit masks.  Only lines with candidates become
rows, plus one leading row with the whole content when a multi-line rule is a
candidate, and each row is matched against its candidates only.  There is no
shuffle; files never meet each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import MANIFEST_ADVICE, MANIFESTS, SCANNERS, Rule, active, builtin_rules, collect_rules
from ..functions.regexes import FOLD_FROM, FOLD_TO, jvm_pattern, loose_pattern, required_literals
from ..functions.text import SNIPPET_CHARS, count_lines, estimate_tokens, is_comment, split_lines, strip
from ..schemas import FINDINGS
from ..session import local_table

# Fixed value: files above this estimate are too large for a prompt.
MAX_FILE_TOKENS = 8_000

_BITS = 62
_GROUP = 8                      # rules that are asked for together
_WINDOW = 1 << 21               # bytes that are looked through at a time
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e"   # a literal with one of these may span lines


def token_gate(files: DataFrame, limit: int = MAX_FILE_TOKENS, bundle: bool = False) -> DataFrame:
    """Add token_count, analyzed and skip_reason (B9); takes files with their content, or with a token_count counted before."""
    tokens = F.col("token_count") if "token_count" in files.columns else estimate_tokens(F.col("content"))
    head, tail = ("", " tokens)") if bundle else ("", f" estimated tokens > {limit} limit)")
    reason = F.concat(F.lit(f"File too large ({head}"), F.col("token_count").cast("string"), F.lit(tail))
    return (
        files.withColumn("token_count", tokens)
        .withColumn("analyzed", F.col("token_count") <= limit)
        .withColumn("skip_reason", F.when(~F.col("analyzed"), reason))
    )


def scannable(rules: Sequence[Rule]) -> list[Rule]:
    """Enabled rules that some scanner pass picks up, in catalog order."""
    return [
        r for r in active(rules)
        if r.scanner in SCANNERS and (r.scanner != "security" or r.rule_type in ("secret", "dangerous"))
    ]


def report_part(rule: Rule) -> int:
    """Position of a rule's scanner pass within a file: secrets, dangerous calls, then the frameworks."""
    return SCANNERS.index(rule.scanner) + (0 if rule.rule_type == "secret" and rule.scanner == "security" else 1)


MODEL_PART = len(SCANNERS) + 1


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(values: Sequence[str] | None) -> str:
    return "CAST(NULL AS array<string>)" if not values else f"array({', '.join(map(_quoted, values))})"


def literal_finder(rules: Sequence[Rule]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """For an Arrow UDF over (lines of a file, its language): bit masks of the rules that may match the file and each of its lines.

    ``f0, f1, …`` are the candidates among the rules on whole files; ``lines`` has an entry for each line (from 0) with candidates among the
    others, ``m0, m1, …``.  Rules are judged by language and by literals; those without literals, by a looser pattern, or always taken.
    """
    words = -(-len(rules) // _BITS)
    units: dict[tuple[str, str | None], list[list[int]]] = {}   # what is looked for: rules on lines and on files that need it

    def need(kind: str, text: str | None, i: int) -> None:
        masks = units.setdefault((kind, text), [[0] * words, [0] * words])
        masks[rules[i].multiline][i // _BITS] |= 1 << (i % _BITS)

    scoped: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        if rule.language != "*" and not rule.multiline and rule.rule_type != "secret":
            scoped.setdefault(rule.language, [0] * words)[i // _BITS] |= 1 << (i % _BITS)
        literals = required_literals(rule.pattern)
        loose = None if rule.multiline else loose_pattern(rule.pattern)
        if literals and not any(c in s for s in literals for c in _BREAKS):
            for s in literals:
                need("literal", s, i)
        else:
            need("any" if loose is None else "loose", loose, i)
    keys = list(units)
    texts = {u: s.encode() for u, (kind, s) in enumerate(keys) if kind == "literal"}
    loosely = {u: s for u, (kind, s) in enumerate(keys) if kind == "loose"}
    always = [u for u, (kind, _) in enumerate(keys) if kind == "any"]
    heads: dict[bytes, set[int]] = {}
    for u, text in texts.items():
        for head in [text[:3]] if len(text) > 2 else [text + bytes([c]) for c in range(256)]:
            heads.setdefault(head, set()).add(u)
    for head, found in heads.items():
        found.update(u for u, text in texts.items() if len(text) == 2 and head.startswith(text))
    groups = sorted({tuple(sorted(found)) for found in heads.values()})
    numbers = {group: k + 1 for k, group in enumerate(groups)}
    codes = [(int.from_bytes(head, "big"), numbers[tuple(sorted(found))]) for head, found in heads.items()]
    longest = max([3, *map(len, texts.values())])
    fold_from, fold_to, window, held = FOLD_FROM, FOLD_TO, _WINDOW, {}
    on_lines, on_files = ([units[k][kind] for k in keys] for kind in (False, True))
    all_scoped = [sum(m[w] for m in scoped.values()) for w in range(words)]

    def run(lines: pa.Array, language: pa.Array) -> pa.Array:
        if not held:
            held["group"] = np.zeros(1 << 24, np.uint16)    # by the first three bytes: the literals that start so
            for code, number in codes:
                held["group"][code] = number
        n, begins = len(lines), lines.offsets.to_numpy().astype(np.int64)
        texts_of = lines.values.slice(begins[0], begins[-1] - begins[0]).cast(pa.large_string())
        begins = begins - begins[0]
        at, unit = [], []

        def seen(where: np.ndarray, u: int) -> None:
            at.append(where)
            unit.append(np.full(len(where), u, np.int64))

        for u, pattern in loosely.items():
            seen(np.flatnonzero(pc.match_substring_regex(texts_of, pattern).to_numpy(zero_copy_only=False)), u)
        for u in always:
            if any(on_lines[u]):
                seen(np.arange(len(texts_of)), u)
        low = pc.ascii_lower(texts_of)
        for odd, plain in zip(fold_from, fold_to, strict=True):
            if pc.any(pc.match_substring(low, odd)).as_py():
                low = pc.replace_substring(low, odd, plain)
        ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset:low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
        data = np.frombuffer(low.buffers()[2], np.uint8) if ends[-1] else np.zeros(0, np.uint8)
        for start in range(int(ends[0]), int(ends[-1]), window):
            stop = min(start + window, int(ends[-1]))
            part = np.zeros(stop - start + longest, np.uint8)
            more = data[start:min(stop + longest, int(ends[-1]))]
            part[:len(more)] = more
            wide = part[:stop - start + 2].astype(np.uint32)
            group = held["group"][(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]
            place = np.flatnonzero(group)
            if not len(place):
                continue
            place = place[np.argsort(group[place], kind="stable")]
            first = np.flatnonzero(np.diff(group[place], prepend=0))
            for lo, hi in zip(first, np.append(first[1:], len(place)), strict=True):
                for u in groups[group[place[lo]] - 1]:
                    text, here = texts[u], place[lo:hi]
                    for k in range(3, len(text)):
                        here = here[part[here + k] == text[k]]
                    here = here + start
                    row = np.searchsorted(ends, here, "right") - 1
                    seen(row[here + len(text) <= ends[row + 1]], u)
        at, unit = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *unit])
        pairs = np.unique(at * len(keys) + unit)
        at, unit = pairs // len(keys), pairs % len(keys)
        file = np.searchsorted(begins, at, "right") - 1

        def united(group: np.ndarray, masks: np.ndarray, size: int) -> np.ndarray:
            out, new = np.zeros(size, np.int64), np.flatnonzero(np.diff(group, prepend=-1))
            if len(new):
                out[group[new]] = np.bitwise_or.reduceat(masks, new)
            return out

        kinds = language.dictionary_encode()
        kind = kinds.indices.fill_null(len(kinds.dictionary)).to_numpy()
        files, marked = [], []
        rows, row = np.unique(at, return_inverse=True)
        for w in range(words):
            fixed = 0
            for u in always:
                fixed |= on_files[u][w]
            files.append(united(file, np.array([m[w] for m in on_files], np.int64)[unit], n) | fixed)
            allowed = [~all_scoped[w] | scoped.get(name, [0] * words)[w] for name in [*kinds.dictionary.to_pylist(), None]]
            marks = united(row, np.array([m[w] for m in on_lines], np.int64)[unit], len(rows))
            marked.append(marks & np.array(allowed, np.int64)[kind[np.searchsorted(begins, rows, "right") - 1]] if len(rows) else marks)
        some = np.flatnonzero(np.bitwise_or.reduce(marked)) if marked else np.zeros(0, np.int64)
        home = np.searchsorted(begins, rows[some], "right") - 1
        inner = pa.StructArray.from_arrays(
            [pa.array((rows[some] - begins[home]).astype(np.int32)), *[pa.array(m[some]) for m in marked]], ["line", *[f"m{w}" for w in range(words)]])
        cuts = np.append(0, np.cumsum(np.bincount(home, minlength=n))).astype(np.int32)
        return pa.StructArray.from_arrays([*map(pa.array, files), pa.ListArray.from_arrays(cuts, inner)], [*[f"f{w}" for w in range(words)], "lines"])

    return run


def candidate_lines(files: DataFrame, rules: Sequence[Rule], facts: bool = False) -> DataFrame:
    """The lines (from 1) that some rule may match, as line and text, with bit masks ``_m0, _m1, …`` of those rules.

    Line 0 is the whole file, where a rule on whole files may match; with ``facts`` every file has one, empty if there is no such rule,
    and the rows get the ``line_count`` of their file, from the lines that are there anyway.
    """
    words = range(-(-len(rules) // _BITS))
    entry = ", ".join(["line: int", *[f"m{w}: bigint" for w in words]])
    find = F.arrow_udf(literal_finder(rules), ", ".join([*[f"f{w} bigint" for w in words], f"lines array<struct<{entry}>>"]))
    lines = F.coalesce(split_lines(F.col("content")), F.array().cast("array<string>"))
    whole_rules = [i for i, r in enumerate(rules) if r.multiline]
    wanted = " OR ".join(["false", *[f"(_found.f{i // _BITS} & {1 << (i % _BITS)}L) != 0" for i in whole_rules]])
    masks = lambda row, name: ", ".join(f"{row}.{name}{w} AS _m{w}" for w in words)
    text = f"CASE WHEN {wanted} THEN content END"
    whole = f"struct(0 AS line, {f"coalesce({text}, '')" if facts else text} AS text, {masks('_found', 'f')})"
    single = f"transform(_found.lines, x -> struct(x.line + 1 AS line, _lines[x.line] AS text, {masks('x', 'm')}))"
    counted = {"line_count": F.when(F.col("content").isNotNull(), F.size("_lines").cast("bigint"))} if facts else {}
    return (
        files.withColumn("_lines", lines).withColumns(counted).withColumn("_found", find("_lines", "language"))
        .select(*files.columns, *counted, F.expr(f"inline(concat(array({whole}), {single}))"))
        .where(F.col("text").isNotNull() & ((F.col("line") == 0) | ~is_comment(F.col("text"))))
    )


def _bit(i: int) -> str:
    return f"(_m{i // _BITS} & {1 << (i % _BITS)}L) != 0"


#: Stands for a rule in the row that a file gets for its own facts.
_FILE = -1
FACTS = ["language", "size_bytes", "token_count", "line_count"]


def _matched(rules: Sequence[Rule], facts: bool = False) -> Column:
    """The indexes of the rules that match this row's text, one row each; with ``facts`` one more in the leading row of a file.

    Most rows have few candidates, so the rules are asked for in groups of neighbouring bits, and only groups with a candidate are gone
    through.  The array is built inside ``explode``: as a column of its own it would be
    evaluated a second time by the filter Spark derives for non-empty arrays.
    """
    groups: dict[tuple[int, int], list[int]] = {}
    for i in range(len(rules)):
        groups.setdefault((i // _BITS, i % _BITS // _GROUP), []).append(i)

    def test(i: int) -> str:
        r = rules[i]
        return (
            f"CASE WHEN line {'=' if r.multiline else '>'} 0 AND {_bit(i)} "
            f"AND text RLIKE {_quoted(jvm_pattern(r.pattern, r.multiline))} THEN {i} END"
        )

    tests = [
        f"CASE WHEN (_m{word} & {sum(1 << (i % _BITS) for i in some)}L) != 0 THEN array({', '.join(map(test, some))}) END"
        for (word, _), some in groups.items()
    ]
    if facts:
        tests.append(f"CASE WHEN line = 0 THEN array({_FILE}) END")
    return F.expr(f"explode(array_compact(flatten(array_compact(array({', '.join(tests)})))))")


def _match_line(rules: Sequence[Rule]) -> Column:
    """Line of a hit; for whole-file rules the newlines before the first match, plus one."""
    branches = ["WHEN line > 0 THEN line"]
    for i, rule in enumerate(rules):
        if rule.multiline:
            before = f"split(text, {_quoted(jvm_pattern(rule.pattern, True))}, 2)[0]"
            branches.append(f"WHEN _rule = {i} THEN 1 + regexp_count({before}, '\n')")
    return F.expr(f"CAST(CASE {' '.join(branches)} END AS int)")


def resolve_rules(rules: DataFrame | Sequence[Rule] | None) -> list[Rule]:
    if rules is None:
        return builtin_rules()
    return collect_rules(rules) if isinstance(rules, DataFrame) else list(rules)


def scan_rules(
    files: DataFrame,
    rules: DataFrame | Sequence[Rule] | None = None,
    max_tokens: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """All rule hits in a table of files, as findings.

    ``files`` may be a batch or a streaming DataFrame.  Whole texts of all files are scanned; ``max_tokens`` leaves out larger files.
    ``carry`` names columns of the files that each of their findings gets too.
    """
    return _scan(files, rules, max_tokens, list(carry), False).select(*FINDINGS.fieldNames(), *carry)


def scan_files(files: DataFrame, rules: DataFrame | Sequence[Rule] | None = None) -> DataFrame:
    """Hits and file facts from one read of the texts, as one table to store; ``hits_of`` and ``facts_of`` take it apart."""
    counted = files.withColumn("token_count", estimate_tokens(F.col("content")))
    return _scan(counted, rules, None, FACTS, True).select("is_file", *FINDINGS.fieldNames(), *FACTS)


def hits_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("NOT is_file").select(*FINDINGS.fieldNames())


def facts_of(scanned: DataFrame) -> DataFrame:
    """repo, file_ord, path, language, size_bytes, token_count and line_count of each scanned file."""
    return scanned.where("is_file").select("repo", "file_ord", F.col("file").alias("path"), *FACTS)


META = (
    "_rule int, part_ord int, rule_ord bigint, severity string, description string, recommendation string, "
    "source string, rule_id string, hipaa_reference string, compliance_ref string"
)


def _scan(files: DataFrame, rules: DataFrame | Sequence[Rule] | None, max_tokens: int | None, carry: list[str], facts: bool) -> DataFrame:
    catalog = scannable(resolve_rules(rules))
    spark = files.sparkSession
    if not catalog:
        null = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in FINDINGS if f.name not in ("repo", "file_ord", "file")]
        every = files.withColumn("line_count", count_lines(F.col("content"))) if facts else files.limit(0)
        return every.selectExpr("true AS is_file", "repo", "file_ord", "path AS file", *null, *carry)
    read = [c for c in carry if not facts or c != "line_count"]
    source = files.select(*dict.fromkeys(["repo", "file_ord", "path", "language", "content", *read]))
    if max_tokens is not None:
        source = source.where(estimate_tokens(F.col("content")) <= max_tokens)
    kept = ["repo", "file_ord", "path", *carry]
    rows = candidate_lines(source, catalog, facts).select(*kept, "line", "text", _matched(catalog, facts).alias("_rule"))
    hits = rows.select(
        *kept, "_rule", _match_line(catalog).alias("line"),
        F.when(F.col("line") > 0, F.substring(strip(F.col("text")), 1, SNIPPET_CHARS)).alias("code_snippet"),
    )
    meta = local_table(
        spark,
        [
            (i, report_part(r), r.rule_ord, r.severity, r.description, r.recommendation, f"{r.scanner}_scanner", r.id,
             r.compliance_ref if r.scanner == "hipaa" else None, r.compliance_ref)
            for i, r in enumerate(catalog)
        ],
        META,
    )
    return (
        hits.join(F.broadcast(meta), "_rule", "left" if facts else "inner")
        .withColumn("category", F.lit("security"))
        .withColumn("is_file", F.col("_rule") == _FILE)
        .withColumnRenamed("path", "file")
    )


def manifest_findings(files: DataFrame) -> DataFrame:
    """One medium finding per known dependency manifest at the root of a repository."""
    spark = files.sparkSession
    known = local_table(
        spark, [(i, name, kind) for i, (name, kind) in enumerate(MANIFESTS.items())],
        "rule_ord bigint, path string, kind string",
    )
    null = F.lit(None).cast("string")
    return files.select("repo", "path").join(F.broadcast(known), "path").select(
        "repo", F.lit(-1).cast("bigint").alias("file_ord"), F.lit(-1).alias("part_ord"), "rule_ord",
        F.lit("security").alias("category"), F.lit("medium").alias("severity"), F.col("path").alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.concat("kind", F.lit(" file found. Dependencies may contain known vulnerabilities.")).alias("description"),
        F.lit(MANIFEST_ADVICE).alias("recommendation"), null.alias("code_snippet"),
        F.lit("security_scanner").alias("source"), null.alias("rule_id"), null.alias("hipaa_reference"),
        null.alias("compliance_ref"),
    ).distinct()
