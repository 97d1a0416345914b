"""The named queries in SQL, for checking results with another engine.

Written for RE2, which has no look-around and only ASCII classes: classes and
word boundaries are spelled out, and the rules with look-ahead are stated as
"matches this but not that".
"""

from __future__ import annotations

import re

from ..catalog import CATEGORIES, MANIFEST_ADVICE, MANIFESTS, SARIF_LEVEL, SECTIONS, SEVERITIES, SEVERITY_WEIGHT, Rule, builtin_rules
from ..functions.text import WHITESPACE
from ..operators.context import HEADER
from ..operators.packing import EXCLUDED_REASON
from ..operators.responses import UNREADABLE
from ..operators.scan import MODEL_PART, report_part, scannable
from ..sources.tree import CODE_SUFFIXES, LANGUAGES, SKIPPED_DIRS
from .corpus import MANIFEST_EVERY, REPO_BLOCK, SUFFIXES
from .snippets import CONTENTS, LINES

ORACLES: dict[str, str] = {}


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(values: list[str], index: str) -> str:
    return f"[{', '.join(map(lit, values))}][CAST(({index}) % {len(values)} + 1 AS INTEGER)]"


def values(rows) -> str:
    def one(v):
        return lit(v) if v is None or isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
WORD, SPACE = r"\p{L}\p{N}_", r"\s\x0b\x{85}\p{Z}\x1c-\x1f"


def re2(pattern: str) -> str:
    """A rule pattern without look-ahead in RE2's terms; fit for asking whether there is a match."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two in (r"\s", r"\w", r"\d"):
            inner = {"s": SPACE, "w": WORD, "d": r"\p{Nd}"}[two[1]]
            out.append(inner if in_class else f"[{inner}]")
        elif two == r"\b" and not in_class:
            ahead = i + 2 < len(pattern) and pattern[i + 2] not in "|)"
            out.append(f"(?:^|[^{WORD}])" if ahead else f"(?:$|[^{WORD}])")
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def _unless_later(head: str, stop: str) -> str:
    """Matches ``head`` somewhere with ``stop`` nowhere after it on the line."""
    return f"({has('text', head)} AND NOT {has('regexp_extract(text, ' + lit('(?i)^.*' + head.replace('(?i)', '') + '(.*)$') + ', 1)', stop)})"


_LOCAL = r"""^.http://(?:localhost|127\.0\.0\.1|::1)"""
_FIELD = re2(r"(?i)(?:ssn|social_security|national_id|passport_number|date_of_birth|credit_card|iban|tax_id)\s*=")
_http = f"""(len(list_filter(regexp_extract_all(text, {lit(r'''["']http://[^"']{4,}["']''')}), lambda x: NOT {has('x', _LOCAL)})) > 0)"""
_table = re2(r"(?i)CREATE\s+TABLE\s+\w*(?:user|customer|member|subscriber)\w*\s*\([^;]*\)")
LOOK_AHEAD = {
    "hipaa-000": _http, "cis-005": _http,
    "hipaa-009": _unless_later(re2(r"(?i)(?:mysql|postgresql|postgres|mongodb)://[^:\s]+:[^@\s]+@"), "(?i)ssl"),
    "gdpr-005": _unless_later(_FIELD, "(?i)encrypt"), "cis-001": _unless_later(_FIELD, "(?i)encrypt"),
    "hipaa-x-000": _unless_later(re2(r"(?i)(?:phi|patient_?data|ePHI)\s*="), "(?i)encrypt|cipher|aes"),
    "gdpr-009": f"({has('text', _table)} AND NOT {has(f'regexp_extract(text, {lit(_table + chr(40) + chr(91) + chr(94) + chr(59) + chr(93) + chr(42) + chr(41))}, 1)', '(?i)deleted_at|expires_at|expiry|ttl')})",
    "sec-x-003": has("text", r"sk-[A-Za-z0-9]{20,}"),
}
# Whole-file rules with look-ahead: (head, what must not follow it).
NOT_FOLLOWED = {
    "soc2-005": (r"(?i)def\s+(?:delete_\w+|drop_\w+|purge_\w+|admin_\w+|revoke_\w+)\s*\([^)]*\):\n", r"\s*(?:log|audit|logger)"),
    "owasp-024": (r"(?i)def\s+(?:delete_\w+|drop_\w+|purge_\w+|admin_\w+|revoke_\w+|destroy_\w+)\s*\([^)]*\):\s*\n", r"\s*(?:log|audit|logger|logging|print)"),
    "hipaa-x-001": (r"(?i)(?:def|function)\s+(?:login|authenticate|signin|sign_in|verify_?token)\s*\([^)]*\):\s*\n", r"\s*(?:log|audit|logger|logging)"),
    "gdpr-x-000": (r"(?i)(?:def|function)\s+delete_(?:user|customer|account|profile|record)\s*\([^)]*\):\s*\n", r"\s*(?:anonymize|pseudonymize|gdpr|consent|retention)"),
    "soc2-006": (r"(?i)(?:file\.save|\.put_object|store_file|upload_file)\s*\([^)]*\)", r"[^\n]*(?:check|valid|allow|extension|content.type)"),
}
NOT_FOLLOWED["cis-013"] = NOT_FOLLOWED["owasp-024"]


def _line_test(rule: Rule) -> str:
    test = LOOK_AHEAD.get(rule.id) or has("text", re2(rule.pattern))
    if rule.language != "*" and rule.rule_type != "secret":
        test = f"language = {lit(rule.language)} AND {test}"
    return f"CASE WHEN {test} THEN {lit(rule.id)} END"


def _file_test(rule: Rule) -> str:
    if rule.id in NOT_FOLLOWED:
        head, stop = (re2(p) for p in NOT_FOLLOWED[rule.id])
        heads = f"len(regexp_extract_all(content, {lit('(?ms)' + head)}))"
        test = f"{heads} > len(regexp_extract_all(content, {lit('(?ms)' + head + stop)}))"
    else:
        head = re2(rule.pattern)
        test = has("content", "(?ms)" + head)
    before = f"regexp_extract(content, {lit('(?s)^(.*?)(?:' + head + ')')}, 1)"
    return f"CASE WHEN {test} THEN {{'id': {lit(rule.id)}, 'line': 1 + length({before}) - length(replace({before}, chr(10), ''))}} END"


def read_text(text: str) -> str:
    return f"regexp_replace({text}, '\\r\\n?', chr(10), 'g')"


def lines_of(table: str, keys: str, content: str = "content") -> str:
    return (
        f"(SELECT {keys}, unnest(arr) AS text, generate_subscripts(arr, 1) AS line FROM (SELECT {keys}, CASE WHEN parts[-1] = '' "
        f"THEN parts[1:len(parts)-1] ELSE parts END AS arr FROM (SELECT *, regexp_split_to_array({content}, {lit(BREAK)}) AS parts FROM {table})))"
    )


STRIPPED = f"trim(text, {lit(WHITESPACE)})"
COMMENT = f"regexp_matches({STRIPPED}, '^(?:#|//|\\*|<!--)')"
DOC_REPO = f"source || '-' || CAST(doc_id // {REPO_BLOCK} AS VARCHAR)"
DOC_PATH = (
    "CASE WHEN doc_id % 59 = 0 THEN '.hidden/' ELSE '' END || CASE WHEN doc_id % 53 = 0 THEN 'node_modules/' ELSE '' END || "
    f"CASE WHEN doc_id % {MANIFEST_EVERY} = 0 THEN {pick(list(MANIFESTS), f'doc_id // {MANIFEST_EVERY}')} "
    f"ELSE 'src/' || CAST(doc_id % 7 AS VARCHAR) || '/f' || CAST(doc_id AS VARCHAR) || {pick(SUFFIXES, 'doc_id')} END"
)
SUFFIX = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
LANGUAGE = "CASE " + " ".join(f"WHEN {SUFFIX} = {lit(k)} THEN {lit(v)}" for k, v in LANGUAGES.items()) + " ELSE 'Unknown' END"
IS_CODE = f"{SUFFIX} IN ({', '.join(map(lit, CODE_SUFFIXES))})"
SKIPPED = f"regexp_matches(path, '(^|/)({'|'.join(re.escape(d) for d in SKIPPED_DIRS)}|\\.[^/]*|[^/]*\\.egg-info)/')"
TOKENS = "CAST(ceil(length(content) / 4.0) AS BIGINT)"
RULES = scannable(builtin_rules())


def rule_values(rules: list[Rule]) -> str:
    return values(
        (r.id, report_part(r), r.rule_ord, r.name, r.severity, r.description, r.recommendation, r.scanner, r.rule_type,
         r.compliance_ref if r.scanner == "hipaa" else None, r.compliance_ref, r.language) for r in rules
    )


def scan_ctes(files: str, rules: list[Rule] | None = None) -> dict[str, str]:
    """CTEs from a files CTE to its hits."""
    rules = RULES if rules is None else rules
    line_rules, file_rules = [r for r in rules if not r.multiline], [r for r in rules if r.multiline]
    parts = []
    if line_rules:
        parts.append(
            f"SELECT repo, file_ord, path AS file, language, line, substring({STRIPPED}, 1, 150) AS code_snippet, rule_id FROM (SELECT *, "
            f"unnest([{', '.join(map(_line_test, line_rules))}]) AS rule_id FROM {lines_of(files, 'repo, file_ord, path, language')} "
            f"WHERE NOT {COMMENT}) WHERE rule_id IS NOT NULL")
    if file_rules:
        parts.append(
            "SELECT repo, file_ord, path AS file, language, hit.line AS line, CAST(NULL AS VARCHAR) AS code_snippet, hit.id AS rule_id FROM "
            f"(SELECT *, unnest([{', '.join(map(_file_test, file_rules))}]) AS hit FROM {files}) WHERE hit IS NOT NULL")
    names = "rule_id, part_ord, rule_ord, name, severity, description, recommendation, scanner, rule_type, hipaa_reference, compliance_ref, rule_language"
    return {
        f"rules({names})": rule_values(rules),
        "raw": " UNION ALL ".join(parts),
        "hits": "SELECT repo, file_ord, CAST(part_ord AS BIGINT) AS part_ord, CAST(rule_ord AS BIGINT) AS rule_ord, 'security' AS category, severity, "
                "file, CAST(line AS BIGINT) AS line, description, recommendation, code_snippet, scanner || '_scanner' AS source, rule_id, "
                "hipaa_reference, compliance_ref FROM raw JOIN rules USING (rule_id)",
    }


TREE = {
    "made": "SELECT *, text || chr(10) || CASE WHEN doc_id % 13 = 0 THEN '# ' ELSE '' END || " + pick([x[1] for x in LINES], "doc_id")
            + " || CASE WHEN doc_id % 11 = 0 THEN chr(10) || " + pick([x[1] for x in CONTENTS], "doc_id") + " ELSE '' END AS made_text FROM documents",
    "tree": f"SELECT {DOC_REPO} AS repo, doc_id AS file_ord, {DOC_PATH} AS path, CAST(octet_length(encode(made_text)) AS BIGINT) AS size_bytes, "
            f"{read_text('made_text')} AS content FROM made",
}
FILES = {
    **TREE,
    "files": f"SELECT repo, file_ord, path, {LANGUAGE} AS language, size_bytes, content FROM tree "
             f"WHERE NOT {SKIPPED} AND {IS_CODE}",
}
HITS = {**FILES, **scan_ctes("files")}
NOTE = "'Review note ' || CAST({0} % 7 AS VARCHAR)"
MARKS = {
    "marks": f"SELECT 'mark-' || CAST(doc_id AS VARCHAR) AS id, {DOC_REPO} AS repo, {DOC_PATH} AS file_path, "
             "CASE doc_id % 3 WHEN 0 THEN 'pci-004' WHEN 1 THEN 'owasp-005' END AS rule_id, "
             f"CASE WHEN doc_id % 3 = 2 THEN 'sha256:' || sha256({NOTE.format('doc_id')}) END AS description_hash, "
             "'known' AS reason, doc_id AS marked_at, 'user' AS marked_by FROM labels JOIN documents USING (doc_id) WHERE quality = 0",
}
KEPT = {
    **HITS, **MARKS,
    "kept": "SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.repo = h.repo AND m.file_path = h.file AND m.rule_id = h.rule_id)",
}
MODEL_ROWS = {
    "model": f"SELECT repo, file_ord, CAST({MODEL_PART} AS BIGINT) AS part_ord, CAST(0 AS BIGINT) AS rule_ord, "
             f"CASE WHEN file_ord % 6 = 5 THEN 'bug' ELSE {pick(CATEGORIES, 'file_ord')} END AS category, "
             f"CASE WHEN file_ord % 6 = 5 THEN 'medium' ELSE {pick(SEVERITIES, 'file_ord')} END AS severity, path AS file, "
             "CASE WHEN file_ord % 6 <> 5 THEN file_ord % 40 END AS line, " + NOTE.format("file_ord") + " AS description, "
             "CASE WHEN file_ord % 6 = 5 THEN '' ELSE 'Look at it' END AS recommendation, CAST(NULL AS VARCHAR) AS code_snippet, 'llm' AS source, "
             "CAST(NULL AS VARCHAR) AS rule_id, CAST(NULL AS VARCHAR) AS hipaa_reference, CAST(NULL AS VARCHAR) AS compliance_ref "
             "FROM files WHERE file_ord % 6 NOT IN (3, 4)",
}
MODEL = {**FILES, **MODEL_ROWS}
KEPT_MODEL = {
    **MARKS,
    "kept_model": "SELECT * FROM model h WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.repo = h.repo AND m.file_path = h.file "
                  "AND m.description_hash = 'sha256:' || sha256(h.description))",
}
PROJECT = {"project": "SELECT * REPLACE ('project-wide' AS file, CAST(NULL AS BIGINT) AS line) FROM model"}
MANIFEST_ROWS = {
    "known(path, kind, ord)": values((n, k, i) for i, (n, k) in enumerate(MANIFESTS.items())),
    "manifests": "SELECT DISTINCT repo, CAST(-1 AS BIGINT) AS file_ord, CAST(-1 AS BIGINT) AS part_ord, CAST(ord AS BIGINT) AS rule_ord, "
                 "'security' AS category, 'medium' AS severity, path AS file, CAST(NULL AS BIGINT) AS line, "
                 "kind || ' file found. Dependencies may contain known vulnerabilities.' AS description, "
                 f"{lit(MANIFEST_ADVICE)} AS recommendation, CAST(NULL AS VARCHAR) AS code_snippet, 'security_scanner' AS source, "
                 "CAST(NULL AS VARCHAR) AS rule_id, CAST(NULL AS VARCHAR) AS hipaa_reference, CAST(NULL AS VARCHAR) AS compliance_ref "
                 "FROM tree JOIN known USING (path)",
}
FOUND = {
    **KEPT, **MANIFEST_ROWS,
    "found": "SELECT * FROM kept UNION ALL SELECT * FROM manifests WHERE repo IN (SELECT repo FROM files)",
    "repos": "SELECT DISTINCT repo FROM files",
}
RANK = "CASE severity " + " ".join(f"WHEN {lit(s)} THEN {i}" for i, s in enumerate(SEVERITIES)) + " END"
LEVEL = "CASE {0} " + " ".join(f"WHEN {lit(s)} THEN {lit(v)}" for s, v in SARIF_LEVEL.items()) + " ELSE 'warning' END"
POINTS = ("CASE severity " + " ".join(f"WHEN {lit(s)} THEN {w}" for s, w in SEVERITY_WEIGHT.items()) + " ELSE 1 END "
          "+ CASE WHEN category = 'security' AND severity IN ('critical', 'high') THEN 5 ELSE 0 END")


def counts_ctes(found: str, repos: str = "repos") -> dict[str, str]:
    each = ", ".join(f"coalesce(count(*) FILTER (severity = {lit(s)}), 0) AS {s}" for s in SEVERITIES)
    keep = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ["issues", "points", *SEVERITIES])
    return {
        "per_repo": f"SELECT repo, count(*) AS issues, sum({POINTS}) AS points, {each} FROM {found} GROUP BY repo",
        "counts": f"SELECT r.repo, {keep} FROM (SELECT DISTINCT repo FROM {repos}) r LEFT JOIN per_repo p ON p.repo = r.repo",
    }


BAND = "CASE WHEN risk_score >= 75 THEN 'Critical Risk' WHEN risk_score >= 50 THEN 'High Risk' WHEN risk_score >= 25 THEN 'Medium Risk' ELSE 'Low Risk' END"
SCORE = "least(100, points)"
SENTENCE = (
    "{0} || ' found ' || issues || ' issue' || CASE WHEN issues = 1 THEN '' ELSE 's' END || CASE WHEN critical > 0 AND high > 0 THEN ', including ' || critical "
    "|| ' critical and ' || high || ' high severity' WHEN critical > 0 THEN ', including ' || critical || ' critical' WHEN high > 0 THEN ', including ' "
    "|| high || ' high severity' ELSE '' END"
)
STATIC_SENTENCE = SENTENCE.format("'Static analysis'") + " || '. No LLM-based code review was performed; results reflect regex and pattern-matching only.'"
CHECKLIST = {
    "sections(framework, sec_ord, section, title, needle)": values((f, i, s, t, n) for i, (f, s, t, n, _) in enumerate(SECTIONS)),
    "checklist": "SELECT r.repo, s.framework, s.section, s.title, s.sec_ord, count(f.file) AS findings_count, "
                 "CASE WHEN count(f.file) > 0 THEN 'fail' ELSE 'pass' END AS status, "
                 f"[{', '.join(map(lit, SEVERITIES))}][max(f.sev_rank) + 1] AS worst_severity FROM repos r CROSS JOIN sections s LEFT JOIN "
                 f"(SELECT *, {RANK} AS sev_rank FROM found) f ON f.repo = r.repo "
                 "AND contains(CASE WHEN s.framework = 'HIPAA' THEN f.hipaa_reference ELSE f.compliance_ref END, s.needle) "
                 "GROUP BY r.repo, s.framework, s.section, s.title, s.sec_ord",
}
ORDER = "place, file_ord, part_ord, rule_ord, line"


def listed_ctes(found: str) -> dict[str, str]:
    return {
        "listed": f"SELECT *, 0 AS place FROM {found} WHERE category = 'security' UNION ALL SELECT *, 2 AS place FROM {found} WHERE part_ord >= 0",
        "identified": "SELECT *, coalesce(rule_id, 'llm-' || lpad(CAST(n - 1 AS VARCHAR), 4, '0')) AS sarif_rule_id FROM (SELECT *, row_number() OVER "
                      f"(PARTITION BY repo, rule_id IS NULL ORDER BY {ORDER}) AS n FROM listed)",
    }


def sarif_rule_ctes(keep: str) -> dict[str, str]:
    return {
        "used": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sarif_rule_id ORDER BY {ORDER}) AS k FROM identified) WHERE k = 1",
        "described": "SELECT u.repo, u.sarif_rule_id AS id, CASE WHEN r.name IS NULL THEN u.sarif_rule_id ELSE trim(regexp_replace(r.name, "
                     "'[^A-Za-z0-9]+', '_', 'g'), '_') END AS name, coalesce(r.name, substring(u.description, 1, 120)) AS short, "
                     'coalesce(r.description, u.description) AS "full", coalesce(r.recommendation, u.recommendation) AS help, '
                     + LEVEL.format("coalesce(r.severity, u.severity)") + " AS level, coalesce(r.scanner, 'llm') AS scanner, "
                     "coalesce(r.rule_type, 'ai-detected') AS rule_type, CASE WHEN r.name IS NULL THEN u.compliance_ref ELSE r.compliance_ref END "
                     "AS compliance_ref, nullif(r.rule_language, '*') AS language FROM used u LEFT JOIN "
                     f"(SELECT * FROM rules WHERE {keep}) r ON r.rule_id = u.rule_id",
    }


SARIF_COLUMNS = (
    f"repo, CAST(place AS BIGINT) AS place, sarif_rule_id AS rule_id, {LEVEL.format('severity')} AS level, description AS message, file AS uri, "
    "line AS start_line, CASE WHEN line IS NOT NULL THEN code_snippet END AS snippet, category, source, compliance_ref, hipaa_reference"
)
HIT = "repo, file, line, rule_id"


def oracle(name: str, ctes: dict[str, str], select: str) -> None:
    ORACLES[name] = "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + select if ctes else select


def subset(*scanners: str, kind: str | None = None) -> list[Rule]:
    return [r for r in RULES if r.scanner in scanners and kind in (None, r.rule_type)]


# ---------------------------------------------------------------- sources
_F1 = has("path", r"(^|/)f1[^/]\.py(/|$)")
_MD, _BACK = has("path", r"(^|/)[^/]*\.md(/|$)"), has("path", r"^src/1/[^/]*\.md(/|$)")
oracle("a2_ignore_lines", FILES, f"SELECT repo, file_ord, path FROM files WHERE NOT ({_F1} "
       f"OR {has('path', '^src/3/.')} OR ({_MD} AND NOT {_BACK}))")
oracle("a3_directory_pruning", TREE, f"SELECT repo, file_ord, path FROM tree WHERE NOT {SKIPPED}")
oracle("a4_code_files", TREE, f"SELECT repo, path FROM tree WHERE {IS_CODE}")
oracle("a5_language_detection", TREE, f"SELECT repo, path, {LANGUAGE} AS language FROM tree")
oracle("a6_size_filter", FILES, "SELECT repo, path, language, size_bytes FROM files WHERE size_bytes <= 2048")
oracle("a7_file_cap", FILES, "SELECT repo, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM files) WHERE n <= 20")
oracle("a8_read_text", {}, f"SELECT page_id, length({read_text('html')}) AS chars, md5({read_text('html')}) AS digest FROM pages")
DECODED = "text || chr(64976) || chr(64978) || chr(65533) || 'z'"
oracle("a8_decoded_bytes", {}, f"SELECT doc_id, length({read_text(DECODED)}) AS chars, md5({read_text(DECODED)}) AS digest FROM documents")
oracle("a10_loaded_marks", MARKS, "SELECT id, repo, file_path, rule_id, description_hash, reason, marked_by FROM marks WHERE marked_at % 5 <> 4")
oracle("a10_unread_marks", MARKS, "SELECT 'unreadable' AS problem, count(*) AS marks FROM marks WHERE marked_at % 5 = 4 HAVING count(*) > 0")
oracle("a11_repo_references", {
    "s": "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'https://github.com/owner' || page_id || '/repo' || page_id || '.git' "
         "WHEN 2 THEN 'https://github.com/owner' || page_id || '/repo' || page_id || '/tree/main' "
         "WHEN 3 THEN '/srv/checkouts/repo' || page_id || '/' ELSE url END AS source FROM pages",
}, "SELECT page_id, source, CASE WHEN page_id % 4 = 3 THEN 'local' ELSE 'github' END AS source_type, CASE page_id % 4 "
   "WHEN 1 THEN 'owner' || page_id || '/repo' || page_id WHEN 2 THEN 'owner' || page_id || '/r' WHEN 3 THEN 'repo' || page_id ELSE 'unknown_repo' END AS repo_name FROM s")
oracle("a12_allowed_roots", TREE, "SELECT repo, '/' || path AS path FROM tree WHERE path LIKE 'src/1/%' OR path LIKE 'src/3/%' OR path LIKE 'node\\_modules/%' ESCAPE '\\'")
oracle("a13_repos_without_files", FILES, "SELECT DISTINCT 'src' || (user_id % 40) || '-0' AS repo, 'no analyzable code files found' AS problem FROM events "
       "WHERE 'src' || (user_id % 40) || '-0' NOT IN (SELECT repo FROM files)")

# ---------------------------------------------------------------- filters and projections
oracle("b1_lines", FILES, f"SELECT repo, path, line, md5(text) AS digest FROM {lines_of('files', 'repo, path')}")
oracle("b2_comment_lines", FILES, f"SELECT repo, path, line FROM {lines_of('files', 'repo, path')} WHERE {COMMENT}")
oracle("b3_stripped_lines", {}, f"SELECT page_id, line, md5({STRIPPED}) AS digest FROM {lines_of('pages', 'page_id', 'html')}")
oracle("b4_active_rules", {**FILES, **scan_ctes("files", subset("security", kind="secret"))}, f"SELECT {HIT} FROM hits")
oracle("b5_rule_listing", HITS, "SELECT rule_id AS id, name, scanner, severity, (SELECT count(*) FROM hits h WHERE h.rule_id = rules.rule_id) AS hits FROM rules "
       "WHERE lower(name) LIKE '%credential%' OR lower(description) LIKE '%credential%'")
oracle("b6_severity_threshold", HITS, f"SELECT {HIT}, severity FROM hits WHERE severity IN ('high', 'critical')")
oracle("b7_issue_search", HITS, f"SELECT {HIT}, severity FROM hits WHERE severity IN ('high', 'critical') AND (description ILIKE '%injection%' OR file ILIKE '%injection%')")
oracle("b8_issues_by_category", {**MODEL, **PROJECT}, "SELECT repo, file, severity, description FROM (SELECT * FROM model UNION ALL SELECT * FROM project) WHERE category = 'performance'")
oracle("b9_token_gate", FILES, f"SELECT repo, path, {TOKENS} AS token_count, {TOKENS} <= 1000 AS analyzed, CASE WHEN {TOKENS} > 1000 THEN "
       f"'File too large (' || {TOKENS} || ' estimated tokens > 1000 limit)' END AS skip_reason FROM files")
oracle("b10_findings", HITS, f"SELECT {HIT}, category, severity, description, recommendation, code_snippet, source, hipaa_reference, compliance_ref FROM hits")
oracle("b11_model_findings", MODEL, "SELECT repo, file, line, category, severity, description, recommendation, source FROM model")
oracle("b12_analyzed_and_skipped", FILES, f"SELECT repo, count(*) AS files, CASE WHEN {TOKENS} <= 500 THEN 'analyzed' ELSE 'skipped' END AS kind FROM files GROUP BY ALL")

# ---------------------------------------------------------------- matching and joins
oracle("c1_line_rules", {**FILES, **scan_ctes("files", [r for r in RULES if not r.multiline])}, f"SELECT {HIT} FROM hits")
oracle("c2_whole_file_rules", {**FILES, **scan_ctes("files", [r for r in RULES if r.multiline])}, f"SELECT {HIT} FROM hits")
oracle("c3_language_scope", {**FILES, **scan_ctes("files", subset("security", kind="dangerous"))}, "SELECT rule_id, language, count(*) AS hits FROM raw GROUP BY ALL")
DOC_FILES = {"docs": f"SELECT source AS repo, doc_id AS file_ord, CAST(doc_id AS VARCHAR) AS path, 'Markdown' AS language, {read_text('text')} AS content FROM documents"}
DOC_HITS = {**DOC_FILES, **scan_ctes("docs")}
oracle("c1_document_scan", DOC_HITS, f"SELECT {HIT}, code_snippet FROM hits")
oracle("c1_page_scan", {"p": f"SELECT 'web' AS repo, page_id AS file_ord, url AS path, 'HTML' AS language, {read_text('html')} AS content FROM pages", **scan_ctes("p")},
       "SELECT file_ord AS page_id, line, rule_id, code_snippet FROM hits")
oracle("c1_conversation_scan", {
    "p": f"SELECT role AS repo, turn AS file_ord, conv_id || '/' || turn AS path, 'Markdown' AS language, {read_text('text')} AS content FROM conversations",
    **scan_ctes("p")}, f"SELECT {HIT} FROM hits")
oracle("c4_suppress_by_rule", KEPT, f"SELECT {HIT} FROM kept")
oracle("c5_suppress_by_description", {**MODEL, **KEPT_MODEL}, "SELECT repo, file, line, description FROM kept_model")
oracle("c6_checklists", {**FOUND, **CHECKLIST}, "SELECT repo, framework, section, title, findings_count, status, worst_severity FROM checklist")
oracle("c7_rule_metadata", {**FOUND, **listed_ctes("found"), **sarif_rule_ctes("scanner <> 'cis'")}, "SELECT * FROM described")
PACKED = {
    **HITS,
    "sized": f"SELECT repo, path, file_ord, {TOKENS} AS token_count, {TOKENS} <= 8000 AS analyzed, "
             "(repo, path) NOT IN (SELECT repo, file FROM hits) AS late FROM files",
    "early": "SELECT *, sum(token_count) OVER (PARTITION BY repo ORDER BY token_count, file_ord) AS total FROM sized WHERE analyzed AND NOT late",
    "spent": "SELECT repo, sum(token_count) AS used FROM early WHERE total <= 9000 GROUP BY repo",
    "rest": "SELECT s.*, coalesce(used, 0) + sum(token_count) OVER (PARTITION BY repo ORDER BY token_count, file_ord) AS total FROM sized s LEFT JOIN spent USING (repo) WHERE analyzed AND late",
    "chosen": "SELECT repo, path FROM early WHERE total <= 9000 UNION ALL SELECT repo, path FROM rest WHERE total <= 9000",
    "packed": "SELECT *, (repo, path) IN (SELECT repo, path FROM chosen) AS in_bundle FROM sized",
}
oracle("c9_bundle_findings", {**PACKED, **MODEL_ROWS}, "SELECT repo, file, line, description, severity FROM model WHERE (repo, file) IN (SELECT repo, path FROM chosen)")
oracle("c10_manifests", {**TREE, **MANIFEST_ROWS}, "SELECT repo, file, severity, description, recommendation FROM manifests")
KEY = "sha256(concat_ws(chr(0), 'v1', 'provider', 'model', '4096', 'Be brief.', text))"
LOOKUP = {
    "keyed": f"SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, text AS user_prompt, {KEY} AS key FROM documents",
    "cache": f"SELECT {KEY} AS key, max(ts + INTERVAL 2 DAY) AS expires_at FROM documents JOIN events ON event_id = doc_id GROUP BY 1",
    "looked": "SELECT k.key, min(user_prompt) AS user_prompt, count(*) AS uses, CASE WHEN max(expires_at) >= TIMESTAMP '2024-01-04 00:00:00' THEN 'hit' "
              "WHEN max(expires_at) IS NOT NULL THEN 'expired' ELSE 'absent' END AS outcome FROM keyed k LEFT JOIN cache c ON c.key = k.key GROUP BY k.key",
    "answered": "SELECT *, CASE WHEN outcome = 'hit' THEN 'answer ' || key END AS response FROM looked",
}
oracle("c11_response_lookup", LOOKUP, "SELECT key, uses, outcome, response FROM answered")

# ---------------------------------------------------------------- aggregates
BREAKDOWN = f"count(DISTINCT file_ord) AS file_count, count(line) AS line_count, min(file_ord) AS first_seen FROM {lines_of('files', 'repo, file_ord, language')}"
oracle("d1_language_breakdown", FILES, f"SELECT repo, language, {BREAKDOWN} GROUP BY repo, language")
oracle("d2_risk_score", {**FOUND, **counts_ctes("found")}, f"SELECT repo, issues, {SCORE} AS risk_score FROM counts")
oracle("d2_risk_score_with_suggestion", {
    **FILES, **scan_ctes("files", subset("gdpr")), **counts_ctes("hits", "files"), "hint": "SELECT repo, max(file_ord) % 160 - 20.5 AS suggested FROM files GROUP BY repo",
    "scored": f"SELECT *, CAST(greatest({SCORE}, greatest(0, least(100, trunc(suggested)))) AS BIGINT) AS risk_score FROM counts JOIN hint USING (repo)",
}, f"SELECT repo, issues, risk_score, {BAND} AS risk_band, {SENTENCE.format(lit('Analysis'))} AS assessment FROM scored")
oracle("d3_checklist_totals", {**FOUND, **CHECKLIST}, "SELECT framework, section, status, count(*) AS repos, CAST(sum(findings_count) AS BIGINT) AS findings FROM checklist GROUP BY ALL")
oracle("d4_assessment", {**FOUND, **counts_ctes("found")}, f"SELECT repo, critical, high, medium, low, info, {STATIC_SENTENCE} AS assessment FROM counts")
GATED = f"count(*) FILTER ({TOKENS} <= 8000) AS total_files_analyzed, count(*) FILTER ({TOKENS} > 8000) AS total_files_skipped"
oracle("d5_file_counts", FILES, f"SELECT repo, {GATED} FROM files GROUP BY repo")
oracle("d6_framework_summary", {**FOUND, **CHECKLIST}, "SELECT repo, framework, count(*) FILTER (status = 'fail') AS sections_failing, count(*) AS sections_total, "
       "CAST(sum(findings_count) AS BIGINT) AS findings, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'At Risk' ELSE 'No Issues Found' END AS compliance_status "
       "FROM checklist GROUP BY repo, framework")
oracle("d7_file_rollup", KEPT, f"SELECT f.repo, f.path, f.language, {TOKENS} AS token_count, count(k.rule_id) AS issue_count, coalesce(bool_or(severity = 'critical'), false) AS has_critical, "
       "coalesce(bool_or(severity = 'high'), false) AS has_high, coalesce(string_agg(k.rule_id || ':' || k.line, ' ' ORDER BY part_ord, rule_ord, line), '') AS issue_list "
       "FROM files f LEFT JOIN kept k ON k.repo = f.repo AND k.file = f.path GROUP BY f.repo, f.path, f.language, f.content")
oracle("d8_category_facets", {**HITS, **MODEL_ROWS}, "SELECT repo, file, category, count(*) AS issues FROM (SELECT * FROM hits UNION ALL SELECT * FROM model) GROUP BY ALL")
oracle("d9_catalog_usage", HITS, "SELECT scanner, count(*) AS total, count(*) FILTER (rule_type = 'secret') AS disabled, CAST(0 AS BIGINT) AS custom, "
       "CAST(nullif(sum((SELECT count(*) FROM hits h WHERE h.rule_id = rules.rule_id)), 0) AS BIGINT) AS findings FROM rules GROUP BY scanner")
oracle("d10_gate", {**FILES, **scan_ctes("files", subset("gdpr"))}, "SELECT repo, CAST(max(CASE WHEN severity IN ('critical', 'high') THEN 1 ELSE 0 END) AS BIGINT) AS exit_code "
       "FROM (SELECT DISTINCT repo FROM files) LEFT JOIN hits USING (repo) GROUP BY repo")
oracle("d11_cache_statistics", LOOKUP, "SELECT count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome <> 'hit') AS misses, count(*) FILTER (outcome <> 'hit') AS stores, "
       "count(*) FILTER (outcome = 'expired') AS evictions FROM looked")
oracle("d12_risk_bands", {**FILES, **scan_ctes("files", subset("soc2")), **counts_ctes("hits", "files")},
       f"SELECT {BAND} AS risk_band, count(*) AS repos FROM (SELECT {SCORE} AS risk_score FROM counts) GROUP BY 1")
oracle("d13_mark_count", MARKS, "SELECT count(*) AS mark_count FROM marks")
oracle("d2_order_volume", {
    "o": "SELECT CAST(o_custkey AS VARCHAR) AS repo, 'security' AS category, ['critical', 'high', 'medium', 'low', 'info'][CAST(o_orderpriority[1:1] AS INTEGER)] AS severity FROM orders",
    **counts_ctes("o", "o")}, f"SELECT repo, issues, critical, high, risk_score, {BAND} AS risk_band FROM (SELECT *, {SCORE} AS risk_score FROM counts)")

# ---------------------------------------------------------------- order-dependent
oracle("e1_synthetic_ids", {**HITS, **MODEL_ROWS, **MANIFEST_ROWS, "everything": "SELECT * FROM hits UNION ALL SELECT * FROM model UNION ALL SELECT * FROM manifests", **listed_ctes("everything")},
       "SELECT repo, CAST(place AS BIGINT) AS place, file, line, description, sarif_rule_id FROM identified WHERE rule_id IS NULL")
oracle("e2_first_issue_per_rule", {**FOUND, **listed_ctes("found"), **sarif_rule_ctes("true")}, "SELECT repo, sarif_rule_id AS id, file_ord, line FROM used")
oracle("e4_bundle_packing", PACKED, "SELECT repo, path, token_count, in_bundle FROM packed")
oracle("e5_first_mark_wins", MARKS, "SELECT 'again-' || id AS id, repo, file_path, rule_id, description_hash FROM marks")
oracle("e6_latest_responses", LOOKUP, "SELECT key FROM cache ORDER BY expires_at DESC, key LIMIT 100")
oracle("f1_languages_by_files", FILES, "SELECT language, file_count, line_count FROM (SELECT language, " + BREAKDOWN + " GROUP BY language) ORDER BY file_count DESC")
oracle("f2_representatives", {**KEPT, **MODEL_ROWS}, "SELECT repo, severity, category, file, line, description FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY severity, category, "
       "file_ord, part_ord, rule_ord, line) AS n FROM (SELECT * FROM kept UNION ALL SELECT * FROM model) WHERE severity IN ('critical', 'high')) WHERE n <= 25")
oracle("f4_by_severity", KEPT, f"SELECT {HIT}, severity FROM kept ORDER BY repo, {RANK} DESC, file_ord, part_ord, rule_ord, line")
oracle("f5_report_order", FOUND, "SELECT repo, file_ord, part_ord, rule_ord, line, file, rule_id FROM found ORDER BY repo, file_ord, part_ord, rule_ord, line")
oracle("g1_scanner_union", HITS, "SELECT source, count(*) AS findings, count(DISTINCT repo) AS repos FROM hits GROUP BY source")
oracle("g2_report_multiset", {**FOUND, **MODEL_ROWS, **PROJECT, **listed_ctes("found")},
       "SELECT repo, CAST(place AS BIGINT) AS place, count(*) AS issues FROM (SELECT repo, place FROM listed UNION ALL SELECT repo, 3 FROM project) GROUP BY ALL")
oracle("g2_sarif_multiset", {**FOUND, **listed_ctes("found")},
       "SELECT repo, CAST(place AS BIGINT) AS place, count(*) AS issues FROM (SELECT repo, place FROM listed UNION ALL SELECT repo, 1 FROM found WHERE part_ord >= 0) GROUP BY ALL")
oracle("g3_extended_catalog_scan", {**FILES, **scan_ctes("files", subset("pci") + [
    Rule(901, "word-des", "Word", "(?i)des", "info", "the word", "none", "*", "cis", "compliance", "CIS v8 3 words")])}, f"SELECT {HIT} FROM hits")

# ---------------------------------------------------------------- scalar functions
oracle("h1_token_estimates", {}, "SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations")
oracle("h2_line_counts", {}, f"SELECT page_id, max(line) AS lines FROM {lines_of('pages', 'page_id', 'html')} GROUP BY page_id")
oracle("h3_description_hashes", {}, "SELECT item_id, 'sha256:' || sha256(text) AS hash FROM benchmark")
oracle("h4_cache_keys", LOOKUP, "SELECT path, key FROM keyed")
oracle("h5_sarif_levels", HITS, f"SELECT severity, {LEVEL.format('severity')} AS level, count(*) AS n FROM hits GROUP BY ALL")
oracle("h6_slugs", {}, "SELECT item_id, trim(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug FROM benchmark")
oracle("h8_compliance_labels", HITS, "SELECT trim(split_part(compliance_ref, '—', 1)) AS label, count(*) AS n FROM hits GROUP BY 1")
LISTING = {
    **FILES, "listings": "SELECT repo, path, chr(10) || '=== FILE: ' || path || ' (' || language || ') ===' || chr(10) || string_agg(lpad(CAST(line AS VARCHAR), 6, ' ') "
                         f"|| ': ' || text || chr(10), '' ORDER BY line) AS listing FROM {lines_of('files', 'repo, path, language')} GROUP BY repo, path, language",
}
oracle("h9_numbered_listings", LISTING, "SELECT repo, path, length(listing) AS chars, md5(listing) AS digest FROM listings")
oracle("h10_locations", FOUND, "SELECT repo, file || CASE WHEN coalesce(line, 0) <> 0 THEN ':' || line ELSE '' END AS location, lpad(upper(severity), 8, ' ') AS tag, rule_id FROM found")

# ---------------------------------------------------------------- table upkeep
oracle("i2_patched_catalog_scan", HITS, "SELECT rule_id, CASE rule_id WHEN 'pci-004' THEN 'low' WHEN 'cis-020' THEN 'info' ELSE severity END AS severity, count(*) AS n FROM hits "
       "WHERE rule_id <> 'owasp-005' GROUP BY ALL")
oracle("i4_disabled_catalog_scan", {**FILES, **scan_ctes("files", [r for r in RULES if r.id in ("pci-000", "sec-secret-001")])}, f"SELECT {HIT} FROM hits")
def custom(ident: str, pattern: str, severity: str, description: str) -> Rule:
    return Rule(900, ident, "Own", pattern, severity, description, "none", "*", "cis", "compliance", None)


oracle("i1_added_rule_scan", {**FILES, **scan_ctes("files", subset("pci") + [custom("word-des", "(?i)des", "info", "the word")])},
       "SELECT repo, file, line, severity, description FROM hits")
oracle("i3_deleted_rule_scan", {**FILES, **scan_ctes("files", subset("pci") + [custom("word-key", "(?i)key", "low", "the key")])}, f"SELECT {HIT} FROM hits")
oracle("i5_catalog_lint", {"n": "SELECT *, 'n-' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) AS id, doc_id AS k FROM documents"},
       "SELECT id, 'blank name' AS problem FROM n WHERE k % 7 = 3 UNION ALL SELECT id, 'blank pattern' FROM n WHERE k % 4 = 2 "
       "UNION ALL SELECT id, 'blank description' FROM n WHERE k % 11 = 5 UNION ALL SELECT id, 'blank recommendation' FROM n WHERE k % 9 = 1 "
       f"UNION ALL SELECT id, 'unknown severity' FROM n WHERE k % {len(SEVERITIES) + 1} = {len(SEVERITIES)} UNION ALL SELECT id, 'unknown scanner' FROM n WHERE k % 3 = 2 "
       "UNION ALL SELECT id, 'invalid regex' FROM n WHERE k % 4 = 0 UNION ALL SELECT id, 'id is not unique' FROM n GROUP BY id HAVING count(*) > 1")
oracle("i9_cleared_responses", LOOKUP, "SELECT (SELECT count(*) FROM cache) AS entries, CAST(0 AS BIGINT) AS cleared, (SELECT count(DISTINCT key) FROM keyed) AS refilled")
oracle("i9_response_size", LOOKUP, "SELECT count(*) AS entries, count(*) FILTER (expires_at < TIMESTAMP '2024-01-04 00:00:00') AS expired, "
       "count(*) FILTER (expires_at >= TIMESTAMP '2024-01-04 00:00:00') AS left_over FROM cache")
oracle("i9_cleared_marks", HITS, f"SELECT {HIT} FROM hits")
oracle("i6_added_marks", MARKS, "SELECT id, repo, file_path, rule_id, description_hash FROM marks UNION ALL SELECT 'new-' || id, repo, file_path, 'cis-020', description_hash FROM marks WHERE rule_id = 'pci-004'")
oracle("i6_invalid_marks", MARKS, "SELECT id, 'exactly one of rule_id and description_hash must be set' AS problem FROM marks WHERE description_hash IS NOT NULL")
TOXIC = "SELECT 'mark-' || doc_id FROM labels WHERE toxic = 1"
oracle("i7_removed_marks", MARKS, f"SELECT id, repo, file_path FROM marks WHERE id NOT IN ({TOXIC})")
oracle("i7_removal_results", MARKS, "SELECT 'mark-' || doc_id AS id, quality = 0 AS removed FROM labels WHERE toxic = 1")
oracle("i8_mark_list", MARKS, "SELECT id, repo, file_path, rule_id, description_hash, reason, marked_by FROM marks ORDER BY marked_at, id")

# ---------------------------------------------------------------- reports
SARIF = {**FOUND, **listed_ctes("found")}
oracle("j1_sarif_results", SARIF, f"SELECT {SARIF_COLUMNS} FROM identified")
oracle("j8_stored_findings_export", SARIF, f"SELECT {SARIF_COLUMNS} FROM identified")
oracle("j2_sarif_rules", {**SARIF, **sarif_rule_ctes("true")}, "SELECT * FROM described")
REPORT = {
    **FOUND, **counts_ctes("found"), "gated": f"SELECT repo, {GATED} FROM files GROUP BY repo",
    "scored": f"SELECT *, {SCORE} AS risk_score FROM counts JOIN gated USING (repo)",
}
oracle("j5_text_report", {
    **REPORT, **listed_ctes("found"), "shown": "SELECT * FROM listed WHERE severity IN ('critical', 'high')",
    "heads": "SELECT s.repo, total_files_analyzed, (SELECT count(*) FROM shown x WHERE x.repo = s.repo) AS n FROM scored s",
}, "SELECT repo, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS pos, 'scangrove scan: ' || repo || chr(10) || 'files analyzed: ' || total_files_analyzed || '  issues shown: ' || n || chr(10) AS text FROM heads "
   "UNION ALL SELECT repo, 1, 0, 'No findings at or above the selected threshold.' FROM heads WHERE n = 0 UNION ALL SELECT repo, 1, "
   f"row_number() OVER (PARTITION BY repo ORDER BY {ORDER}) - 1, lpad(upper(severity), 8, ' ') || '  ' || description || chr(10) || '  at ' || file || coalesce(':' || line, '') || '  [' || source || ']' || chr(10) "
   "|| coalesce('  rule: ' || rule_id || chr(10), '') || coalesce('  compliance: ' || compliance_ref || chr(10), '') || '  fix: ' || recommendation || chr(10) "
   "|| coalesce('  ```' || chr(10) || '  ' || code_snippet || chr(10) || '  ```' || chr(10), '') FROM shown")
oracle("j6_markdown_report", {
    **REPORT, "langs": f"SELECT repo, language, {BREAKDOWN} GROUP BY repo, language",
}, f"SELECT repo, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS pos, '# Assessment Report' || chr(10) || chr(10) || '**Repository:** `' || repo || '`  ' || chr(10) || '**Risk Score:** ' || risk_score || '/100  ' || chr(10) "
   f"|| '**Generated:** 2024-01-01T00:00:00' || chr(10) || chr(10) || '## Executive Summary' || chr(10) || chr(10) || {STATIC_SENTENCE} || chr(10) || chr(10) || '## Language Breakdown' || chr(10) || chr(10) "
   "|| '| Language | Files | Lines |' || chr(10) || '|----------|-------|-------|' AS text FROM scored "
   f"UNION ALL SELECT repo, 1, row_number() OVER (PARTITION BY repo ORDER BY file_count DESC, first_seen, language) - 1, '| ' || language || ' | ' || file_count || ' | ' || line_count || ' |' FROM langs "
   "UNION ALL SELECT repo, 2, 0, chr(10) || '## Issues' || chr(10) FROM scored "
   f"UNION ALL SELECT repo, 3, row_number() OVER (PARTITION BY repo ORDER BY {RANK} DESC, file_ord, part_ord, rule_ord, line) - 1, '### [' || upper(severity) || '] ' || file || coalesce(':' || line, '') || chr(10) || chr(10) "
   "|| '- **Category:** ' || category || chr(10) || '- **Description:** ' || description || chr(10) || '- **Recommendation:** ' || recommendation || chr(10) FROM found WHERE part_ord >= 0")
oracle("j7_report_rows", {
    **REPORT, **CHECKLIST, "langs": f"SELECT repo, language, {BREAKDOWN} GROUP BY repo, language",
    "lang_list": "SELECT repo, string_agg(language || ':' || file_count || ':' || line_count, ' ' ORDER BY file_count DESC, first_seen) AS languages FROM langs GROUP BY repo",
    "fails": "SELECT repo, count(*) FILTER (status = 'fail') AS sections_failing FROM checklist GROUP BY repo",
}, f"SELECT repo, issues, critical, high, risk_score, {BAND} AS risk_band, total_files_analyzed, total_files_skipped, languages, sections_failing FROM scored JOIN lang_list USING (repo) JOIN fails USING (repo)")

SARIF_DOCUMENT = {
    **SARIF, **sarif_rule_ctes("true"),
    "rule_rows": f"SELECT d.*, row_number() OVER (PARTITION BY d.repo ORDER BY {ORDER}, id) - 1 AS pos FROM described d JOIN used u ON u.repo = d.repo AND u.sarif_rule_id = d.id",
    "result_rows": f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {ORDER}, sarif_rule_id, description) - 1 AS pos FROM identified",
}
oracle("j3_sarif_document", SARIF_DOCUMENT, 'SELECT repo, CAST(1 AS BIGINT) AS section, pos, pos > 0 AS comma, id AS rule_id, level, "full" AS text, short, help, scanner AS source, compliance_ref, '
       "CAST(NULL AS VARCHAR) AS uri, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS VARCHAR) AS snippet FROM rule_rows UNION ALL "
       f"SELECT repo, 3, pos, pos > 0, sarif_rule_id, {LEVEL.format('severity')}, description, NULL, NULL, source, compliance_ref, file, line, CASE WHEN line IS NOT NULL THEN code_snippet END FROM result_rows")


def review_ctes(bundle: bool) -> dict[str, str]:
    """From the files and marks to the findings, answers and file entries of a review."""
    if bundle:
        which = {k: v for k, v in PACKED.items() if k not in HITS}
        model = {
            "model": f"SELECT f.repo, f.file_ord, CAST({MODEL_PART} AS BIGINT) AS part_ord, CAST(0 AS BIGINT) AS rule_ord, {pick(CATEGORIES, 'file_ord')} AS category, "
                     f"{pick(SEVERITIES, 'file_ord')} AS severity, f.path AS file, file_ord % 40 AS line, {NOTE.format('file_ord')} AS description, 'Look at it' AS recommendation, "
                     "CAST(NULL AS VARCHAR) AS code_snippet, 'llm' AS source, CAST(NULL AS VARCHAR) AS rule_id, CAST(NULL AS VARCHAR) AS hipaa_reference, CAST(NULL AS VARCHAR) AS compliance_ref "
                     "FROM files f JOIN chosen USING (repo, path) WHERE file_ord % 6 <> 4",
        }
        answers = "SELECT repo, coalesce(max(CASE WHEN file_ord % 50 = 7 THEN 'Part ' || file_ord || '.' END), '') AS said, max(CASE WHEN file_ord % 50 = 7 THEN file_ord % 130 END) AS suggested FROM files GROUP BY repo"
        project = "SELECT repo, CAST(NULL AS BIGINT) AS file_ord, 'deployment' AS category, 'medium' AS severity, 'project-wide' AS file, CAST(NULL AS BIGINT) AS line, 'Part ' || file_ord AS description, CAST(0 AS BIGINT) AS rule_ord FROM files WHERE file_ord % 50 = 7"
        entries = (f"SELECT p.repo, p.path, file_ord, token_count, analyzed, CASE WHEN NOT analyzed THEN 'File too large (' || token_count || ' tokens)' WHEN NOT in_bundle THEN {lit(EXCLUDED_REASON)} END AS skip_reason, "
                   "CASE WHEN NOT in_bundle THEN '' WHEN coalesce(mine, 0) = 0 THEN 'No AI-detected issues.' WHEN mine = 1 THEN '1 AI-detected issue.' ELSE mine || ' AI-detected issues.' END AS summary, "
                   "coalesce(n, 0) AS issues, coalesce(mine, 0) AS model_issues FROM packed p LEFT JOIN per_file f ON f.repo = p.repo AND f.file = p.path")
    else:
        which = {}
        model = {"every_model": MODEL_ROWS["model"], "model": f"SELECT m.* FROM every_model m JOIN files f ON f.repo = m.repo AND f.path = m.file WHERE {TOKENS} <= 8000"}
        answers = (f"SELECT repo, CASE n % 4 WHEN 0 THEN 'Fair.' WHEN 1 THEN {lit(UNREADABLE['project'])} WHEN 2 THEN '' ELSE 'Weak.' END AS said, "
                   "CASE n % 4 WHEN 0 THEN n % 130 WHEN 1 THEN 50 END AS suggested FROM (SELECT repo, count(*) AS n FROM files GROUP BY repo)")
        project = ("SELECT repo, CAST(NULL AS BIGINT) AS file_ord, category, severity, file, CAST(line AS BIGINT) AS line, description, CAST(rule_ord AS BIGINT) AS rule_ord FROM (SELECT repo FROM files GROUP BY repo HAVING count(*) % 4 = 0), "
                   "(VALUES ('deployment', 'high', 'project-wide', NULL, 'No tests', 0), ('bug', 'low', 'README.md', 3, 'Old', 1)) v(category, severity, file, line, description, rule_ord)")
        entries = (f"SELECT f.repo, f.path, file_ord, {TOKENS} AS token_count, {TOKENS} <= 8000 AS analyzed, CASE WHEN {TOKENS} > 8000 THEN 'File too large (' || {TOKENS} || ' estimated tokens > 8000 limit)' END AS skip_reason, "
                   f"CASE WHEN {TOKENS} > 8000 THEN '' ELSE CASE file_ord % 6 WHEN 3 THEN {lit(UNREADABLE['file'])} WHEN 5 THEN '' ELSE 'Read.' END END AS summary, "
                   "coalesce(n, 0) AS issues, coalesce(mine, 0) AS model_issues FROM files f LEFT JOIN per_file p ON p.repo = f.repo AND p.file = f.path")
    return {
        **KEPT, **which, **model, "kept_model": KEPT_MODEL["kept_model"], **MANIFEST_ROWS,
        "found": "SELECT * FROM kept UNION ALL SELECT * FROM kept_model UNION ALL SELECT * FROM manifests WHERE repo IN (SELECT repo FROM files)",
        "repos": "SELECT DISTINCT repo FROM files", "answers": answers, "project": project,
        "per_file": f"SELECT repo, file, count(*) AS n, count(*) FILTER (part_ord = {MODEL_PART}) AS mine FROM found WHERE part_ord >= 0 GROUP BY ALL",
        "entries": entries, **counts_ctes("found"), **CHECKLIST,
        "reports": f"SELECT c.*, CAST(greatest({SCORE}, coalesce(greatest(0, least(100, suggested)), 0)) AS BIGINT) AS risk_score, "
                   f"coalesce(nullif(said, ''), {SENTENCE.format(lit('Analysis'))}) AS assessment FROM counts c JOIN answers USING (repo)",
    }


for _mode, _bundle in (("per_file", False), ("bundle", True)):
    oracle(f"j7_{_mode}_entries", review_ctes(_bundle), "SELECT repo, path, token_count, analyzed, skip_reason, summary, issues, model_issues FROM entries")
    oracle(f"j7_{_mode}_report", {
        **review_ctes(_bundle), "gated": "SELECT repo, count(*) FILTER (analyzed) AS total_files_analyzed, count(*) FILTER (NOT analyzed) AS total_files_skipped FROM entries GROUP BY repo",
        "line_counts": f"SELECT repo, count(line) AS lines FROM {lines_of('files', 'repo, file_ord')} GROUP BY repo",
    }, f"SELECT r.repo, issues, critical, high, risk_score, {BAND} AS risk_band, assessment, total_files_analyzed, total_files_skipped, (SELECT count(*) FROM project p WHERE p.repo = r.repo) AS project_issues, "
       "(SELECT count(*) FROM checklist k WHERE k.repo = r.repo AND status = 'fail') AS sections_failing, lines, "
       f"{lit(_mode)} AS analysis_mode FROM reports r JOIN gated USING (repo) JOIN line_counts USING (repo)")
_SHOWN = "severity IN ('critical', 'high')"
oracle("j4_json_report", {
    **review_ctes(False),
    "pieces": "SELECT repo, file_ord, path AS file, 0 AS kind, -1 AS part_ord, -1 AS rule_ord, -1 AS line_no, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS rule_id, summary AS text, token_count AS number, skip_reason FROM entries "
              f"UNION ALL SELECT repo, file_ord, file, 1, part_ord, rule_ord, line, line, severity, rule_id, description, NULL, NULL FROM found WHERE part_ord >= 0 AND {_SHOWN} "
              "UNION ALL SELECT repo, file_ord, path, 2, -1, -1, -1, NULL, NULL, NULL, NULL, NULL, NULL FROM entries",
    "placed": "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_ord, file, kind, part_ord, rule_ord, line_no, rule_id, text) - 1 AS pos, "
              "row_number() OVER (PARTITION BY repo, file_ord, file, kind ORDER BY part_ord, rule_ord, line_no, rule_id, text) - 1 AS inner_pos FROM pieces",
    "secure": f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_ord, part_ord, rule_ord, line, file) - 1 AS pos FROM found WHERE category = 'security' AND {_SHOWN}",
    "lifted": f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rule_ord) - 1 AS pos FROM project WHERE {_SHOWN}",
}, "SELECT repo, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS pos, false AS comma, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS rule_id, assessment AS text, risk_score AS number, CAST(NULL AS VARCHAR) AS skip_reason FROM reports "
   "UNION ALL SELECT repo, 1, pos, CASE WHEN kind = 0 THEN pos > 0 ELSE inner_pos > 0 END, file, line, severity, rule_id, text, number, skip_reason FROM placed WHERE kind < 2 "
   "UNION ALL SELECT repo, 3, pos, pos > 0, file, line, severity, NULL, description, NULL, NULL FROM lifted "
   "UNION ALL SELECT repo, 5, pos, pos > 0, file, line, severity, rule_id, description, NULL, NULL FROM secure")

# ---------------------------------------------------------------- imports and context
_G = "(doc_id // 10)"
_commented = "'{0}' || regexp_replace(text, '\\r\\n|\\r|\\n', chr(10) || '{0}', 'g') || chr(10)"
MODULES = {
    "modules": f"SELECT doc_id AS file_ord, doc_id // 10 AS g, CASE WHEN doc_id % 10 >= 7 THEN 'web/m' || doc_id || '.js' WHEN doc_id % 10 = 0 THEN 'pkg' || {_G} || '/__init__.py' "
               f"ELSE 'pkg' || {_G} || '/m' || doc_id || '.py' END AS path, doc_id % 10 >= 7 AS script, CASE WHEN doc_id % 10 >= 7 THEN "
               f"'import x from ''./m' || ({_G} * 10 + 7) || '''' || chr(10) || 'const y = require(''../web/m' || ({_G} * 10 + 8) || '.js'')' || chr(10) || 'import ''react''' || chr(10) "
               f"|| 'const z = import(''/web/m' || ({_G} * 10 + 19) || ''')' || chr(10) || {_commented.format('// ')} "
               f"ELSE CASE WHEN doc_id % 10 = 6 THEN 'def (:' || chr(10) ELSE '' END || 'import os, pkg' || {_G} || chr(10) || 'from .m' || ({_G} * 10 + 1) || ' import a' || chr(10) || 'from . import m' || ({_G} * 10 + 2) "
               f"|| chr(10) || 'from pkg' || ({_G} + 1) || '.m' || ({_G} * 10 + 13) || ' import b' || chr(10) || 'import numpy' || chr(10) || 'from ..pkg' || {_G} || ' import c' || chr(10) "
               f"|| {_commented.format('# ')} END AS content FROM documents",
    "edges": "SELECT path, script, file_ord, unnest(specs) AS spec, generate_subscripts(specs, 1) - 1 AS spec_ord, unnest(targets) AS wanted FROM (SELECT *, CASE WHEN script THEN "
             "['./m' || (g * 10 + 7), '../web/m' || (g * 10 + 8) || '.js', '/web/m' || (g * 10 + 19)] ELSE "
             "['pkg' || g, '.m' || (g * 10 + 1), '.m' || (g * 10 + 2), 'pkg' || (g + 1) || '.m' || (g * 10 + 13), '..pkg' || g] END AS specs, CASE WHEN script THEN "
             "['web/m' || (g * 10 + 7) || '.js', 'web/m' || (g * 10 + 8) || '.js', 'web/m' || (g * 10 + 19) || '.js'] ELSE "
             "['pkg' || g || '/__init__.py', 'pkg' || g || '/m' || (g * 10 + 1) || '.py', 'pkg' || g || '/m' || (g * 10 + 2) || '.py', 'pkg' || (g + 1) || '/m' || (g * 10 + 13) || '.py', "
             "'pkg' || g || '/__init__.py'] END AS targets FROM modules WHERE script OR file_ord % 10 <> 6)",
    "resolved": "SELECT e.*, m.path AS target_path FROM edges e LEFT JOIN modules m ON m.path = e.wanted",
}
oracle("e3_distinct_imports", MODULES, "SELECT path, spec_ord, spec FROM edges")
oracle("k1_python_imports", MODULES, "SELECT path, spec_ord, spec FROM edges WHERE NOT script")
oracle("k2_script_imports", MODULES, "SELECT path, spec_ord, spec FROM edges WHERE script")
oracle("k3_language_dispatch", MODULES, "SELECT language, sum(n)::BIGINT AS imports FROM (SELECT CASE file_ord % 3 WHEN 1 THEN CASE WHEN script THEN 'JAVASCRIPT' ELSE 'PYTHON' END ELSE 'ts' END AS language, "
       "CASE WHEN file_ord % 3 = 1 THEN (SELECT count(*) FROM edges e WHERE e.path = m.path) ELSE CASE WHEN script THEN 3 ELSE 0 END END AS n FROM modules m WHERE file_ord % 3 > 0) GROUP BY 1")
oracle("k4_python_targets", MODULES, "SELECT path, spec, target_path FROM resolved WHERE NOT script")
oracle("k5_script_targets", MODULES, "SELECT path, spec, target_path FROM resolved WHERE script")
oracle("c8_import_resolution", MODULES, "SELECT CASE WHEN script THEN 'JavaScript' ELSE 'Python' END AS language, target_path IS NOT NULL AS found, count(*) AS n FROM resolved GROUP BY ALL")


def excerpt(lines: int, path: str = "path") -> str:
    parts = "string_split(regexp_replace(content, '\\n$', ''), chr(10))"
    name = f"regexp_extract({path}, '[^/]*$')"
    return (f"CASE WHEN len({parts}) > {lines} THEN array_to_string({parts}[1:{lines}], chr(10)) || chr(10) || '... [truncated at {lines} of ' || {name} || ']' "
            f"ELSE array_to_string({parts}, chr(10)) END")


oracle("k6_excerpts", MODULES, f"SELECT path, md5({excerpt(5)}) AS digest FROM modules")
_START = -(-len(HEADER) // 4) + 8
CONTEXTS = {
    **MODULES,
    "texts": f"SELECT path AS target_path, {excerpt(100)} AS long, {excerpt(30)} AS short FROM modules",
    "firsts": "SELECT *, row_number() OVER (PARTITION BY path ORDER BY spec_ord) AS k FROM (SELECT *, row_number() OVER (PARTITION BY path, target_path ORDER BY spec_ord) AS again FROM resolved "
              "WHERE target_path IS NOT NULL) WHERE again = 1",
    "pieces": "SELECT path, k, '### `' || spec || '` (from `' || regexp_extract(target_path, '[^/]*$') || '`)' || chr(10) || chr(10) || '```' || chr(10) AS head, long, short, "
              "chr(10) || '```' || chr(10) || chr(10) AS tail FROM firsts JOIN texts USING (target_path)",
    "walk": f"SELECT path, CAST(0 AS BIGINT) AS k, CAST({_START} AS BIGINT) AS used, CAST('' AS VARCHAR) AS body FROM modules UNION ALL "
            "SELECT w.path, p.k, CASE WHEN used + ceil(length(head || long || tail) / 4.0) <= 1500 THEN CAST(used + ceil(length(head || long || tail) / 4.0) AS BIGINT) "
            "WHEN used + ceil(length(head || short || tail) / 4.0) <= 1500 THEN CAST(used + ceil(length(head || short || tail) / 4.0) AS BIGINT) ELSE used END, "
            "CASE WHEN used + ceil(length(head || long || tail) / 4.0) <= 1500 THEN body || head || long || tail "
            "WHEN used + ceil(length(head || short || tail) / 4.0) <= 1500 THEN body || head || short || tail ELSE body END "
            "FROM walk w JOIN pieces p ON p.path = w.path AND p.k = w.k + 1",
    "ends": f"SELECT path, CASE WHEN body = '' THEN '' ELSE {lit(HEADER)} || body END AS context FROM walk QUALIFY row_number() OVER (PARTITION BY path ORDER BY k DESC) = 1",
}
oracle("k7_context_blocks", CONTEXTS, "SELECT path, length(context) AS chars, md5(context) AS digest FROM ends")
oracle("k8_degrees", {**MODULES, "pairs": "SELECT DISTINCT path, target_path FROM resolved WHERE target_path IS NOT NULL"},
       "SELECT 'mono' AS repo, path, (SELECT count(*) FROM pairs p WHERE p.path = m.path) AS out_degree, (SELECT count(*) FROM pairs p WHERE p.target_path = m.path) AS in_degree FROM modules m")
oracle("k8_unresolved", MODULES, "SELECT 'mono' AS repo, spec, count(*) AS importers FROM resolved WHERE target_path IS NULL GROUP BY spec")

# ---------------------------------------------------------------- prompts and responses
_PROMPT = "'File: ' || path || chr(10) || 'Language: ' || language || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```'"
oracle("l2_file_prompts", FILES, f"SELECT repo, path, length({_PROMPT}) AS chars, md5({_PROMPT}) AS digest FROM files WHERE {TOKENS} <= 8000")
_WITH_CONTEXT = _PROMPT.replace("language", "CASE WHEN script THEN 'JavaScript' ELSE 'Python' END") + " || CASE WHEN context = '' THEN '' ELSE chr(10) || context END"
oracle("l2_context_prompts", CONTEXTS, f"SELECT path, length({_WITH_CONTEXT}) AS chars, md5({_WITH_CONTEXT}) AS digest FROM ends JOIN modules USING (path) WHERE {TOKENS} <= 2000")
oracle("l3_bundle_prompts", {
    **PACKED, "listings": LISTING["listings"],
    "bundles": "SELECT repo, count(*) AS bundle_files, 'Analyze the following codebase:' || chr(10) || string_agg(listing, '' ORDER BY late, token_count, file_ord) AS t "
               "FROM packed JOIN listings USING (repo, path) WHERE in_bundle GROUP BY repo",
}, "SELECT repo, bundle_files, length(t) AS chars, md5(t) AS digest FROM bundles")
READ = f"CASE file_ord % 6 WHEN 3 THEN {lit(UNREADABLE['file'])} WHEN 5 THEN '' ELSE 'Read.' END"
oracle("l4_project_prompts", {
    **KEPT,
    "sums": f"SELECT repo, path, language, file_ord, {READ} AS summary, (SELECT count(*) FROM kept k WHERE k.repo = f.repo AND k.file = f.path) AS n FROM files f WHERE {TOKENS} <= 8000",
    "part1": "SELECT repo, string_agg('### ' || path || ' (' || language || ')' || chr(10) || 'Summary: ' || summary || chr(10) || 'Issues found: ' || n || chr(10) || chr(10), '' ORDER BY file_ord) AS t "
             "FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_ord) AS k FROM sums) WHERE k <= 30 GROUP BY repo",
    "tops": "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY severity, category, file_ord, part_ord, rule_ord, line) AS k FROM kept WHERE severity IN ('critical', 'high')",
    "part2": "SELECT repo, string_agg('- [' || upper(severity) || '] ' || category || ': ' || substring(description, 1, 100) || chr(10), '' ORDER BY k) AS t FROM tops WHERE k <= 20 GROUP BY repo",
    "whole": "SELECT p.repo, '## File Summaries' || chr(10) || chr(10) || p.t || coalesce(chr(10) || '## Notable Issues' || chr(10) || chr(10) || q.t, '') || chr(10) || chr(10) || "
             "'Provide your project-level assessment.' AS t FROM part1 p LEFT JOIN part2 q ON q.repo = p.repo",
}, "SELECT repo, length(t) AS chars, md5(t) AS digest FROM whole")
oracle("l5_work_table", LOOKUP, "SELECT key, user_prompt FROM looked WHERE outcome <> 'hit'")
oracle("l5_spread_responses", LOOKUP, "SELECT repo, path, key, response FROM keyed JOIN answered USING (key)")
oracle("l6_parsed_responses", FILES, f"SELECT repo, path, file_ord % 6 <> 3 AS readable, {READ} AS summary, CAST(CASE file_ord % 6 WHEN 3 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS BIGINT) AS issues FROM files")
oracle("h11_extracted_json", FILES, "SELECT file_ord % 6 <> 3 AS found, file_ord % 6 AS form, count(*) AS n FROM files GROUP BY ALL")
oracle("l7_review_summaries", {**PACKED, **MODEL_ROWS, **KEPT_MODEL},
       "SELECT p.repo, p.path, CASE count(m.file) WHEN 0 THEN 'No AI-detected issues.' WHEN 1 THEN '1 AI-detected issue.' ELSE count(m.file) || ' AI-detected issues.' END AS summary "
       "FROM packed p LEFT JOIN kept_model m ON m.repo = p.repo AND m.file = p.path WHERE in_bundle GROUP BY p.repo, p.path")
oracle("l8_excluded_from_bundle", PACKED, f"SELECT repo, path, analyzed, in_bundle, CASE WHEN NOT analyzed THEN 'File too large (' || token_count || ' tokens)' WHEN NOT in_bundle THEN {lit(EXCLUDED_REASON)} END AS skip_reason FROM packed")

# ---------------------------------------------------------------- streams
oracle("n1_stream_scan", DOC_HITS, f"SELECT {HIT} FROM hits")
oracle("n2_stream_suppression", {**DOC_HITS, **MARKS}, f"SELECT {HIT} FROM hits h WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.id = 'mark-' || h.file AND m.rule_id = h.rule_id)")
oracle("n3_stream_counters", DOC_HITS, "SELECT repo, severity, count(*) AS findings FROM hits GROUP BY ALL")
oracle("n3_stream_progress", DOC_HITS, "SELECT repo, count(*) AS files_known, count(*) AS files_scanned, "
       + ", ".join(f"(SELECT count(*) FROM hits h WHERE h.repo = d.repo AND severity = {lit(s)}) AS {s}" for s in SEVERITIES) + " FROM docs d GROUP BY repo")
oracle("n4_stream_unchanged", {}, "SELECT path, content FROM (SELECT CAST(user_id AS VARCHAR) AS path, event_type AS content, "
       "lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, sha256(event_type)) AS last FROM events) WHERE last IS DISTINCT FROM content")
