"""The same results in DuckDB SQL, for the queries that SQL can express."""

WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(c.low, s.doc_id), s.doc_id) AS component_id,
  s.doc_id = coalesce(least(c.low, s.doc_id), s.doc_id) AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id
"""


def _personal_data() -> str:
    """Matches and the pieces between them alternate, so that their lengths give the places."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({digits}[-i] AS INT) "
            f"WHEN CAST({digits}[-i] AS INT) > 4 THEN 2 * CAST({digits}[-i] AS INT) - 9 ELSE 2 * CAST({digits}[-i] AS INT) END)) % 10 = 0")
    code = "replace(m, ' ', '')"
    checks = {
        "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split({code}[5:] || {code}[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)), "
                "lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
    }
    words = {
        "email": "mail|contact|kontakt|correo|courriel", "ip": r"\bip\b|address|host|server|adresse", "card": "card|visa|credit|karte|tarjeta|carte",
        "phone": "phone|call|tel|mobile|anruf|llam|appel", "iban": "iban|account|konto|cuenta|compte",
    }
    start = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
    parts = "\nUNION ALL\n".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + length(m) AS e, CASE WHEN regexp_matches(lower(substr(t, greatest(s - 40, 0) + 1, least(s, 40))), '{words[kind]}') THEN {start[kind]} + 0.1 ELSE {start[kind]} END AS score "
        f"FROM (SELECT doc_id, t, ms[i] AS m, i, CAST(list_sum(list_transform(range(1, i + 1), lambda j: length(ps[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(ms[j]))), 0) AS BIGINT) AS s "
        f"FROM (SELECT doc_id, t, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{p}') AS ms, "
        f"string_split_regex(coalesce(text, ''), '{p}') AS ps FROM documents) WHERE len(ms) > 0)) WHERE {checks[kind]}"
        for k, (kind, p) in enumerate(patterns.items())
    )
    span = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in patterns)
    return f"""
WITH x AS ({parts})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY k, s) FILTER (kind <> 'iban'), '')) AS base_sha256,
  coalesce(string_agg({span}, ',' ORDER BY k, s), '') AS spans, CAST(round(max(score), 2) AS DOUBLE) AS top_score
FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id
"""


PERSONAL_DATA = _personal_data()


def lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


TERMS = rf"regexp_extract_all({lowered("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

LINE_DEDUP = rf"""
WITH l AS (
  SELECT r, doc_id, i, line, {lowered(r"trim(line, e' \t\n\x0b\x0c\r')")} AS key
  FROM (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
m AS (SELECT l.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM l LEFT JOIN shared ON l.key = shared.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def _manifest() -> str:
    def part(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text} END"

    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    octets = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))"
    # crc32, a byte at a time, with its table made on the spot.
    table = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

    def levels(name: str, leaves: str) -> str:
        """All nodes of some trees: g, level, place, node, and the number of nodes of the level."""
        return f"""{name} AS (
  SELECT g, 0 AS level, place, node, n FROM {leaves}
  UNION ALL SELECT g, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, level, place // 8, n),
{name}_siblings AS (
  SELECT a.g, a.level, a.place, a.n, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lower,
    coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS upper
  FROM {name} a JOIN {name} b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.n > 1 GROUP BY a.g, a.level, a.place, a.n)"""

    def climb(name: str, start: str, tree: str) -> str:
        """From every row of ``start`` (r, g, place, node, proof) up to the top of its tree."""
        return f"""{name} AS (
  SELECT r, g, 0 AS level, place, node, proof FROM {start}
  UNION ALL SELECT r, c.g, c.level + 1, c.place // 8, sha256(lower || node || upper), proof || lower || upper
  FROM {name} c JOIN {tree}_siblings s ON c.g IS NOT DISTINCT FROM s.g AND c.level = s.level AND c.place = s.place)"""

    return f"""
WITH RECURSIVE h AS (
  SELECT row_number() OVER () AS r, doc_id, lang AS g, sha256({head} || {part("text")}) AS leaf,
    CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {part(lowered("text"))}) ELSE sha256({head} || {part("text")}) END AS shown
  FROM documents, {table}),
leaves AS (SELECT r, doc_id, g, row_number() OVER w - 1 AS place, leaf AS node, shown, count(*) OVER (PARTITION BY g) AS n FROM h WINDOW w AS (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf)),
{levels("tree", "leaves")},
tops AS (SELECT 'all' AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS place, node, count(*) OVER () AS n, g AS lang FROM tree WHERE n = 1),
{levels("roof", "tops")},
begin AS (SELECT r, g, place, shown AS node, '' AS proof FROM leaves),
{climb("up", "begin", "tree")},
middle AS (SELECT u.r, 'all' AS g, t.place, u.node, u.proof, t.node AS subroot FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS k FROM up) u JOIN tops t ON u.g IS NOT DISTINCT FROM t.lang WHERE k = 1),
{climb("over", "middle", "roof")},
finish AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS k FROM over) WHERE k = 1)
SELECT l.doc_id, l.node AS leaf, m.subroot, root.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = root.node AS verified
FROM leaves l JOIN middle m USING (r) JOIN finish f USING (r), (SELECT node FROM roof WHERE n = 1) root
"""


MANIFEST = _manifest()
