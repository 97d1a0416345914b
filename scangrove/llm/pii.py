"""Personal data in texts: regular expressions propose spans, checks confirm them, words nearby adjust their score.

Kinds: email, ip (parts up to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits) and iban (mod-97).  Matches of a kind
are leftmost and do not overlap; those that fail their check are dropped.  An iban has the length that its country code fixes and is
tried at every place where one can begin, so that neither what stands before nor what stands after it hides it; codes without a fixed
length take the longest run of up to 34 signs.  A span's score starts from its kind's and rises if one of the
kind's words stands within ``NEAR`` characters before it.  Only DataFrame operations, row by row, without a shuffle.

The text between matches and the matches themselves alternate, so their lengths give the places of all matches in one pass; sums run
over pieces of ``STRIDE`` matches, so that texts with very many matches stay cheap.  Expressions are written so that no start is tried twice
within a run of the same characters, and loops don't nest on the stack; but for iban they match what the plain forms match.

Null and empty texts have no spans and an empty masked text.  Nulls in other columns are carried along; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
#: Signs of an account number by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """A sign where an account number can begin, with the whole number as group 1."""
    fixed = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    known = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    return rf"\b(?=((?:{'|'.join(fixed)}|(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})\b))[A-Z]"


PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": _iban(),
}
#: A text without this holds no match of the kind.
SIGNS = {"email": "@", "phone": "+"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel", "ip": r"\bip\b|address|host|server|adresse", "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|anruf|llam|appel", "iban": "iban|account|konto|cuenta|compte",
}
NEAR, BONUS = 40, 0.1
STRIDE = 128


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod_97(code: Column) -> Column:
    """Whether an account number's check digits hold: letters count from 10, the first four signs go last, the remainder is 1."""
    turned = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))

    def add(rest: Column, sign: Column) -> Column:
        value = F.when(sign.between("0", "9"), sign.cast("int")).otherwise(F.ascii(sign) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, s: F.when(s == "", rest).otherwise(add(rest, s))) == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(match, r"\."), lambda p: small(p) & (F.when(small(p), F.concat(F.lit("0"), F.ltrim(p, F.lit("0")))).otherwise("999").cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod_97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def _matches(kind: str, text: Column) -> tuple[Column, Column]:
    """The matches of a kind, and the pieces of text between them; between the first signs of matches for iban, which may overlap."""
    none, pattern = F.array().cast("array<string>"), F.lit(PATTERNS[kind])
    possible = F.contains(text, F.lit(SIGNS[kind])) if kind in SIGNS else text.rlike("[0-9]")
    return F.when(possible, F.regexp_extract_all(text, pattern, F.lit(int(kind == "iban")))).otherwise(none), F.when(possible, F.split(text, PATTERNS[kind])).otherwise(none)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _span(kind: str, body: Column):
    """Makes the span of a match from its number, in a row prepared by ``with_spans``."""
    p, steps, chunks = (F.col(f"_{kind}.{x}") for x in ("p", "steps", "chunks"))

    def span(match: Column, i: Column) -> Column:
        whole = F.floor(i / STRIDE).cast("int")
        before = _total(F.slice(chunks, F.lit(1), whole)) + _total(F.slice(steps, whole * STRIDE + 1, i - whole * STRIDE))
        start = before + F.length(p[i])
        near = F.lower(F.substring(body, F.greatest(start - NEAR, F.lit(0)).cast("int") + 1, F.least(start, F.lit(NEAR)).cast("int")))
        score = F.when(near.rlike(WORDS[kind]), SCORES[kind] + BONUS).otherwise(SCORES[kind])
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), F.round(score, 2).alias("score"), valid(kind, match).alias("valid"))

    return span


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` and a column of spans: kind, start, end (code points, end exclusive) and score, by kind and start."""
    body, work = F.coalesce(F.col(f"`{text}`"), F.lit("")), docs
    found = {}
    for kind in KINDS:
        matches, pieces = _matches(kind, body)
        work = work.withColumn(f"_{kind}", F.struct(matches.alias("m"), pieces.alias("p")))
    for kind in KINDS:
        m, p = F.col(f"_{kind}.m"), F.col(f"_{kind}.p")
        # Lengths of a piece with the match after it; their sums, by stride, lead to the next piece.
        size = (lambda match: F.lit(1)) if kind == "iban" else F.length
        steps = F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda a, b: (F.length(a) + size(b)).cast("long"))
        work = work.withColumn(f"_{kind}", F.when(F.size(m) > 0, F.struct(m.alias("m"), p.alias("p"), steps.alias("steps"))))
    for kind in KINDS:
        steps = F.col(f"_{kind}.steps")
        chunks = F.transform(F.sequence(F.lit(0), (F.size(steps) - 1).cast("int"), F.lit(STRIDE)), lambda i: _total(F.slice(steps, i + 1, F.lit(STRIDE))))
        work = work.withColumn(f"_{kind}", F.when(F.col(f"_{kind}").isNotNull(), F.col(f"_{kind}").withField("chunks", chunks)))
    for kind in KINDS:
        spans = F.filter(F.transform(F.col(f"_{kind}.m"), _span(kind, body)), lambda s: s["valid"])
        found[kind] = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
        empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
        work = work.withColumn(f"_{kind}", F.when(F.col(f"_{kind}").isNotNull(), found[kind]).otherwise(empty))
    return work.withColumn(name, F.concat(*(F.col(f"_{kind}") for kind in KINDS))).drop(*(f"_{kind}" for kind in KINDS))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; where spans overlap, by that of the first, longest one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(
            s["start"] >= state["at"], F.struct(F.concat(state["parts"], F.array(piece)).alias("parts"), (-s["back"]).alias("at")),
        ).otherwise(F.struct(state["parts"].alias("parts"), F.greatest(state["at"], -s["back"]).alias("at")))

    end = lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, end))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans and the highest score, of every document."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long"), "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = listed(F.filter("spans", lambda s: s["kind"] != "iban"))
    return rows.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_max(F.col("spans.score")).alias("top_score"),
    )


def without_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts; n_chars, where there is such a column, is that of the masked text.  Other columns may have any name."""
    rows = with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"))
    rows = rows.select("row", F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col("spans"))).alias("text"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.coalesce(F.length("text").cast(docs.schema[name].dataType), F.col("row.n_chars")).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return rows.select(*(column(c) for c in docs.columns))
