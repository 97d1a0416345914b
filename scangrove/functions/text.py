"""Column functions on text: line splitting, stripping, size estimates, labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import SARIF_LEVEL, by_severity

# Line terminators and white space as Unicode text handling in
# Python defines them.  CR LF counts as one terminator.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
COMMENT_START = "\\A(?:#|//|\\*|<!--)"
SNIPPET_CHARS = 150
CHARS_PER_TOKEN = 4


def split_lines(text: Column) -> Column:
    """Lines of a text; a trailing terminator adds no empty line (B1).

    Most texts have newlines as only terminators, and are cut there without a regex.
    """
    rare = reduce(or_, [text.contains(c) for c in RARE_BREAKS])
    parts = F.when(rare, F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_lines(text: Column) -> Column:
    """Number of lines without building them twice (H2)."""
    breaks = F.regexp_count(text, F.lit(LINE_BREAK))
    ends_open = (text != "") & ~F.substring(text, -1, 1).rlike(LINE_BREAK)
    return (breaks + ends_open.cast("int")).cast("bigint")


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def is_comment(line: Column) -> Column:
    """Whether a line reads as a comment (B2a, B2b: the prefixes have no letters, so case is irrelevant)."""
    return F.substring(F.ltrim(line, F.lit(WHITESPACE)), 1, 4).rlike(COMMENT_START)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("bigint")


def description_hash(description: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(description, 256))


def slug(name: Column) -> Column:
    """Runs of other characters become one underscore, none at the ends (H6)."""
    joined = F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.when(joined == "", "Rule").otherwise(joined)


def sarif_level(severity: Column) -> Column:
    return by_severity(severity, SARIF_LEVEL, "warning")


def compliance_label(reference: Column) -> Column:
    """The short form of a reference: what stands before the dash; from the section sign on if it names HIPAA (H8)."""
    head = F.substring_index(reference, "—", 1)
    section = F.concat(F.lit("HIPAA "), strip(F.regexp_replace(head, "(?s)^.*§", "§")))
    return F.when(F.upper(reference).contains("HIPAA"), section).otherwise(strip(head))


def location(file: Column, line: Column) -> Column:
    """``file:line``, or only the file where there is no line."""
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(file, F.lit(":"), line.cast("string"))).otherwise(file)


def severity_tag(severity: Column) -> Column:
    return F.lpad(F.upper(severity), 8, " ")


def numbered_listing(path: Column, language: Column, content: Column) -> Column:
    """A file with a header and right-aligned line numbers, as put into a prompt (H9)."""
    lines = F.transform(
        split_lines(content),
        lambda line, i: F.concat(F.lpad((i + 1).cast("string"), F.greatest(F.length((i + 1).cast("string")), F.lit(6)), F.lit(" ")),
                                 F.lit(": "), line, F.lit("\n")),
    )
    return F.concat(
        F.lit("\n=== FILE: "), path, F.lit(" ("), language, F.lit(") ===\n"), F.array_join(lines, ""),
    )
