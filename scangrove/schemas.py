"""Table contracts."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

FILES = _struct(
    ("repo", _S), ("file_ord", _L), ("path", _S), ("language", _S), ("size_bytes", _L), ("content", _S),
)

RULES = _struct(
    ("rule_ord", _L), ("id", _S), ("name", _S), ("pattern", _S), ("severity", _S), ("description", _S),
    ("recommendation", _S), ("language", _S), ("scanner", _S), ("rule_type", _S), ("compliance_ref", _S),
    ("enabled", _B), ("builtin", _B),
)

# A finding carries its place in the report as (file_ord, part_ord, rule_ord, line):
# no operator ever needs a global sort to know the order.
FINDINGS = _struct(
    ("repo", _S), ("file_ord", _L), ("part_ord", _I), ("rule_ord", _L),
    ("category", _S), ("severity", _S), ("file", _S), ("line", _I), ("description", _S),
    ("recommendation", _S), ("code_snippet", _S), ("source", _S), ("rule_id", _S),
    ("hipaa_reference", _S), ("compliance_ref", _S),
)
REPORT_ORDER = ["file_ord", "part_ord", "rule_ord", "line"]

MARKS = _struct(
    ("id", _S), ("repo", _S), ("file_path", _S), ("rule_id", _S), ("description_hash", _S),
    ("reason", _S), ("marked_at", T.TimestampType()), ("marked_by", _S),
)

RESPONSES = _struct(("key", _S), ("expires_at", T.TimestampType()), ("response", _S))
