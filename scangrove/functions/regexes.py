"""Rule patterns for the JVM.

Rules are written in Python's regex dialect.  ``jvm_pattern`` gives the same
meaning to a pattern under ``java.util.regex``.  ``required_literals`` finds
short texts of which one must occur wherever the pattern matches, so that the
expensive regexes run only on files where they have a chance.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "\\p{L}\\p{N}_"
_SPACE = "\\s\\x1c-\\x1f"
_EDGE = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_OUTSIDE = {
    "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "w": f"[{_WORD}]", "W": f"[^{_WORD}]", "b": _EDGE,
    "Z": "\\z",
}
_INSIDE = {"s": _SPACE, "w": _WORD, "b": "\\x08"}


@lru_cache(maxsize=10_000)
def jvm_pattern(pattern: str, multiline: bool = False) -> str:
    """The pattern with Unicode classes, ``\\n`` as only line end, and Python's idea of word and space."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            esc = pattern[i + 1]
            out.append((_INSIDE if in_class else _OUTSIDE).get(esc, ch + esc))
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch in "[&":  # nested classes and intersections exist only in Java
                ch = "\\" + ch
        elif ch == "[":
            in_class = True
            head = re.match(r"\[\^?\]?", pattern[i:]).group()
            out.append(head[:-1] + "\\]" if head.endswith("]") else head)
            i += len(head)
            continue
        out.append(ch)
        i += 1
    flags = re.match(r"(\(\?[a-z]+\))?", pattern).group()
    body = "".join(out)[len(flags):]
    heads = _first_chars(parser.parse(pattern))
    if heads is not None and body.startswith(_EDGE):
        # A match starts with a word character: test that first, it is cheap and mostly fails.
        body = f"(?=[{heads}])(?<![{_WORD}])" + body[len(_EDGE):]
    return ("(?Umsd)" if multiline else "(?Ud)") + flags + body


def _first_chars(nodes) -> str | None:
    """The ASCII word characters a match can start with, as the inside of a class; None if it may start otherwise."""
    for kind, arg in nodes:
        if kind is op.LITERAL and arg < 128 and chr(arg).isalnum():
            return chr(arg)
        if kind is op.IN:
            ends = [a if k is op.RANGE else (a, a) for k, a in arg if k in (op.LITERAL, op.RANGE)]
            if len(ends) == len(arg) and all(b < 128 and chr(a).isalnum() and chr(b).isalnum() for a, b in ends):
                return "".join(f"{chr(a)}-{chr(b)}" for a, b in ends)
            return "\\d" if [a for _, a in arg] == [op.CATEGORY_DIGIT] else None
        if kind is op.SUBPATTERN:
            return _first_chars(arg[3])
        if kind is op.BRANCH:
            heads = [_first_chars(b) for b in arg[1]]
            return None if None in heads else "".join(heads)
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
            return _first_chars(arg[2])
        if kind is not op.AT:
            return None
    return None


# The characters outside ASCII that case-insensitive matching
# treats like an ASCII letter.
FOLD_FROM, FOLD_TO = "\u017f\u212a\u0130\u0131", "skii"


def folded(text: Column) -> Column:
    """Lower-cased text in which every case variant of an ASCII letter is that letter."""
    odd = F.lit(False)
    for ch in FOLD_FROM:
        odd = odd | text.contains(ch)
    return F.when(odd, F.lower(F.translate(text, FOLD_FROM, FOLD_TO))).otherwise(F.lower(text))


_MAX_STRINGS = 24


def _best(options):
    """The most selective requirement: long strings first, then few of them."""
    options = [o for o in options if o and all(o)]
    if not options:
        return None
    return max(options, key=lambda o: (min(5, min(map(len, o))), -len(o)))


def _exact_and_required(nodes) -> tuple[set[str] | None, set[str] | None]:
    """For a parsed sequence: all texts it can match if those are few, and texts one of which it must contain."""
    run, exact, found = {""}, True, []

    def cut():
        nonlocal run, exact
        found.append(run)
        run, exact = {""}, False

    for kind, arg in nodes:
        texts, needed = None, None
        if kind is op.LITERAL and arg < 128:
            texts = {chr(arg).lower()}
        elif kind is op.IN and all(k is op.LITERAL and a < 128 for k, a in arg) and len(arg) <= 4:
            texts = {chr(a).lower() for _, a in arg}
        elif kind is op.SUBPATTERN:
            texts, needed = _exact_and_required(arg[3])
        elif kind is op.BRANCH:
            parts = [_exact_and_required(branch) for branch in arg[1]]
            if all(t is not None for t, _ in parts):
                texts = set().union(*(t for t, _ in parts))
            each = [_best([t, n]) for t, n in parts]
            if all(each):
                needed = set().union(*each)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, sub = arg
            sub_texts, sub_needed = _exact_and_required(sub)
            if (low, high) == (0, 1) and sub_texts is not None:
                texts = sub_texts | {""}
            elif low >= 1:
                needed = _best([sub_texts, sub_needed])
                if low == high == 1:
                    texts = sub_texts
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            texts = {""}
        if needed:
            found.append(needed)
        if texts is not None:
            joined = {a + b for a, b in itertools.product(run, texts)}
            if len(joined) <= _MAX_STRINGS:
                run = joined
                continue
            cut()
            if len(texts) <= _MAX_STRINGS:
                run = set(texts)
            continue
        cut()
    found.append(run)
    return (run if exact else None), _best(found)


@lru_cache(maxsize=10_000)
def required_literals(pattern: str) -> list[str] | None:
    """Folded texts of which at least one occurs in every folded text the pattern matches; None if there are none of use."""
    exact, needed = _exact_and_required(parser.parse(pattern))
    best = _best([exact, needed])
    if not best or min(map(len, best)) < 2:
        return None
    return sorted(s for s in best if not any(o != s and o in s for o in best))


@lru_cache(maxsize=10_000)
def loose_pattern(pattern: str) -> str | None:
    """For RE2: a pattern that matches in every text the given one matches in; None if it is not made of plain ASCII classes, digits and repeats."""
    parsed = parser.parse(pattern)

    def one(kind, arg) -> str | None:
        if kind is op.LITERAL:
            return f"\\x{arg:02x}" if arg < 128 else None
        if kind is op.RANGE:
            return f"\\x{arg[0]:02x}-\\x{arg[1]:02x}" if arg[1] < 128 else None
        return "\\p{Nd}" if (kind, arg) == (op.CATEGORY, op.CATEGORY_DIGIT) else None

    def sequence(nodes) -> str | None:
        out = []
        for kind, arg in nodes:
            if kind is op.IN:
                parts = [one(*x) for x in arg]
                text = None if None in parts else f"[{''.join(parts)}]"
            elif kind is op.SUBPATTERN:
                inner = None if arg[1] or arg[2] else sequence(arg[3])
                text = None if inner is None else f"(?:{inner})"
            elif kind is op.BRANCH:
                arms = [sequence(x) for x in arg[1]]
                text = None if None in arms else f"(?:{'|'.join(arms)})"
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                inner = sequence(arg[2])
                text = None if inner is None or arg[0] > 100 else f"(?:{inner}){{{arg[0]},{arg[1] if arg[1] <= 100 else ''}}}"
            else:
                text = "" if kind is op.AT else one(kind, arg)
            if text is None:
                return None
            out.append(text)
        return "".join(out)

    return None if parsed.state.flags & re.IGNORECASE else sequence(parsed) or None
