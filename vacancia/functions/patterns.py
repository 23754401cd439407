"""Keyword keys compiled to Java regular expressions that match as ECMAScript would.

A key is either a plain word stem (it must open a word, its end is free) or ``/regex/flags``.
Java differs from ECMAScript in four places that change results on real titles, so compiled
patterns spell them out: ``\\b`` is ASCII-only, ``\\s`` includes no-break and wide spaces, ``$``
means the very end, and case folding covers non-ASCII letters.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# The white space characters of ECMAScript that Java's \s leaves out.
EXTRA_SPACE = r"\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = rf"[\s{EXTRA_SPACE}]"
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NO_WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"
_OUTSIDE = {"b": WORD_EDGE, "B": NO_WORD_EDGE, "s": SPACE, "S": rf"[^\s{EXTRA_SPACE}]"}
_TOKEN = re.compile(r"\\(?P<esc>.)|(?P<open>\[)|(?P<close>\])|(?P<end>\$)", re.S)


def java_pattern(body: str, ignore_case: bool = True, multiline: bool = False) -> str:
    """Translate an ECMAScript pattern body into the equivalent Java pattern."""
    depth = 0

    def swap(m: re.Match) -> str:
        nonlocal depth
        if m["esc"] is not None:
            if depth:
                return rf"\s{EXTRA_SPACE}" if m["esc"] == "s" else m[0]
            return _OUTSIDE.get(m["esc"], m[0])
        if m["open"]:
            # a bracket inside a class is a literal there but opens a union in Java
            was_open, depth = depth, 1
            return r"\[" if was_open else "["
        if m["close"]:
            depth = 0
            return "]"
        return "$" if depth or multiline else r"\z"

    flags = ("(?iu)" if ignore_case else "") + ("(?m)" if multiline else "")
    return flags + _TOKEN.sub(swap, body)


def compile_key(key: object) -> str | None:
    """Java pattern of one configured key, or None for an empty or invalid key."""
    text = str(key).strip()
    if not text:
        return None
    slashed = re.fullmatch(r"/(.+)/([A-Za-z]*)", text)
    if slashed is None:
        guard = "(?<![A-Za-z0-9])" if re.match(r"[A-Za-z0-9]", text) else ""
        return "(?iu)" + guard + re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", text)
    body = re.sub(" +", r"\\s+", slashed[1])
    if re.match(r"[A-Za-z0-9_(]", body):
        body = r"\b" + body
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", body))
    except re.error:
        return None
    return java_pattern(body, multiline="m" in slashed[2].lower())


def match_span(text: Column, key: object) -> Column:
    """First match of ``key`` as struct(start, end), zero based; NULL when there is none."""
    pattern = compile_key(key)
    if pattern is None:
        return F.lit(None).cast("struct<start:int,end:int>")
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_substr(text, F.lit(pattern)))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + size).alias("end")))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def matches_any(text: Column, patterns: list[str]) -> Column:
    """True when any Java pattern is found; NULL text never matches."""
    return any_of([F.coalesce(F.rlike(text, F.lit(p)), F.lit(False)) for p in patterns])


def keys_hit(text: Column, keys: list[str]) -> Column:
    return matches_any(text, [p for p in map(compile_key, keys) if p])


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])
