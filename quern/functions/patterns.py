"""URL patterns, globs or regular expressions, compiled on the driver to Java's dialect."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_glob(pattern: str) -> bool:
    """A wildcard makes a glob, unless a sign of regular expressions is there and no star leads."""
    return any(c in pattern for c in "*?[]") and (pattern.startswith("*") or not any(c in pattern for c in "^$+|(){}"))


def _glob(pattern: str) -> str:
    """A glob as an expression that ends where the text ends; an unclosed bracket is a plain character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inside = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out.append("[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s:" + "".join(out) + r")\z"


def compile_pattern(pattern: str, ignore_case: bool = True) -> str:
    """The Java expression to search for; ``regex:`` and ``glob:`` in front decide, an invalid one is taken literally."""
    kind, _, rest = pattern.partition(":")
    if kind in ("regex", "glob") and rest:
        body = rest if kind == "regex" else _glob(rest)
    else:
        body = _glob(pattern) if is_glob(pattern) else pattern
    try:
        re.compile(body.replace(r"\z", r"\Z"))
    except re.error:
        body = re.escape(pattern)
    return ("(?i)" if ignore_case else "") + body


def matches_any(url: Column, patterns: Iterable[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | url.rlike(compile_pattern(p))
    return hit


def included(url: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """An excluding match decides; without including patterns all else passes."""
    include = list(include)
    return ~matches_any(url, exclude) & (matches_any(url, include) if include else F.lit(True))


def reason(url: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """The first pattern that decided, as ``exclude:...`` or ``include:...``; null if none did."""
    tests = [F.when(url.rlike(compile_pattern(p)), F.lit(f"{kind}:{p}")) for kind, ps in (("exclude", exclude), ("include", include)) for p in ps]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")
