"""Glob patterns as anchored regular expressions that Catalyst evaluates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = "(?!)"


def _class(body: str) -> str:
    """A bracket expression; ``a-z`` is a range unless the bracket ends at once after it."""
    negated = body.startswith("^")
    body = body[1:] if negated else body
    if not body:
        return NEVER
    parts, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                parts.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}")
            i += 3
        else:
            parts.append(f"\\x{{{ord(body[i]):x}}}")
            i += 1
    if not parts:
        return "(?s:.)" if negated else NEVER
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def glob_regex(pattern: str) -> str:
    """``*`` any run, ``?`` one character, ``[a-z]`` and ``[^a-z]`` classes, ``\\`` escapes.

    A class that is empty or never closed matches nothing.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[":
            start = i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1
            end = pattern.find("]", start)
            if end < 0:
                return NEVER
            out.append(_class(pattern[i + 1 : end]))
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return r"\A" + "".join(out) + r"\z"


def glob_match(text: Column, pattern: str) -> Column:
    """The cheapest test for the pattern; prefixes reach the file scan as such."""
    if not re.search(r"[?\[\\]", pattern):
        parts = pattern.split("*")
        if len(parts) == 1:
            return text == pattern
        if len(parts) == 2 and not parts[1]:
            return text.startswith(parts[0])
        if len(parts) == 2 and not parts[0]:
            return text.endswith(parts[1])
        if len(parts) == 3 and not parts[0] and not parts[2]:
            return text.contains(parts[1])
    return text.rlike(glob_regex(pattern))


def glob_match_binary(value: Column, pattern: str) -> Column:
    """The same over bytes, each read as one character."""
    raw = pattern.encode().decode("latin-1")
    return F.decode(value, "ISO-8859-1").rlike(glob_regex(raw))
