"""Topic patterns: ``*`` is one level, a last ``#`` any number of levels, ``*`` within a level a glob."""

from __future__ import annotations

import re


def is_wildcard(pattern: str) -> bool:
    return "*" in pattern or "#" in pattern


def topic_regex(pattern: str) -> str:
    """An anchored regular expression; ValueError if ``#`` repeats or is not last."""
    levels = pattern.split(".")
    if levels.count("#") > 1:
        raise ValueError("a pattern can hold only one # wildcard")
    if "#" in levels[:-1]:
        raise ValueError("the # wildcard must end the pattern")
    out = []
    for i, level in enumerate(levels):
        dot = r"\." if i else ""
        if level == "#":
            out.append(rf"(?:{dot}(?s:.*))?" if i else "(?s:.*)")
        elif level == "*":
            out.append(dot + r"[^.]*")
        else:
            out.append(dot + r"[^.]*".join(re.escape(p) for p in level.split("*")))
    return r"\A" + "".join(out) + r"\z"
