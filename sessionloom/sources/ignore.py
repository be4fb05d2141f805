"""Ignore files: globs in order, the last that matches a path decides, ! takes back.

A star stands for any characters, a slash among them; ``**/`` for any folders or none, ``/**`` for all below, ``?`` for
one character, ``[a-c]`` and ``[!a]`` for one of a set, ``{a,b}`` for either; a backslash takes the next character as it is.
A pattern is held against the whole path below the store; a slash at its end means all below, one at its head nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_regex(pattern: str) -> str:
    """A glob as a regular expression that Java and Python read alike."""
    text = pattern.strip()
    while text.startswith("./"):
        text = text[2:]
    text = re.sub("/{2,}", "/", text.lstrip("/"))
    text += "**" if text.endswith("/") else ""
    out, i, depth = "", 0, 0
    while i < len(text):
        c = text[i]
        if text.startswith("**", i) and (i == 0 or text[i - 1] == "/") and (i + 2 == len(text) or text[i + 2] == "/"):
            last = i + 2 == len(text)
            out += ".*" if i == 0 and last else ".+" if last else "(?:.*/)?"
            i += 2 if last else 3
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = text.find("]", i + (3 if text[i + 1 : i + 2] in ("!", "^") else 2))
            if end < 0:
                raise ValueError(f"a set is not closed in {pattern!r}")
            body = text[i + 1 : end]
            out += "[" + ("^" if body[0] in "!^" else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(text):
            out += re.escape(text[i + 1])
            i += 1
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"a choice is not closed in {pattern!r}")
    return f"(?s)^{out}$"


def parse(text: str) -> list[tuple[bool, str]]:
    """(takes back, regular expression) of each line that is neither empty nor a comment."""
    rules = []
    for line in map(str.strip, text.splitlines()):
        pattern = line.lstrip("!").strip()
        if pattern and not line.startswith("#"):
            rules.append((line.startswith("!"), pattern_regex(pattern)))
    return rules


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether a path is ignored: one CASE, the last rule first."""
    found = F.lit(False)
    if rules:
        found = None
        for back, regex in reversed(rules):
            found = F.when(path.rlike(regex), not back) if found is None else found.when(path.rlike(regex), not back)
        found = F.coalesce(found.otherwise(False), F.lit(False))
    return found
