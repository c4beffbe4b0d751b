"""Globs compiled to one regular expression when a plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

META = frozenset("*?[{")


def expand(pattern: str) -> list[str]:
    """A bare name stands for itself and all below it, anywhere; a pattern with wildcards or a leading slash is taken as written."""
    if pattern.startswith("/") or META & set(pattern):
        return [pattern.lstrip("/")]
    name = pattern.strip("/")
    return [name, f"{name}/**", f"**/{name}/**", f"**/{name}"]


def to_regex(glob: str) -> str:
    """One glob as a regular expression over a whole path; only ``**`` crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 3
        elif glob.startswith("**", i):
            out += ".*"
            i += 2
        elif c == "*":
            out += "[^/]*"
            i += 1
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end + 1
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(to_regex(x) for x in glob[i + 1 : end].split(",")) + ")"
            i = end + 1
        else:
            out += re.escape(c)
            i += 1
    return out


def compile_all(patterns: list[str]) -> str | None:
    """One expression for a list of patterns, or None for an empty list."""
    parts = [to_regex(g) for p in patterns for g in expand(p)]
    return "(?s)\\A(?:" + "|".join(parts) + ")\\z" if parts else None


def skipped(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches the path."""
    regex = compile_all(patterns)
    return F.lit(False) if regex is None else path.rlike(regex)
