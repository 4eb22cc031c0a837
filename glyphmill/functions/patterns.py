"""Globs, safe regular expressions and name predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest pattern accepted, in bytes.
MOST_BYTES = 512


def glob_regex(glob: str) -> str:
    """Regular expression that whole paths match: **/ any directories, ** anything, * and ? within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches_glob(path: Column, *globs: str) -> Column:
    """Whether the whole path matches any of the globs."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def checked(pattern: str) -> str:
    """The pattern, if it is short and without a quantifier inside a quantified group; else ValueError."""
    if len(pattern.encode()) > MOST_BYTES:
        raise ValueError(f"pattern longer than {MOST_BYTES} bytes")
    re.compile(pattern)
    open_groups: list[bool] = []
    quantified = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = pattern.index("]", i + 2)
        elif c == "(":
            open_groups.append(False)
        elif c == ")":
            inside = open_groups.pop()
            quantified = i + 1 < len(pattern) and pattern[i + 1] in "*+{"
            if inside and quantified:
                raise ValueError(f"nested quantifiers: {pattern}")
            if open_groups:
                open_groups[-1] = open_groups[-1] or inside or quantified
        elif c in "*+{" and open_groups:
            open_groups[-1] = True
        i += 1
    return pattern


def any_matches(value: Column, patterns: list[str]) -> Column:
    return value.rlike("|".join(f"(?:{checked(p)})" for p in patterns)) if patterns else F.lit(False)


def required_trigrams(pattern: str) -> list[str]:
    """Trigrams that every match must hold: those of literal runs. A pattern with a top-level alternative or an
    optional part after a run requires none of that part."""
    depth, runs, run, i = 0, [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            run, i = run + pattern[i + 1], i + 2
            continue
        if c in "*?{":
            run = run[:-1]
        if c == "|" and depth == 0:
            return []
        if c.isalnum() or c == "_":
            run += c if depth == 0 else ""
        else:
            runs.append(run)
            run = ""
            if c == "\\":
                i += 1
            depth += (c in "([") - (c in ")]")
        i += 1
    runs.append(run)
    return sorted({r[j : j + 3] for r in runs for j in range(len(r) - 2)})


def is_test_suite(name: Column) -> Column:
    return name.rlike("(Test|Tests)$")


def is_backticked(name: Column) -> Column:
    return (F.char_length(name) > 2) & name.startswith("`") & name.endswith("`")
