"""Globs as regular expressions that both Java and RE2 read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions import paths

_SPECIAL = set(r".^$+()|\{}[]*?")


def to_regex(glob: str, slash_is_literal: bool = False, any_case: bool = False) -> str:
    """The regular expression of a glob: ``*``, ``**``, ``?``, ``[a-z]``, ``[!a]``, ``{a,b}``; ``*`` crosses slashes unless they are literal."""
    star, one = ("[^/]*", "[^/]") if slash_is_literal else (".*", ".")
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            stars = 1
            while glob[i : i + 1] == "*":
                i, stars = i + 1, stars + 1
            if stars >= 2 and glob[i : i + 1] == "/" and (not out or out[-1] == "/"):
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*" if stars >= 2 else star)
        elif c == "?":
            out.append(one)
        elif c == "[" and "]" in glob[i + 1 :]:
            stop = glob.index("]", i + 1)
            body = glob[i:stop]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = stop + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        else:
            out.append(f"\\{c}" if c in _SPECIAL else c)
    if depth:
        raise ValueError(f"unclosed {{ in {glob!r}")
    return f"(?{'i' * any_case}s)^(?:{''.join(out)})$"


def matches(path: Column, glob: str) -> Column:
    """A case-sensitive path pattern; without a slash it may also match any one component."""
    glob = glob.removeprefix("/")
    clean = F.when(path.startswith("/"), F.substring(path, 2, 1 << 20)).otherwise(path)
    pattern = to_regex(glob, slash_is_literal="/" in glob)
    out = path.rlike(pattern) | clean.rlike(pattern)
    return out if "/" in glob else out | F.exists(F.split(clean, "/"), lambda s: s.rlike(pattern))


def path_filter(path: Column, include: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = (), no_vcs: bool = False, no_junk: bool = False, strict_exclude: bool = False) -> Column:
    """Which paths a pattern set keeps.  Includes, where given, decide alone; strict_exclude lets excludes take from them."""
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for g in include:
            keep = keep | matches(path, g)
    if exclude and (strict_exclude or not include):
        for g in exclude:
            keep = keep & ~matches(path, g)
    if no_vcs:
        keep = keep & ~paths.is_vcs(path)
    if no_junk:
        keep = keep & ~paths.is_junk(path)
    return keep
