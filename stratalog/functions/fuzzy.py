"""Scored subsequence matching of names."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a matched character, and of the whole.
MATCH, SAME_CASE, BOUNDARY, HUMP, NEXT_TO, WHOLE, START, NAME = 10, 5, 30, 25, 20, 500, 200, 100
_EDGES = frozenset("/\\_-. ")


def _folded(c: str) -> str:
    return c.lower() if c.isascii() else c


def score(target: str, pattern: str) -> tuple[int, list[int]] | None:
    """Points and places of the leftmost subsequence that equals the pattern but for ASCII case; None if there is none."""
    pattern = pattern.strip()
    places, at = [], -1
    low = [_folded(c) for c in target]
    for c in pattern:
        try:
            at = low.index(_folded(c), at + 1)
        except ValueError:
            return None
        places.append(at)
    if not places:
        return 0, []
    total = 0
    for k, (i, c) in enumerate(zip(places, pattern, strict=True)):
        total += MATCH + SAME_CASE * (target[i] == c)
        if i == 0 or target[i - 1] in _EDGES:
            total += BOUNDARY
        elif target[i - 1].islower() and target[i].isupper():
            total += HUMP
        if k:
            gap = i - places[k - 1] - 1
            total += NEXT_TO if gap == 0 else -gap
    if "".join(low) == "".join(map(_folded, pattern)):
        total += WHOLE
    elif target.lower().startswith(pattern.lower()):
        total += START
    return total, places


def matcher(pattern: str) -> object:
    """An Arrow-batched function of a string column: struct(score, places), null where the pattern does not match."""

    @F.pandas_udf("score long, places array<int>")
    def run(target: pd.Series) -> pd.DataFrame:
        found = [None if t is None else score(t, pattern) for t in target]
        return pd.DataFrame({"score": pd.array([None if f is None else f[0] for f in found], dtype="Int64"), "places": [None if f is None else np.array(f[1], dtype=np.int32) for f in found]})

    return run


def may_match(target: Column, pattern: str) -> Column:
    """A built-in sieve that no matching row fails, so that few rows reach Python."""
    return target.rlike("(?is)" + ".*".join(re.escape(c) for c in pattern.strip()))


def search(entries: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """entries (path, name, ...) that match by name, or else by path, with score and places; best first, ties by path."""
    run = matcher(query)
    scored = entries.where(may_match(F.col("path"), query)).withColumns({"__n": run(F.col("name")), "__p": run(F.col("path"))})
    by_name = F.col("__n.score").isNotNull()
    out = scored.withColumns({"score": F.when(by_name, F.col("__n.score") + NAME).otherwise(F.col("__p.score")), "places": F.when(by_name, F.col("__n.places")).otherwise(F.col("__p.places"))})
    out = out.where("score is not null").drop("__n", "__p").orderBy(F.desc("score"), "path")
    return out if limit is None else out.limit(limit)
