"""Orders, searches and top-k lists over entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratalog.functions import paths

#: Digits that the length of a number is written with in a natural key.
WIDTH = 10
COMPLETIONS, HITS = 15, 50


def natural_key(name: Column) -> Column:
    """A string whose plain order is the natural one: in lower case, each number after the count of its digits, however many; the name itself parts ties."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)

    def counted(piece: Column) -> Column:
        digits = F.regexp_replace(piece, "^0+(?=.)", "")
        return F.when(piece.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), WIDTH, "0"), digits)).otherwise(piece)

    return F.concat(F.array_join(F.transform(pieces, counted), ""), F.lit("\x01"), name)


MODES = ("name_asc", "name_desc", "size_asc", "size_desc", "date_asc", "date_desc", "kind")


def placed(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Ordered rows with their places from 1 on: the sorted partitions are counted, then numbered, never brought to one task."""
    numbered = rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    return rows.sparkSession.createDataFrame(numbered, StructType([*rows.schema.fields, StructField(name, LongType())]), verifySchema=False)


def ordered(items: DataFrame, mode: str) -> DataFrame:
    """Folders first, then by mode; unknown dates are last both ways; ties by natural name, then path."""
    name = natural_key(F.col("name"))
    keys = {
        "name_asc": [name.asc()],
        "name_desc": [name.desc()],
        "size_asc": [F.col("size").asc()],
        "size_desc": [F.col("size").desc()],
        "date_asc": [F.col("mtime").asc_nulls_last()],
        "date_desc": [F.col("mtime").desc_nulls_last()],
        "kind": [F.lower("kind").asc_nulls_last()],
    }
    if mode not in keys:
        raise ValueError(f"unknown mode {mode!r}")
    return items.orderBy(F.desc("is_directory"), *keys[mode], name.asc(), F.col("path").asc())


def complete(items: DataFrame, typed: str, limit: int = COMPLETIONS) -> DataFrame:
    """Items whose name starts as typed, in any case: folders, archives, files, in natural order; hidden ones only if a dot is typed."""
    out = items.where(F.lower("name").startswith(typed.lower()))
    if not typed.startswith("."):
        out = out.where(~F.col("name").startswith("."))
    rank = F.when(F.col("is_directory"), 0).when(F.col("is_archive"), 1).otherwise(2)
    return out.orderBy(rank, natural_key(F.col("name")), "path").limit(limit)


def contains(items: DataFrame, text: str, limit: int = HITS) -> DataFrame:
    """Items with the text in their name, in any case, in path order."""
    return items.where(F.lower("name").contains(text.lower())).orderBy("path").limit(limit)


def recent(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("ts"), "run_id").limit(limit)


def is_archive(path: Column) -> Column:
    return F.lower(paths.extension(path)).isin("zip", "zipx", "7z", "tar", "tgz", "tbz", "tbz2", "txz", "tzst", "gz", "bz2", "xz", "zst", "rar", "cab", "iso", "wim", "jar")
