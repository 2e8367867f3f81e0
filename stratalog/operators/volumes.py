"""Split archives: finding volumes, cutting into volumes, and offsets as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import paths

_NUMBERED, _SPANNED, _PART = r"^(.*)\.(\d{3,})$", r"(?i)^(.*)\.(?:z(\d{2,})|zip)$", r"(?i)^(.*)\.part(\d+)(\.[^/]*)$"


def chains(files: DataFrame) -> DataFrame:
    """chain, scheme, volume, position, path and size of every file that belongs to a chain of volumes.

    Three schemes: ``name.001``, ``name.z01`` … ``name.zip`` and ``name.part1.ext``.  A chain starts at its first number and ends before the first
    gap; what is behind a gap, and a ZIP file without ``.z01``, is a volume of its own.
    """
    name, directory = paths.basename(F.col("path")), paths.parent(F.col("path"))
    part = lambda pattern, k: F.regexp_extract(name, pattern, k)
    scheme = F.when(name.rlike(_NUMBERED), "numbered").when(name.rlike(_PART), "part").when(name.rlike(_SPANNED), "spanned").otherwise("single")
    final = name.rlike(r"(?i)\.zip$")
    rows = files.select("path", "size", scheme.alias("scheme"), directory.alias("dir"), name.alias("name"), final.alias("final"))
    digits = F.when(F.col("scheme") == "numbered", part(_NUMBERED, 2)).when(F.col("scheme") == "part", part(_PART, 2)).otherwise(part(_SPANNED, 2))
    stem = F.when(F.col("scheme") == "numbered", part(_NUMBERED, 1)).when(F.col("scheme") == "part", F.concat(part(_PART, 1), F.lit(".part*"), part(_PART, 3))).when(F.col("scheme") == "spanned", F.concat(part(_SPANNED, 1), F.lit(".z*"))).otherwise(F.col("name"))
    width = F.when(F.col("scheme") == "spanned", 0).otherwise(F.length(digits))
    rows = rows.withColumns({"number": F.when(F.col("final") | (F.col("scheme") == "single"), F.lit(None)).otherwise(digits.try_cast("long")), "stem": stem, "width": width})
    # volumes of a chain are few: a window for each chain
    chain = Window.partitionBy("dir", "scheme", "stem", "width")
    by_number = chain.orderBy(F.col("number").asc_nulls_last(), "path")
    lowest = F.min("number").over(chain)
    start = F.when(F.col("scheme") == "numbered", F.least(lowest, F.lit(1))).otherwise(F.lit(1))
    run = F.row_number().over(by_number) - 1
    joined = (F.col("number") == start + run) | (F.col("final") & (lowest == 1))
    out = rows.withColumns({"lowest": lowest, "joined": F.coalesce(joined & (lowest == start), F.lit(False))})
    alone = ~F.col("joined")
    out = out.withColumn("chain", F.when(alone, F.col("path")).otherwise(F.concat_ws("/", F.nullif("dir", F.lit("")), F.col("stem"))))
    again = Window.partitionBy("chain", "scheme").orderBy(F.col("number").asc_nulls_last(), "path")
    return out.select("chain", F.when(alone, "single").otherwise(F.col("scheme")).alias("scheme"), F.row_number().over(again).alias("volume"), F.coalesce(F.sum("size").over(again.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("position"), "path", "size")


def chain_sizes(volumes: DataFrame) -> DataFrame:
    return volumes.groupBy("chain", "scheme").agg(F.count("*").alias("n_volumes"), F.sum("size").alias("total_size"))


def offsets(entries: DataFrame, by: str, order: str, size: Column, header: Column | None = None) -> DataFrame:
    """entries with the offset at which each starts when they are stored one after the other."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    length = size if header is None else size + header
    return entries.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def local_header(path: Column) -> Column:
    """Bytes of a ZIP local header with this name: 30 and the name's."""
    return F.octet_length(path) + 30


def split_plan(archives: DataFrame, volume_size: int, naming: str = "numbered") -> DataFrame:
    """name, volume, path, start and length of the volumes that archives (name, size) are cut into, and their content if they have any."""
    if volume_size <= 0:
        raise ValueError("a volume has at least one byte")
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / volume_size)).cast("int")
    more = ["content"] * ("content" in archives.columns)
    rows = archives.select("name", "size", *more, F.posexplode(F.sequence(F.lit(1), n)).alias("k", "volume"), n.alias("n"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    ext = F.concat(F.lit("."), paths.extension(F.col("name")))
    path = {
        "numbered": F.format_string("%s.%03d", "name", "volume"),
        "spanned": F.when(F.col("volume") == F.col("n"), F.concat(stem, F.lit(".zip"))).otherwise(F.format_string("%s.z%02d", stem, "volume")),
        "part": F.concat(F.format_string("%s.part%d", stem, "volume"), ext),
    }[naming]
    start = (F.col("volume") - 1) * F.lit(volume_size).cast("long")
    return rows.select("name", "volume", path.alias("path"), start.alias("start"), F.least(F.lit(volume_size).cast("long"), F.col("size") - start).alias("length"), *more)


def cut(files: DataFrame, volume_size: int, naming: str = "numbered") -> DataFrame:
    """name, volume, path and bytes of the volumes of files (name, content): the plan is made on the row that holds the bytes, without a join."""
    plan = split_plan(files.select("name", F.length("content").cast("long").alias("size"), "content"), volume_size, naming)
    return plan.select("name", "volume", "path", F.substring(F.col("content"), (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("bytes"))
