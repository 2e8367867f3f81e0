"""Risk, layout and integrity of archives, from their catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import paths, payload

#: Extensions of files that run when opened.
DANGEROUS = ("exe", "bat", "cmd", "vbs", "js", "scr", "pif", "sh", "command")
BOMB_RATIO, BOMB_BYTES = 100.0, 1_000_000


def is_traversal(path: Column) -> Column:
    """The cheap reading of an escaping path, in expressions only."""
    return path.contains("..") | path.startswith("/") | path.contains(":\\")


def is_bomb(size: Column, compressed: Column) -> Column:
    return F.coalesce((compressed > 0) & (size / compressed > BOMB_RATIO) & (size > BOMB_BYTES), F.lit(False))


def is_dangerous(path: Column) -> Column:
    return F.lower(paths.extension(path)).isin(*DANGEROUS)


def risk(entries: DataFrame, *by: str, strict: bool = False) -> DataFrame:
    """level (SAFE, WARNING, CRITICAL), counts and the number of suspicious paths, for each group.

    strict also takes a path apart as an extractor would (drives, streams, device names); that part runs in Arrow batches.
    """
    rows = entries.select(*by, "path", "uncompressed_size", "compressed_size").withColumn("unsafe", is_traversal(F.col("path")))
    if strict:
        s = payload.sanitize(F.col("path"))
        rows = rows.withColumn("s", s).withColumn("unsafe", F.col("unsafe") | F.col("s.traversal") | F.col("s.absolute") | F.col("s.unc") | F.col("s.device") | F.col("s.stream").isNotNull() | (F.col("s.path") == ""))
    bomb, bad = is_bomb(F.col("uncompressed_size"), F.col("compressed_size")), is_dangerous(F.col("path"))
    rank = F.when(F.col("unsafe"), 2).when(bad | bomb, 1).otherwise(0)
    # a path counts once: paths are grouped before they are counted
    each = rows.groupBy(*by, "path").agg(F.max(rank).alias("rank"), F.bool_or("unsafe").alias("unsafe"), F.bool_or(bomb).alias("bomb"))
    worst = F.max("rank")
    return each.groupBy(*by).agg(
        F.when(worst == 2, "CRITICAL").when(worst == 1, "WARNING").otherwise("SAFE").alias("level"),
        F.count_if("unsafe").cast("long").alias("n_traversal"),
        F.count_if("bomb").cast("long").alias("n_bombs"),
        F.count_if(F.col("rank") > 0).cast("long").alias("n_suspicious"),
    )


def root_layout(entries: DataFrame, *by: str) -> DataFrame:
    """Distinct first components without junk, and how to extract: empty, direct or wrap."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./)+", ""), "^/+|/+$", "")
    kept = entries.select(*by, clean.alias("p"), paths.is_junk(F.col("path"), "entry").alias("junk"))
    root = F.when(~F.col("junk") & (F.col("p") != ""), F.substring_index("p", "/", 1))
    roots = kept.groupBy(*by, root.alias("root")).agg(F.lit(1).alias("one"))
    n = F.count("root")
    return roots.groupBy(*by).agg(n.alias("n_roots"), F.when(n == 0, "empty").when(n == 1, "direct").otherwise("wrap").alias("mode"), F.when(n == 1, F.max("root")).alias("single_root"))


def integrity(entries: DataFrame, *by: str) -> DataFrame:
    """Files whose payload has the stored checksum and size, those that have not, and those without either; status PASSED, CORRUPTED or UNVERIFIED."""
    known = F.col("payload").isNotNull() & F.col("crc32").isNotNull()
    good = known & (F.crc32("payload") == F.col("crc32")) & (F.length("payload") == F.col("uncompressed_size"))
    file = ~F.col("is_directory")
    return entries.groupBy(*by).agg(
        F.count_if(file).cast("long").alias("n_files"),
        F.count_if(file & good).cast("long").alias("n_verified"),
        F.count_if(file & known & ~good).cast("long").alias("n_corrupted"),
        F.coalesce(F.sum(F.when(file, F.length("payload"))), F.lit(0)).alias("bytes_read"),
        F.when(F.coalesce(F.bool_or(file & known & ~good), F.lit(False)), "CORRUPTED").when(F.coalesce(F.bool_or(file & ~known), F.lit(False)), "UNVERIFIED").otherwise("PASSED").alias("status"),
    )


def issue_summary(issues: DataFrame, *by: str) -> DataFrame:
    """Errors and warnings of compliance issues, and whether there is no error."""
    errors = F.count_if(F.col("severity") == "ERROR")
    return issues.groupBy(*by).agg(errors.cast("long").alias("n_errors"), F.count_if(F.col("severity") == "WARNING").cast("long").alias("n_warnings"), (errors == 0).alias("is_compliant"))


#: From this number on, a name that is taken gets a digest instead.
MOST_NUMBER = 1000


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """name and free for each distinct wanted name: itself, or with the least number from 2 on that no taken name has."""
    names = wanted.select("name").distinct()
    number = F.regexp_extract("name", r" (\d{1,9})$", 1)
    plain = taken.select("name", F.lit(1).alias("k"))
    numbered = taken.where(number.rlike("^[1-9]")).select(F.regexp_extract("name", r"^(.*) \d{1,9}$", 1).alias("name"), number.cast("int").alias("k")).where("k >= 2")
    used = plain.unionByName(numbered).distinct().join(names, "name", "left_semi")
    # a gap is where a number is above its place; 1 is the name itself
    place = used.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("k")))
    gaps = place.groupBy("name").agg(F.coalesce(F.min(F.when(F.col("k") > F.col("place"), F.col("place"))), F.max("place") + 1).alias("first"), F.min("k").alias("least"))
    free = F.when(F.col("least").isNull() | (F.col("least") > 1), F.col("name")).when(F.col("first") < MOST_NUMBER, F.concat_ws(" ", "name", F.col("first").cast("string"))).otherwise(F.concat(F.col("name"), F.lit("_"), F.substring(F.sha2("name", 256), 1, 6)))
    return names.join(gaps, "name", "left").select("name", free.alias("free"))
