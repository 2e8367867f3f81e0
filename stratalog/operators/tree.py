"""Directory trees as flat rows: roll-ups over path prefixes, totals, listings and compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import paths
from stratalog.operators import search


def last_of_each_path(entries: DataFrame, path: str = "path", order: str = "entry_idx") -> DataFrame:
    """One row for each path: that with the largest index."""
    columns = [c for c in entries.columns if c != path]
    best = entries.groupBy(path).agg(F.max_by(F.struct(*columns), order).alias("__row"))
    return best.select(path, *[F.col(f"__row.`{c}`").alias(c) for c in columns]).select(entries.columns)


def rollup(entries: DataFrame) -> DataFrame:
    """dir, n_files, n_dirs, total_uncompressed, total_compressed of every directory, the root as "".

    Files are summed by their own directory first, so that a row is not multiplied by its depth: only distinct
    directories are taken apart.  A directory entry's own size does not count.
    """
    is_dir = F.col("is_directory")
    clean = F.array_join(paths.segments(F.col("path")), "/")
    home = F.when(is_dir, clean).otherwise(paths.parent(clean))
    own = entries.groupBy(home.alias("home")).agg(
        F.count_if(~is_dir).cast("long").alias("files"),
        F.sum(F.when(is_dir, 0).otherwise(F.col("uncompressed_size"))).alias("big"),
        F.sum(F.when(is_dir, 0).otherwise(F.coalesce("compressed_size", F.lit(0)))).alias("small"),
    )
    parts = F.split("home", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("home") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    totals = own.select(F.explode(above).alias("dir"), "files", "big", "small").groupBy("dir").agg(F.sum("files").alias("n_files"), F.sum("big").alias("total_uncompressed"), F.sum("small").alias("total_compressed"))
    inside = totals.where("dir <> ''").select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/")) - 1), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_dirs"))
    return totals.join(inside, "dir", "left").select("dir", "n_files", F.coalesce("n_dirs", F.lit(0)).cast("long").alias("n_dirs"), "total_uncompressed", "total_compressed")


def nodes(entries: DataFrame) -> DataFrame:
    """All files, and all directories with their totals, as rows with parent, name and depth."""
    dirs = rollup(entries).where("dir <> ''").select(F.col("dir").alias("path"), F.lit(True).alias("is_directory"), "total_uncompressed", "total_compressed", "n_files", "n_dirs")
    clean = F.array_join(paths.segments(F.col("path")), "/")
    files = entries.where(~F.col("is_directory")).select(clean.alias("path"), F.lit(False).alias("is_directory"), F.col("uncompressed_size").alias("total_uncompressed"), F.col("compressed_size").alias("total_compressed"), F.lit(0).cast("long").alias("n_files"), F.lit(0).cast("long").alias("n_dirs"))
    return dirs.unionByName(files).select("path", paths.parent(F.col("path")).alias("parent_path"), paths.basename(F.col("path")).alias("name"), paths.depth(F.col("path")).alias("depth"), "is_directory", "total_uncompressed", "total_compressed", "n_files", "n_dirs")


def children(tree: DataFrame, directory: str) -> DataFrame:
    """What one directory holds, directories first, in natural order."""
    return tree.where(F.col("parent_path") == directory).orderBy(F.desc("is_directory"), search.natural_key(F.col("name")), "path")


def tree_order(tree: DataFrame) -> DataFrame:
    return tree.orderBy("parent_path", F.desc("is_directory"), F.lower("name"), "path")


def deepest_first(tree: DataFrame) -> DataFrame:
    """The order in which times and modes are set after extraction."""
    return tree.orderBy(F.desc("depth"), F.desc("path"))


def totals(entries: DataFrame, *by: str) -> DataFrame:
    """Entries, directories, bytes, ratio, whether anything is encrypted, and the encryption tier."""
    encrypted = F.coalesce(F.bool_or("is_encrypted"), F.lit(False))
    return entries.groupBy(*by).agg(
        F.count("*").alias("n_entries"),
        F.count_if("is_directory").cast("long").alias("n_dirs"),
        F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("total_uncompressed"),
        F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("total_compressed"),
        F.coalesce(paths.compression_ratio(F.sum("compressed_size"), F.sum("uncompressed_size")), F.lit(0.0)).alias("ratio_pct"),
        encrypted.alias("any_encrypted"),
    )


def encryption_tier(entries: DataFrame, header_encrypted: Column, *by: str) -> DataFrame:
    """none, data or header+data, of each group."""
    return entries.groupBy(*by).agg(F.when(F.coalesce(F.bool_or(header_encrypted), F.lit(False)), "header+data").when(F.coalesce(F.bool_or("is_encrypted"), F.lit(False)), "data").otherwise("none").alias("tier"))


def composition(entries: DataFrame) -> DataFrame:
    """Files by lower-case extension ("other" without one): count, bytes, share and running angle, the largest first."""
    ext = F.lower(paths.extension(F.col("path")))
    counted = entries.where(~F.col("is_directory")).groupBy(F.when(ext == "", "other").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"), F.sum("uncompressed_size").alias("bytes"))
    # one row for each extension is left: small windows
    whole, running = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "ext").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("n") / F.sum("n").over(whole)
    return counted.select("ext", "n", "bytes", (share * 100).alias("share_pct"), (F.sum("n").over(running) / F.sum("n").over(whole) * 360).alias("end_angle"))


def render(tree: DataFrame, max_depth: int | None = None, limit: int = 10_000) -> str:
    """The tree as text, for people; at most limit rows come to the driver, and the last line says so if there are more."""
    shown = tree if max_depth is None else tree.where(F.col("depth") <= max_depth)
    rows = shown.select("path", "parent_path", "name", "is_directory", "total_uncompressed").orderBy("path").limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    below: dict[str, list] = {}
    for r in rows:
        below.setdefault(r.parent_path, []).append(r)
    lines: list[str] = []

    def put(parent: str, indent: str) -> None:
        kids = sorted(below.get(parent, []), key=lambda r: (not r.is_directory, r.name.lower(), r.name))
        for k, r in enumerate(kids):
            last = k == len(kids) - 1
            lines.append(f"{indent}{'└── ' if last else '├── '}{r.name}{'/' if r.is_directory else ''} ({r.total_uncompressed} B)")
            put(r.path, indent + ("    " if last else "│   "))

    put("", "")
    return "\n".join([*lines, *["further entries are left out"] * more])
