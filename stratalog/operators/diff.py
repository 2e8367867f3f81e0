"""Comparing and editing catalogues: key joins, null-safe where keys may be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators import tree


def diff(a: DataFrame, b: DataFrame, key: str = "path", compared: tuple[str, ...] = ("uncompressed_size", "crc32")) -> DataFrame:
    """key and status: only_a, only_b, modified, same.  Each side has one row a key (see last_of_each_path)."""
    left = a.select(key, F.struct(*compared).alias("__a"))
    right = b.select(key, F.struct(*compared).alias("__b"))
    status = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("modified")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def diff_counts(a: DataFrame, b: DataFrame, **options: object) -> DataFrame:
    return diff(a, b, **options).groupBy("status").agg(F.count("*").alias("n"))


def compare_manifests(ours: DataFrame, theirs: DataFrame, full_modes: bool = False) -> DataFrame:
    """relative_path and issue for each difference in presence, type, size, digest, link target or mode.

    Modes are compared whole for tar, by their execute bits otherwise.  A type difference hides the rest.
    """
    fields = ("entry_type", "byte_size", "sha256", "posix_mode", "symlink_target")
    a = ours.select("relative_path", F.struct(*fields).alias("a"))
    b = theirs.select("relative_path", F.struct(*fields).alias("b"))
    both = a.join(b, "relative_path", "full_outer")
    differs = lambda f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    regular, link = F.col("a.entry_type") == "regular", F.col("a.entry_type") == "symlink"
    bits = lambda side: F.col(f"{side}.posix_mode") if full_modes else F.col(f"{side}.posix_mode").bitwiseAND(0o111)
    details = F.array(
        F.when(regular & differs("byte_size"), "size"),
        F.when(regular & differs("sha256"), "sha256"),
        F.when(link & differs("symlink_target"), "symlink"),
        F.when(~bits("a").eqNullSafe(bits("b")), "mode"),
    )
    issues = F.when(F.col("a").isNull(), F.array(F.lit("missing"))).when(F.col("b").isNull(), F.array(F.lit("extra"))).when(differs("entry_type"), F.array(F.lit("type"))).otherwise(F.array_compact(details))
    return both.select("relative_path", F.explode(issues).alias("issue"))


def edited(entries: DataFrame, deletes: DataFrame | None = None, upserts: DataFrame | None = None, key: str = "path") -> DataFrame:
    """The catalogue after an edit: keys deleted, rows replaced by key, new rows appended."""
    out = entries
    if deletes is not None:
        out = out.join(deletes.select(key).distinct(), key, "left_anti").select(entries.columns)
    if upserts is not None:
        out = out.join(upserts.select(key).distinct(), key, "left_anti").select(entries.columns).unionByName(upserts.select(entries.columns))
    return out


class Session:
    """An edit of a catalogue that nothing sees until it is committed: the base stays as it is, later changes of a key win."""

    def __init__(self, base: DataFrame, key: str = "path") -> None:
        self.base, self.key, self.state = base, key, base
        self.before: DataFrame | None = None

    def delete(self, keys: DataFrame) -> Session:
        self.state = edited(self.state, deletes=keys, key=self.key)
        return self

    def upsert(self, rows: DataFrame) -> Session:
        self.state = edited(self.state, upserts=rows, key=self.key)
        return self

    def commit(self) -> DataFrame:
        """The edited catalogue, which is the base of what follows."""
        self.before, self.base = self.base, self.state
        return self.base

    def rollback(self) -> DataFrame:
        """The catalogue before the last commit, or before the changes that were not committed."""
        if self.state is self.base and self.before is not None:
            self.base, self.before = self.before, None
        self.state = self.base
        return self.base


def edit_effects(entries: DataFrame, deletes: DataFrame, upserts: DataFrame, key: str = "path") -> DataFrame:
    """What an edit would do: action and n, of deletes that hit, replacements and appends."""
    known = entries.select(key).distinct()
    actions = deletes.select(key, F.lit("delete").alias("action")).unionByName(upserts.select(key, F.lit("upsert").alias("action")))
    hit = actions.join(known.withColumn("__known", F.lit(True)), key, "left")
    name = F.when(F.col("action") == "delete", F.when(F.col("__known"), "deleted").otherwise("not_found")).otherwise(F.when(F.col("__known"), "replaced").otherwise("appended"))
    return hit.groupBy(name.alias("action")).agg(F.count("*").alias("n"))


def only_changed(candidates: DataFrame, entries: DataFrame, key: str = "path") -> DataFrame:
    """Rows of an update that are new, or newer or of another checksum than the catalogue's."""
    old = entries.select(key, F.col("mtime_epoch").alias("__mtime"), F.col("crc32").alias("__crc"), F.lit(True).alias("__known"))
    joined = candidates.join(old, key, "left")
    return joined.where(F.col("__known").isNull() | (F.col("mtime_epoch") > F.col("__mtime")) | ~F.col("crc32").eqNullSafe(F.col("__crc"))).select(candidates.columns)


def converted(entries: DataFrame, prefix: str | None = None) -> DataFrame:
    """Rows for another container: the same paths, compressed sizes unknown until written."""
    path: Column = F.col("path") if prefix is None else F.concat_ws("/", F.lit(prefix), F.col("path"))
    return entries.withColumns({"path": path, "compressed_size": F.lit(None).cast("long")})


def found_entries(hits: DataFrame, entries: DataFrame, keep_implicit: bool = False) -> DataFrame:
    """Search hits with their catalogue rows; directories that no row names are dropped unless asked for."""
    return hits.join(entries.drop(*[c for c in hits.columns if c != "path"]), "path", "left" if keep_implicit else "inner")


def by_path(entries: DataFrame, path: str) -> DataFrame:
    """The entry with exactly this path, but for leading slashes."""
    return entries.where(F.regexp_replace("path", "^/+", "") == path.lstrip("/"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).exceptAll(b.select(key)).distinct()


def word_list(*lists: DataFrame) -> DataFrame:
    """All words of several lists once."""
    out = lists[0].select("word")
    for more in lists[1:]:
        out = out.unionByName(more.select("word"))
    return out.dropDuplicates()


latest = tree.last_of_each_path
