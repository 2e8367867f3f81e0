"""The command surface as plans: each takes tables, or files by path or as a table (path, size, content), and returns a DataFrame; nothing prints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import dsl, paths, payload
from stratalog.operators import bench, codecs, diff, security, tree, volumes
from stratalog.sources import archives


def _files(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    return source if isinstance(source, DataFrame) else archives.files(spark, source)


def list_(spark: SparkSession, path: str | DataFrame, query: str = "", now: int = 0) -> DataFrame:
    """Entries that a query keeps, with their ratio."""
    rows = archives.entries(_files(spark, path)).where("error is null")
    return dsl.filter_entries(rows, query, now).withColumn("ratio_pct", paths.compression_ratio(F.col("compressed_size"), F.col("uncompressed_size")))


def first(spark: SparkSession, path: str | DataFrame, query: str, n: int, now: int = 0) -> DataFrame:
    """Some n entries that a query keeps: archives are read a few at a time, and reading stops when there are enough."""
    return list_(spark, path, query, now).limit(n)


def info(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return tree.totals(archives.entries(_files(spark, path)).where("error is null"), "archive_id")


def show_tree(spark: SparkSession, path: str | DataFrame, max_depth: int | None = None) -> DataFrame:
    nodes = tree.nodes(archives.entries(_files(spark, path)).where("error is null"))
    return tree.tree_order(nodes if max_depth is None else nodes.where(F.col("depth") <= max_depth))


def compare(spark: SparkSession, a: str | DataFrame, b: str | DataFrame) -> DataFrame:
    """Differences of two archives; checksums that a format lacks are made from the payloads."""

    def side(path: str | DataFrame) -> DataFrame:
        rows = archives.entries(_files(spark, path), with_payload=True).where("error is null")
        return tree.last_of_each_path(rows.select("path", "entry_idx", "uncompressed_size", F.coalesce("crc32", F.crc32("payload")).alias("crc32")))

    return diff.diff(side(a), side(b)).where("status <> 'same'").orderBy("status", "path")


def hashes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return _files(spark, path).select("path", payload.digests(F.col("content")).alias("d")).select("path", "d.*")


def check(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Every payload read and compared with its checksum; broken archives are CORRUPTED."""
    rows = archives.entries(_files(spark, path), with_payload=True)
    bad = rows.where("error is not null").groupBy("archive_id").agg(F.first("error").alias("error"))
    good = security.integrity(rows.where("error is null").withColumn("crc32", F.coalesce("crc32", F.crc32("payload"))), "archive_id")
    both = good.join(bad, "archive_id", "full_outer")
    return both.withColumn("status", F.when(F.col("error").isNotNull(), "CORRUPTED").otherwise(F.col("status")))


def cat(spark: SparkSession, archive: str | DataFrame, path: str) -> DataFrame:
    return diff.by_path(archives.entries(_files(spark, archive), with_payload=True).where("error is null"), path).select("path", "payload")


def extract(spark: SparkSession, path: str | DataFrame, query: str = "") -> DataFrame:
    """Payloads with the path each would be written to; paths that would escape are rows with a reason and no payload."""
    rows = dsl.filter_entries(archives.entries(_files(spark, path), with_payload=True).where("error is null and not is_directory"), query)
    good = paths.is_extractable(F.col("path"))
    return rows.select("archive_id", "path", F.when(good, paths.normalised(F.col("path"))).alias("target"), F.when(good, F.col("payload")).alias("payload"), F.when(~good, "unsafe path").when(F.col("payload").isNull(), "not readable").alias("reason"))


def create(table: DataFrame, by: str, container: str = "zip") -> DataFrame:
    return archives.pack(table, by, container)


def repair(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return archives.entries(_files(spark, path), with_payload=True, salvage=True)


def split(spark: SparkSession, path: str | DataFrame, volume_size: int, naming: str = "numbered") -> DataFrame:
    """Volumes of every file: name, path and bytes."""
    files = _files(spark, path).select(paths.basename(F.col("path")).alias("name"), "size", "content")
    return volumes.cut(files, volume_size, naming)


def join(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    files = _files(spark, path)
    chains = volumes.chains(files.select("path", "size")).where("scheme <> 'single'")
    return archives.join_volumes(files, chains)


def convert(spark: SparkSession, path: str | DataFrame, container: str) -> DataFrame:
    rows = archives.entries(_files(spark, path), with_payload=True).where("error is null")
    return archives.pack(diff.converted(rows), "archive_id", container)


def delete(entries: DataFrame, query: str, now: int = 0) -> DataFrame:
    return diff.edited(entries, deletes=dsl.filter_entries(entries, query, now))


def update(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Upserts what is new or changed."""
    return diff.edited(entries, upserts=diff.only_changed(candidates, entries))


def bench_matrix(payloads: DataFrame, key: str, configs: list[tuple[str, int]] | None = None) -> DataFrame:
    """Points of a codec matrix with their tier and hull, over savings and compression rate."""
    points = codecs.matrix_points(codecs.matrix(payloads, key, configs))
    shaped = points.select(F.lit("all").alias("suite"), F.concat_ws("-", "codec", "level").alias("codec"), F.col("savings_pct").alias("x"), F.col("compress_mbs").alias("y"))
    return bench.tiers(shaped, "suite")


def batch(spark: SparkSession, tasks: dict[str, Callable[[], DataFrame]], tag: str | None = None) -> DataFrame:
    """Runs named plans one after the other; a row each with rows made or the error, which does not stop the others.  tag: for interruptTag."""
    out = []
    if tag:
        spark.addTag(tag)
    try:
        for name, task in tasks.items():
            try:
                out.append((name, True, task().count(), None))
            except Exception as e:  # noqa: BLE001 - the row says so
                out.append((name, False, None, f"{type(e).__name__}: {str(e)[:200]}"))
    finally:
        if tag:
            spark.removeTag(tag)
    return spark.createDataFrame(out, "task string, success boolean, n_rows long, error string")


def cancel(spark: SparkSession, tag: str) -> list[str]:
    return spark.interruptTag(tag)


def cache_stats(spark: SparkSession) -> DataFrame:
    """What Spark keeps of persisted tables: partitions, and bytes in memory and on disk."""
    rows = [(i.name(), i.numCachedPartitions(), i.memSize(), i.diskSize()) for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()]
    return spark.createDataFrame(rows, "name string, n_partitions int, memory_bytes long, disk_bytes long")
