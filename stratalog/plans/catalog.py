"""Catalogue-shaped views of the shared tables, and the flagship plan over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import dsl, paths
from stratalog.operators import tree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries of one archive a host: the path is the URL without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        F.substring_index(path, "/", 1).alias("archive_id"), F.col("page_id").cast("int").alias("entry_idx"), path.alias("path"), F.octet_length("html").cast("long").alias("uncompressed_size"),
        F.lit(None).cast("long").alias("compressed_size"), F.lit(None).cast("long").alias("crc32"), (F.lit(1_700_000_000) + F.col("page_id") * 60).alias("mtime_epoch"), F.lit(False).alias("is_directory"), F.lit(False).alias("is_encrypted"),
    )


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of one archive a source: lang/source/id, the extension by language."""
    ext = F.when(F.col("lang") == "en", "txt").when(F.col("lang") == "de", "md").when(F.col("lang") == "fr", "TXT").otherwise("")
    name = F.concat(F.col("doc_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("archive_id"), F.col("doc_id").cast("int").alias("entry_idx"), F.concat_ws("/", "lang", "source", name).alias("path"), F.col("n_chars").alias("uncompressed_size"),
        F.floor(F.col("n_chars") / 3).alias("compressed_size"), F.crc32(F.col("text").cast("binary")).alias("crc32"), (F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("mtime_epoch"), F.lit(False).alias("is_directory"), (F.col("doc_id") % 7 == 0).alias("is_encrypted"),
    )


def with_names(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"name": paths.basename(F.col("path")), "ext": paths.extension(F.col("path"))})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter language over the page catalogue, then the roll-up of every directory."""
    kept = dsl.filter_entries(page_entries(spark, sf_dir), "(ext:html OR size:>1KB) AND NOT name:admin*", no_junk=True)
    return tree.rollup(kept).orderBy("dir")
