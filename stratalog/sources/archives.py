"""Archives as tables: catalogue scans, salvage, checks, and packing, with Spark reading and writing the files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from stratalog.functions import paths, signatures
from stratalog.sources import containers

SCHEMA = f"archive_id string, {containers.ENTRY_DDL}, name string, ext string, error string"


def files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, size, mtime and content of the files below a path; content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def walk(spark: SparkSession, path: str, hidden: bool = False, junk: bool = False, max_depth: int | None = None) -> DataFrame:
    """rel_path, name, size, mtime and depth of the files below a path, without hidden and junk ones unless asked for."""
    found = files(spark, path).drop("content")
    base = F.regexp_replace(F.lit(path), r"^\w+://[^/]*|^\w+:|/+$", "")
    rel = F.expr("substring(path, instr(path, __base) + length(__base) + 1)")
    out = found.withColumn("__base", base).withColumn("rel_path", F.regexp_replace(rel, "^/+", "")).drop("__base")
    out = out.withColumns({"name": paths.basename(F.col("rel_path")), "depth": paths.depth(F.col("rel_path"))})
    if not hidden:
        out = out.where(~F.exists(F.split("rel_path", "/"), lambda s: s.startswith(".")))
    if not junk:
        out = out.where(~paths.is_junk(F.col("rel_path")))
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def _named(rows: pd.DataFrame) -> pd.DataFrame:
    name = rows["path"].map(lambda p: p.rsplit("/", 1)[-1] if p is not None else None)
    return rows.assign(name=name, ext=name.map(lambda n: n.rsplit(".", 1)[1] if n and "." in n[1:] and not n.endswith(".") else "" if n is not None else None))


def entries(archives: DataFrame, with_payload: bool = False, key: str = "path", content: str = "content", salvage: bool = False) -> DataFrame:
    """A row for each entry of each archive; a broken archive is one row with an error.  salvage reads what headers are left."""
    columns = ["archive_id", *containers.FIELDS, "name", "ext", "error", *["payload"] * with_payload]

    def read(data: bytes, name: str) -> tuple[list[dict], str | None]:
        if not salvage:
            _, rows, error = containers.entries(data, with_payload, name)
            return rows, error
        if containers.kind_of(data) == "tar":
            return list(containers.salvage_tar(data)), None
        return list(containers.salvage_zip(data, with_payload)), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["key"], batch["content"], strict=True):
                rows, error = read(bytes(data), str(archive)) if data is not None else ([], "no content")
                made = pd.DataFrame([{c: r.get(c) for c in (*containers.FIELDS, "payload")} for r in rows or [{}]], dtype=object)
                yield _named(made).assign(archive_id=archive, error=error)[columns]

    schema = SCHEMA + ", payload binary" * with_payload
    return archives.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, schema)


def inspect(archives: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """What each file is by its bytes, with the name's hint."""
    return archives.select(key, signatures.sniff(F.col(content), F.col(key)).alias("s")).select(key, "s.*")


def compliance(archives: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """archive_id, format, severity, section, message and offset of every broken rule."""
    sniffed = archives.select(F.col(key).alias("key"), F.col(content).alias("content"), signatures.sniff(F.col(content)).format.alias("format"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, f, *issue) for k, c, f in zip(batch["key"], batch["content"], batch["format"], strict=True) for issue in containers.issues(bytes(c or b""), f)]
            yield pd.DataFrame(rows, columns=["archive_id", "format", "severity", "section", "message", "offset"]).astype({"offset": "Int64"})

    return sniffed.mapInPandas(run, "archive_id string, format string, severity string, section string, message string, offset long")


def pack(table: DataFrame, by: str, container: str = "zip", level: int = 6) -> DataFrame:
    """by and content: one archive for each group of (by, path, payload, mtime_epoch), entries in path order.

    An archive is made in one task: groups are archives, and have to fit one.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, b, None if pd.isna(m) else int(m)) for p, b, m in group.sort_values("path")[["path", "payload", "mtime_epoch"]].itertuples(index=False)]
        made = containers.pack_zip(rows, level) if container == "zip" else containers.pack_tar(rows, container.partition(".")[2])
        return pd.DataFrame({by: [group[by].iloc[0]], "content": [made]})

    return table.select(by, "path", "payload", "mtime_epoch").groupBy(by).applyInPandas(run, f"`{by}` {dict(table.dtypes)[by]}, content binary")


def join_volumes(files_with_content: DataFrame, volumes: DataFrame) -> DataFrame:
    """chain and content of every chain of volumes, in volume order (one task for each chain)."""
    both = volumes.join(files_with_content.select("path", "content"), "path")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chain": [group["chain"].iloc[0]], "content": [b"".join(group.sort_values("volume")["content"])]})

    return both.select("chain", "volume", "content").groupBy("chain").applyInPandas(run, "chain string, content binary")


def chunks(table: DataFrame, key: str, size: int, content: str = "content") -> DataFrame:
    """key, chunk, position and bytes of every payload, size bytes at a time."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(content) - 1, F.lit(0)), F.lit(size))
    return table.where(F.length(content) > 0).select(key, content, F.posexplode(starts).alias("chunk", "position")).select(key, "chunk", "position", F.substring(F.col(content), F.col("position") + 1, F.lit(size)).alias("bytes"))


# -- a data source with filters pushed down ------------------------------------------------------


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(path or glob)``: entries of archives on a file system that executors mount.

    A partition for each archive; filters on path, ext and method are applied before a row leaves Python.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], [f.name for f in schema.fields])


class _ArchiveReader(DataSourceReader):
    PUSHED = frozenset(("path", "ext", "method", "name"))

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            attribute = getattr(f, "attribute", ("",))
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and len(attribute) == 1 and attribute[0] in self.PUSHED:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = glob.glob(os.path.join(self.path, "**", "*"), recursive=True) if os.path.isdir(self.path) else glob.glob(self.path)
        return [_File(p) for p in sorted(found) if os.path.isfile(p)]

    def passes(self, row: dict) -> bool:
        for f in self.tests:
            value = row.get(f.attribute[0])
            good = value is not None and (value == f.value if isinstance(f, EqualTo) else value in f.value if isinstance(f, In) else value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value))
            if not good:
                return False
        return True

    def read(self, partition: _File) -> Iterator[tuple]:
        def shaped(row: dict, error: str | None) -> dict:
            name = None if row["path"] is None else row["path"].rsplit("/", 1)[-1]
            ext = None if name is None else name.rsplit(".", 1)[1] if "." in name[1:] and not name.endswith(".") else ""
            return row | {"archive_id": partition.value, "name": name, "ext": ext, "error": error}

        with open(partition.value, "rb") as file:
            try:
                for row in containers.file_entries(file, partition.value):
                    row = shaped(row, None)
                    if self.passes(row):
                        yield tuple(row.get(c) for c in self.columns)
            except containers.BROKEN as e:
                row = shaped({"path": None}, f"{type(e).__name__}: {e}")
                if self.passes(row):
                    yield tuple(row.get(c) for c in self.columns)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
