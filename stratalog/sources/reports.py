"""Benchmark files in, contracts and reports out."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_DDL = (
    "format string, dimensionName string, level int, isEncrypted boolean, toolName string, datasetSizeBytes long, archiveSizeBytes long, ownArchiveSizeBytes long, compressThroughputMBs double, extractThroughputMBs double, "
    "ownCompressMBs double, ownExtractMBs double, compressDurationSeconds double, extractDurationSeconds double, compressionRatioPercent double, ownCompressionRatioPercent double, compressSpeedupVsCompetitor double, extractSpeedupVsCompetitor double"
)


def benchmark_json(spark: SparkSession, path: str, own: str = "own") -> DataFrame:
    """Rows of a benchmark file that is a list of objects, or an object of named pairs (compress, extract in MB/s).

    own: what the names of the measured tool's fields start with in the file.
    """
    text = spark.read.text(path, wholetext=True)
    fields = [f.split(" ") for f in REPORT_DDL.split(", ")]
    as_list = F.from_json("value", "array<struct<" + ",".join(f"{own + n[3:] if n.startswith('own') else n}:{t}" for n, t in fields) + ">>")
    as_map = F.from_json("value", "map<string,array<double>>")
    parsed = text.select(F.ltrim("value").startswith("[").alias("is_list"), as_list.alias("l"), as_map.alias("m"))
    rows = parsed.where("is_list").select(F.inline("l")).toDF(*[n for n, _ in fields])
    pairs = parsed.where("not is_list").select(F.explode("m").alias("key", "v")).select(
        F.split_part("key", F.lit("|"), F.lit(1)).alias("format"), F.split_part("key", F.lit("|"), F.lit(2)).alias("dimensionName"), F.split_part("key", F.lit("|"), F.lit(3)).try_cast("int").alias("level"), (F.split_part("key", F.lit("|"), F.lit(4)) == "true").alias("isEncrypted"),
        F.try_element_at("v", F.lit(1)).alias("ownCompressMBs"), F.try_element_at("v", F.lit(2)).alias("ownExtractMBs"),
    )
    return rows.unionByName(pairs, allowMissingColumns=True)


#: Lines of benchmark logs: "name: 12.3 MB/s", "name ... 45.6 ms", "name: 1.2 M ops/s".
_RATES = (("mb_s", r"^\s*(.+?)\s*[:=]\s*([\d.]+)\s*MB/s"), ("ms", r"^\s*(.+?)\s*(?:\.{2,}|[:=])\s*([\d.]+)\s*ms\b"), ("mops_s", r"^\s*(.+?)\s*[:=]\s*([\d.]+)\s*M ops/s"))


def log_metrics(lines: DataFrame, value: str = "value") -> DataFrame:
    """metric, unit and number of every line that one of the patterns fits."""
    out: Column = F.lit(None)
    for unit, pattern in reversed(_RATES):
        row = F.struct(F.regexp_extract(value, pattern, 1).alias("metric"), F.lit(unit).alias("unit"), F.regexp_extract(value, pattern, 2).try_cast("double").alias("number"))
        out = F.when(F.col(value).rlike(pattern), row).otherwise(out)
    return lines.select(out.alias("m")).where("m.number is not null").select("m.*")


# -- contracts --------------------------------------------------------------------------------

#: Names of the JSON contracts, by column.
CONTRACTS = {
    "list": {"path": "path", "uncompressedSize": "uncompressed_size", "compressedSize": "compressed_size", "crc32": "crc32", "isDirectory": "is_directory", "isEncrypted": "is_encrypted", "mtime": "mtime_epoch"},
    "info": {"entries": "n_entries", "directories": "n_dirs", "totalUncompressed": "total_uncompressed", "totalCompressed": "total_compressed", "ratioPercent": "ratio_pct", "encrypted": "any_encrypted"},
    "diff": {"path": "path", "status": "status"},
    "hash": {"crc32": "crc32", "crc64": "crc64", "adler32": "adler32", "sha256": "sha256"},
    "check": {"files": "n_files", "verified": "n_verified", "corrupted": "n_corrupted", "status": "status"},
    "tree": {"path": "path", "name": "name", "depth": "depth", "isDirectory": "is_directory", "size": "total_uncompressed"},
}


def as_json(table: DataFrame, contract: str) -> DataFrame:
    """One JSON text a row, named as the contract has it."""
    names = CONTRACTS[contract]
    return table.select(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()]), {"ignoreNullFields": "false"}).alias("json"))


# -- reports ----------------------------------------------------------------------------------


def _rows(table: DataFrame, limit: int | None) -> tuple[list, bool]:
    """The rows of a report, and whether there are more than the limit that the caller set."""
    rows = table.collect() if limit is None else table.limit(limit + 1).collect()
    return rows[:limit], limit is not None and len(rows) > limit


#: What a report says where its caller limited it.
MORE = "further rows are left out"


def markdown(table: DataFrame, limit: int | None = None) -> str:
    rows, more = _rows(table, limit)
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows], *[f"\n{MORE}"] * more])


def as_html(table: DataFrame, title: str, limit: int | None = None) -> str:
    rows, more = _rows(table, limit)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>" + f"<p>{MORE}</p>" * more


def svg(points: DataFrame, width: int = 640, height: int = 400, limit: int | None = None) -> str:
    """A scatter plot of (codec, x, y, is_optimal)."""
    rows, more = _rows(points.select("codec", "x", "y", "is_optimal"), limit)
    if not rows:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
    xs, ys = [r.x for r in rows], [r.y for r in rows]
    place = lambda v, vs, size: 40 + (v - min(vs)) / ((max(vs) - min(vs)) or 1) * (size - 80)
    dots = "".join(f'<circle cx="{place(r.x, xs, width):.1f}" cy="{height - place(r.y, ys, height):.1f}" r="{5 if r.is_optimal else 3}" fill="{"#c22" if r.is_optimal else "#999"}"><title>{html.escape(str(r.codec))}</title></circle>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><rect width="100%" height="100%" fill="#fff"/>{dots}{f"<desc>{MORE}</desc>" * more}</svg>'


def bars(table: DataFrame, label: str, value: str, width: int = 40, limit: int | None = None) -> str:
    """A bar for each row, as text."""
    rows, more = _rows(table.select(label, value), limit)
    most = max((abs(r[1]) for r in rows), default=0) or 1
    return "\n".join([*[f"{str(r[0]):<24} {'█' * round(abs(r[1]) / most * width)} {r[1]:.2f}" for r in rows], *[MORE] * more])


# -- synthetic inputs ----------------------------------------------------------------------------


def corpus(spark: SparkSession, kind: str, rows: int, seed: int = 1) -> DataFrame:
    """id and payload of made-up files: zeros, text, xml, log or noise; the same for the same seed."""
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in ("archive", "entry", "block", "stream", "index", "volume", "header", "table")]), (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), k), F.lit(8)) + 1).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), word), " ")
    made = {
        "zeros": F.repeat(F.lit("\0"), 1024),
        "text": text,
        "xml": F.concat(F.lit("<items>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.concat(F.lit("<item>"), word(k), F.lit("</item>"))), ""), F.lit("</items>")),
        "log": F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.concat(F.lit("2024-01-01 INFO "), word(k))), "\n"),
    }
    if kind == "noise":
        payload = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), k.cast("string")), 256)), ""))
        return spark.range(rows).select("id", payload.alias("payload"))
    return spark.range(rows).select("id", made[kind].cast("binary").alias("payload"))
