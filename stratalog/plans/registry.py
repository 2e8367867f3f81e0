"""All queries over the shared tables by name, and their SQL for the ones that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions import dsl, fuzzy, globs, parity, paths, payload, signatures
from stratalog.operators import audit, bench, codecs, diff, search, security, tree, volumes
from stratalog.plans import catalog, oracles
from stratalog.sources import archives, reports
from stratalog.streaming import throttle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_PAGES = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, CAST(strlen(html) AS BIGINT) AS size FROM pages)"
_DOCS = """d AS (SELECT *, split_part(path, '/', 3) AS name, regexp_extract(split_part(path, '/', 3), '^.+\\.([^.]+)$', 1) AS ext FROM (
  SELECT doc_id, text, source, lang, n_chars AS size, CAST(floor(n_chars / 3) AS BIGINT) AS packed, 1700000000 + doc_id * 3600 AS mtime,
    lang || '/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.md' WHEN 'fr' THEN '.TXT' ELSE '' END AS path FROM documents))"""
NOW = 1_700_500_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").cast("binary").alias("payload"))


# -- filters ----------------------------------------------------------------------------------


@query("dsl_filter_ext_size", f"WITH {_DOCS} SELECT doc_id, path FROM d WHERE lower(ext) IN ('txt', 'rs') AND size > 2048")
def _(spark, sf_dir):
    return dsl.filter_entries(catalog.document_entries(spark, sf_dir), "ext:txt,rs AND size:>2KB").select(F.col("entry_idx").cast("long").alias("doc_id"), "path")


@query("dsl_filter_glob_or_not", f"WITH {_PAGES} SELECT page_id, path FROM p WHERE (regexp_matches(split_part(path, '/', -1), '(?i)^.*\\.html$') OR path ILIKE '%/de/%') AND NOT path ILIKE '%blog%'")
def _(spark, sf_dir):
    return dsl.filter_entries(catalog.page_entries(spark, sf_dir), "(name:*.html OR /de/) !blog").select(F.col("entry_idx").cast("long").alias("page_id"), "path")


@query("dsl_filter_modified", f"WITH {_DOCS} SELECT doc_id FROM d WHERE mtime >= {NOW} - 86400 * 3 AND NOT (mtime <= {NOW} - 86400 * 2 AND size != 100)")
def _(spark, sf_dir):
    return dsl.filter_entries(catalog.document_entries(spark, sf_dir), "modified:<3d AND NOT (mtime > 2d && size != 100)", now=NOW).select(F.col("entry_idx").cast("long").alias("doc_id"))


@query("dsl_filter_civil_date", "SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) >= epoch(TIMESTAMP '1995-06-01') AND o_totalprice > 150000")
def _(spark, sf_dir):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    orders = catalog.table(spark, sf_dir, "orders").select("o_orderkey", F.lit("x").alias("path"), F.col("o_totalprice").alias("uncompressed_size"), seconds.alias("mtime_epoch"))
    return dsl.filter_entries(orders, "date:>=1995-06-01 size > 150000").select("o_orderkey")


@query("path_include_exclude", f"WITH {_PAGES} SELECT page_id FROM p WHERE regexp_matches(path, '^[^/]*/(en|de)/[^/]*$') OR list_bool_or([regexp_matches(s, '^1.*$') FOR s IN string_split(path, '/')])")
def _(spark, sf_dir):
    keep = globs.path_filter(F.col("path"), include=["*/{en,de}/*", "1*"], exclude=["*"], no_vcs=True, no_junk=True)
    return catalog.page_entries(spark, sf_dir).where(keep).select(F.col("entry_idx").cast("long").alias("page_id"))


@query("path_exclude", f"WITH {_PAGES} SELECT page_id FROM p WHERE NOT list_bool_or([regexp_matches(s, '^.*\\.html$') FOR s IN string_split(path, '/')]) AND NOT regexp_matches(path, '^[^/]*/fr/.*$')")
def _(spark, sf_dir):
    return catalog.page_entries(spark, sf_dir).where(globs.path_filter(F.col("path"), exclude=["*.html", "*/fr/**"])).select(F.col("entry_idx").cast("long").alias("page_id"))


@query("junk_and_vcs", f"""WITH {_PAGES}, q AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN path || '/.git/HEAD' WHEN 1 THEN path || '/._x' WHEN 2 THEN '__MACOSX/' || path WHEN 3 THEN path || '/thumbs.db' ELSE path END AS path FROM p)
SELECT page_id, page_id % 5 = 0 AS vcs, page_id % 5 IN (1, 2) AS components, page_id % 5 IN (1, 2) AS substrings, page_id % 5 IN (1, 2, 3) AS entry, page_id % 5 = 1 AS reader FROM q""")
def _(spark, sf_dir):
    k = F.col("page_id") % 5
    path = F.when(k == 0, F.concat("path", F.lit("/.git/HEAD"))).when(k == 1, F.concat("path", F.lit("/._x"))).when(k == 2, F.concat(F.lit("__MACOSX/"), "path")).when(k == 3, F.concat("path", F.lit("/thumbs.db"))).otherwise(F.col("path"))
    rows = catalog.page_entries(spark, sf_dir).select(F.col("entry_idx").cast("long").alias("page_id"), "path").withColumn("path", path)
    return rows.select("page_id", paths.is_vcs(F.col("path")).alias("vcs"), *[paths.is_junk(F.col("path"), v).alias(v) for v in ("components", "substrings", "entry", "reader")])


# -- projections ------------------------------------------------------------------------------


@query("path_projection", f"""WITH {_PAGES} SELECT page_id, split_part(path, '/', -1) AS name, regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]+)$', 1) AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
 CAST(len([s FOR s IN string_split(path, '/') IF s != '']) AS INTEGER) AS depth, nullif(regexp_extract(path, '^(?:[^/]+/+){{2}}(.*)$', 1), '') AS stripped FROM p""")
def _(spark, sf_dir):
    path = F.col("path")
    return catalog.page_entries(spark, sf_dir).select(F.col("entry_idx").cast("long").alias("page_id"), paths.basename(path).alias("name"), paths.extension(path).alias("ext"), paths.parent(path).alias("parent"), paths.depth(path).alias("depth"), paths.strip_components(path, 2).alias("stripped"))


@query("size_and_mime", f"""WITH {_DOCS} SELECT doc_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.2f GB', size / 1073741824.0) END AS size_text,
 CASE lower(ext) WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime, round(packed * 100.0 / nullif(size, 0), 6) AS ratio FROM d""")
def _(spark, sf_dir):
    rows = catalog.document_entries(spark, sf_dir)
    return rows.select(F.col("entry_idx").cast("long").alias("doc_id"), paths.human_size(F.col("uncompressed_size"), trim=False).alias("size_text"), paths.mime(F.col("path")).alias("mime"), F.round(paths.compression_ratio(F.col("compressed_size"), F.col("uncompressed_size")), 6).alias("ratio"))


@query("container_and_filter", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'tar' WHEN 1 THEN 'tar' WHEN 2 THEN 'raw' WHEN 3 THEN '7z' WHEN 4 THEN 'zip' ELSE 'tar' END AS container,
 CASE p_partkey % 6 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zstd' WHEN 2 THEN 'xz' WHEN 5 THEN 'bzip2' ELSE 'none' END AS filter FROM part""")
def _(spark, sf_dir):
    ending = F.element_at(F.array(*[F.lit(e) for e in (".tgz", ".TAR.ZST", ".xz", ".7z", ".unknown", ".tar.bz2")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return catalog.table(spark, sf_dir, "part").select("p_partkey", paths.container_and_filter(F.concat("p_name", ending)).alias("c")).select("p_partkey", "c.*")


@query("dos_times", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) // 2 * 2 AS back FROM orders")
def _(spark, sf_dir):
    date, time = paths.epoch_to_dos(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    packed = catalog.table(spark, sf_dir, "orders").select("o_orderkey", date.alias("d"), time.alias("t"))
    return packed.select("o_orderkey", paths.dos_to_epoch(F.col("d"), F.col("t")).alias("back"))


@query("pax_times", "SELECT o_orderkey, o_orderkey AS secs, CAST((o_orderkey % 1000) * 1000000 AS INTEGER) AS nanos FROM orders")
def _(spark, sf_dir):
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit("."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    return catalog.table(spark, sf_dir, "orders").select("o_orderkey", paths.pax_time(text).alias("t")).select("o_orderkey", "t.*")


# -- trees and totals -------------------------------------------------------------------------


@query("tree_rollup", f"""WITH {_PAGES}, s AS (SELECT size, [x FOR x IN string_split(path, '/') IF x != ''] AS parts FROM p),
a AS (SELECT size, array_to_string(parts[1:k], '/') AS dir FROM (SELECT size, parts, unnest(range(0, len(parts))) AS k FROM s)),
t AS (SELECT dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_uncompressed FROM a GROUP BY dir),
u AS (SELECT dir, string_split(dir, '/') AS parts FROM t WHERE dir != ''),
n AS (SELECT dir, count(*) AS n_dirs FROM (SELECT array_to_string(parts[1:k], '/') AS dir FROM (SELECT parts, unnest(range(0, len(parts))) AS k FROM u)) GROUP BY dir)
SELECT t.dir, n_files, coalesce(n_dirs, 0) AS n_dirs, total_uncompressed, CAST(0 AS BIGINT) AS total_compressed FROM t LEFT JOIN n USING (dir)""")
def _(spark, sf_dir):
    return tree.rollup(catalog.page_entries(spark, sf_dir))


@query("archive_totals", f"""WITH {_DOCS} SELECT source AS archive_id, count(*) AS n_entries, CAST(0 AS BIGINT) AS n_dirs, CAST(sum(size) AS BIGINT) AS total_uncompressed, CAST(sum(packed) AS BIGINT) AS total_compressed,
 round(sum(packed) * 100.0 / sum(size), 6) AS ratio_pct, bool_or(doc_id % 7 = 0) AS any_encrypted FROM d GROUP BY source""")
def _(spark, sf_dir):
    return tree.totals(catalog.document_entries(spark, sf_dir), "archive_id").withColumn("ratio_pct", F.round("ratio_pct", 6))


@query("ext_composition", f"""WITH {_DOCS}, c AS (SELECT CASE WHEN ext = '' THEN 'other' ELSE lower(ext) END AS ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY 1)
SELECT ext, n, bytes, round(n * 100.0 / sum(n) OVER (), 6) AS share_pct, round(sum(n) OVER (ORDER BY n DESC, ext ROWS UNBOUNDED PRECEDING) * 360.0 / sum(n) OVER (), 6) AS end_angle FROM c""")
def _(spark, sf_dir):
    return tree.composition(catalog.document_entries(spark, sf_dir)).withColumns({"share_pct": F.round("share_pct", 6), "end_angle": F.round("end_angle", 6)})


@query("children_of", f"WITH {_DOCS} SELECT path, size AS total_uncompressed FROM d WHERE starts_with(path, 'en/src1/')")
def _(spark, sf_dir):
    return tree.children(tree.nodes(catalog.document_entries(spark, sf_dir)), "en/src1").select("path", "total_uncompressed")


@query("latest_by_path", "SELECT max(o_orderkey) AS entry_idx, CAST(o_custkey AS VARCHAR) AS path FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("entry_idx"))
    return tree.last_of_each_path(rows)


# -- orders and searches ----------------------------------------------------------------------


@query("sort_natural", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey % 10 DESC, p_partkey DESC) AS pos FROM part")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.format_string("part%d vol %d", F.col("p_partkey") % 10, "p_partkey").alias("name"), F.lit(False).alias("is_directory"), F.lit(None).cast("long").alias("mtime"), F.lit("").alias("kind"), F.col("p_partkey").alias("size"), F.col("p_name").alias("path"))
    return search.placed(search.ordered(rows, "name_desc").select("p_partkey", "p_name"))


@query("complete_topk", "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'small') ORDER BY p_name, 'part ' || p_partkey LIMIT 15")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").alias("name"), F.lit(False).alias("is_directory"), F.lit(False).alias("is_archive"), F.format_string("part %d", "p_partkey").alias("path"))
    return search.complete(rows, "Small").select("p_partkey", "p_name")


@query("substring_top50", f"WITH {_DOCS} SELECT path FROM d WHERE contains(lower(name), '12') ORDER BY path LIMIT 50")
def _(spark, sf_dir):
    return search.contains(catalog.with_names(catalog.document_entries(spark, sf_dir)), "12").select("path")


@query("deepest_first", f"WITH {_PAGES} SELECT path, CAST(len([s FOR s IN string_split(path, '/') IF s != '']) AS INTEGER) AS depth FROM p ORDER BY depth DESC, path DESC")
def _(spark, sf_dir):
    return tree.deepest_first(catalog.page_entries(spark, sf_dir).select("path", paths.depth(F.col("path")).alias("depth")))


@query("fuzzy_search", oracles.FUZZY)
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_name").alias("path"), F.col("p_name").alias("name"))
    return fuzzy.search(rows, "smwd").withColumn("places", F.array_join("places", ","))


# -- comparing and editing --------------------------------------------------------------------


def _halves(spark, sf_dir):
    orders = catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").cast("long").alias("uncompressed_size"), F.col("o_custkey").alias("crc32"), F.col("o_orderkey").alias("k"))
    return orders.where("k % 5 <> 0"), orders.where("k % 7 <> 0").withColumn("crc32", F.when(F.col("k") % 11 == 0, F.col("crc32") + 1).otherwise(F.col("crc32")))


@query("entry_diff", """SELECT CASE WHEN k % 7 = 0 THEN 'only_a' WHEN k % 5 = 0 THEN 'only_b' WHEN k % 11 = 0 THEN 'modified' ELSE 'same' END AS status, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) WHERE NOT (k % 5 = 0 AND k % 7 = 0) GROUP BY 1""")
def _(spark, sf_dir):
    return diff.diff_counts(*_halves(spark, sf_dir))


@query("manifest_diff", """WITH m AS (SELECT o_orderkey AS k FROM orders)
SELECT CAST(k AS VARCHAR) AS relative_path, 'missing' AS issue FROM m WHERE k % 10 = 0 AND k % 9 <> 0 UNION ALL SELECT CAST(k AS VARCHAR), 'extra' FROM m WHERE k % 9 = 0 AND k % 10 <> 0 UNION ALL
SELECT CAST(k AS VARCHAR), 'type' FROM m WHERE k % 9 <> 0 AND k % 10 <> 0 AND k % 8 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'size' FROM m WHERE k % 9 <> 0 AND k % 10 <> 0 AND k % 8 <> 0 AND k % 11 = 0 UNION ALL
SELECT CAST(k AS VARCHAR), 'sha256' FROM m WHERE k % 9 <> 0 AND k % 10 <> 0 AND k % 8 <> 0 AND k % 13 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'mode' FROM m WHERE k % 9 <> 0 AND k % 10 <> 0 AND k % 8 <> 0 AND k % 3 = 0""")
def _(spark, sf_dir):
    k = F.col("k")

    def manifest(changed: bool) -> DataFrame:
        change = lambda n, a, b: F.when((k % n == 0) & F.lit(changed), b).otherwise(a)
        return catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(
            "k", k.cast("string").alias("relative_path"), change(8, F.lit("regular"), F.lit("directory")).alias("entry_type"), change(11, k, k + 1).alias("byte_size"), change(13, F.lit("aa"), F.lit("bb")).alias("sha256"), change(3, F.lit(0o644), F.lit(0o755)).alias("posix_mode"), F.lit(None).cast("string").alias("symlink_target"),
        )

    return diff.compare_manifests(manifest(False).where(k % 10 != 0), manifest(True).where(k % 9 != 0))


@query("edit_merge", "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT -o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 100 = 1")
def _(spark, sf_dir):
    orders = catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("v"))
    doubled = orders.withColumn("v", F.col("v") * 2)
    return diff.edited(orders, orders.where("path % 3 = 0"), doubled.where("path % 3 = 1").unionByName(doubled.where("path % 100 = 1").withColumn("path", -F.col("path"))))


@query("edit_effects", """SELECT 'deleted' AS action, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'not_found', count(*) FROM orders WHERE o_orderkey % 50 = 1 UNION ALL
SELECT 'replaced', count(*) FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT 'appended', count(*) FROM orders WHERE o_orderkey % 40 = 1""")
def _(spark, sf_dir):
    orders = catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    unknown = lambda n: orders.where(f"path % {n} = 1").select((-F.col("path") - 1).alias("path"))
    return diff.edit_effects(orders, orders.where("path % 3 = 0").union(unknown(50)), orders.where("path % 4 = 1").union(unknown(40)))


@query("update_candidates", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 4 = 0")
def _(spark, sf_dir):
    known = catalog.document_entries(spark, sf_dir).select("path", "mtime_epoch", "crc32", F.col("entry_idx").alias("i"))
    newer = known.withColumns({"mtime_epoch": F.col("mtime_epoch") + F.when(F.col("i") % 3 == 0, 5).otherwise(0), "crc32": F.when(F.col("i") % 5 == 0, F.col("crc32") + 1).otherwise(F.col("crc32"))})
    return diff.only_changed(newer, known.where("i % 4 <> 0")).select(F.col("i").cast("long").alias("doc_id"))


@query("key_sets", "SELECT 'shared' AS what, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'missing', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def _(spark, sf_dir):
    a = catalog.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = catalog.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(diff.shared_keys(a, b, "k"), "shared").union(count(diff.missing_keys(a, b, "k"), "missing"))


# -- payloads ---------------------------------------------------------------------------------


@query("hash_digests", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", F.md5("payload").alias("md5"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"))


@query("checksums", oracles.CHECKSUMS)
def _(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", payload.crc32(F.col("payload")).alias("crc32"), payload.crc64(F.col("payload")).alias("crc64"), payload.adler32(F.col("payload")).alias("adler32"))


@query("entropy_chars", "SELECT doc_id, round(entropy(c), 6) AS entropy FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY doc_id")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "documents").where("text <> ''")
    return rows.select("doc_id", F.round(payload.text_entropy(F.col("text")), 6).alias("entropy"))


_BYTES = "b AS (SELECT doc_id, lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents)"


@query("entropy_bytes", f"WITH {_BYTES}, c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id) SELECT doc_id, round(greatest(0, -sum(n / total * log2(n / total))), 6) AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id")
def _(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", F.round(payload.entropy("payload"), 6).alias("entropy")).where("entropy is not null")


@query("language_entropy", f"WITH {_BYTES}, c AS (SELECT lang, byte, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang) SELECT lang, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM c JOIN t USING (lang) GROUP BY lang")
def _(spark, sf_dir):
    return audit.entropies(audit.byte_counts(_payloads(spark, sf_dir), "lang"), "lang").withColumn("entropy", F.round("entropy", 6))


@query("byte_divergence", f"WITH {_BYTES}, c AS (SELECT lang, byte, count(*) AS n FROM b WHERE lang IN ('en', 'de') GROUP BY ALL), s AS (SELECT lang, byte, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT round(sum(abs(d)) / 2, 6) AS divergence FROM (SELECT byte, sum(CASE WHEN lang = 'en' THEN p ELSE -p END) AS d FROM s GROUP BY byte)")
def _(spark, sf_dir):
    return audit.divergence(audit.byte_counts(_payloads(spark, sf_dir), "lang"), "lang", "en", "de").withColumn("divergence", F.round("divergence", 6))


@query("segment_audit", """WITH s AS (SELECT doc_id, k, substring(text, k * 4096 + 1, 4096) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 4095) // 4096)) AS k FROM documents WHERE text <> ''))
SELECT doc_id, CAST(k AS INTEGER) AS segment, k * 4096 AS "offset", CAST(any_value(length(piece)) AS INTEGER) AS length, round(entropy(c), 5) AS entropy FROM (SELECT *, unnest(string_split(piece, '')) AS c FROM s) GROUP BY doc_id, k""")
def _(spark, sf_dir):
    return audit.text_segments(catalog.table(spark, sf_dir, "documents"), "doc_id", "text", 4096).withColumn("entropy", F.round("entropy", 5))


@query("segment_bytes", oracles.SEGMENTS)
def _(spark, sf_dir):
    return audit.segment_summary(audit.segments(_payloads(spark, sf_dir), "doc_id", size=4096), "doc_id").withColumn("mean_entropy", F.round("mean_entropy", 6))


@query("recommend_codec")
def _(spark, sf_dir):
    kind = payload.scenario(F.when(F.col("doc_id") % 3 == 0, "LAN").when(F.col("doc_id") % 3 == 1, "cold backup").otherwise("daily"))
    return audit.recommendations(_payloads(spark, sf_dir), "doc_id", kind)


@query("sniff_signature", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zip' WHEN 2 THEN 'zstd' ELSE 'unknown' END AS format, CASE WHEN page_id % 4 = 0 THEN 'tar.gzip' END AS compound, CASE WHEN page_id % 4 = 3 THEN 0 ELSE 100 END AS confidence FROM pages""")
def _(spark, sf_dir):
    magic = F.element_at(F.array(*[F.lit(m) for m in ("1F8B", "504B0304", "28B52FFD", "")]), (F.col("page_id") % 4 + 1).cast("int"))
    rows = catalog.table(spark, sf_dir, "pages").select("page_id", F.concat(F.unhex(magic), F.col("html").cast("binary")).alias("content"))
    return rows.select("page_id", signatures.sniff(F.col("content"), F.lit("x.TGZ")).alias("s")).select("page_id", "s.format", "s.compound", "s.confidence")


@query("charset")
def _(spark, sf_dir):
    raw = F.when(F.col("lang") == "fr", F.encode("text", "UTF-16LE")).otherwise(F.col("text").cast("binary"))
    return catalog.table(spark, sf_dir, "documents").select("doc_id", payload.charset(raw).alias("charset"))


@query("byte_chunks", """SELECT page_id AS path, CAST(k AS INTEGER) AS chunk, CAST(k * 1000 AS INTEGER) AS position, CAST(least(1000, n - k * 1000) AS INTEGER) AS size FROM (SELECT page_id, n, unnest(range(0, (n + 999) // 1000)) AS k FROM (SELECT page_id, strlen(html) AS n FROM pages))""")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    return archives.chunks(rows, "path", 1000).select("path", "chunk", "position", F.length("bytes").alias("size"))


# -- archives ---------------------------------------------------------------------------------


def _packed(spark, sf_dir, container, level=6):
    rows = catalog.table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", (F.col("doc_id") % 50).cast("string")).alias("archive_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("payload"), (F.col("doc_id") * 2 + 1_600_000_000).alias("mtime_epoch"))
    return archives.pack(rows, "archive_id", container, level).withColumnRenamed("archive_id", "path")


_BACK = "SELECT source || '-' || (doc_id % 50) AS archive_id, 'd/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS uncompressed_size, doc_id * 2 + 1600000000 AS mtime_epoch, sha256(text) AS sha256, 'txt' AS ext FROM documents"


@query("zip_round_trip", _BACK)
def _(spark, sf_dir):
    return archives.entries(_packed(spark, sf_dir, "zip"), with_payload=True).select("archive_id", "path", "uncompressed_size", "mtime_epoch", F.sha2("payload", 256).alias("sha256"), "ext")


@query("tar_round_trip", _BACK)
def _(spark, sf_dir):
    return archives.entries(_packed(spark, sf_dir, "tar.gz"), with_payload=True).select("archive_id", "path", "uncompressed_size", "mtime_epoch", F.sha2("payload", 256).alias("sha256"), "ext")


@query("zip_integrity", "SELECT count(*) AS n_files, count(*) AS n_verified, CAST(0 AS BIGINT) AS n_corrupted, CAST(sum(strlen(text)) AS BIGINT) AS bytes_read, 'PASSED' AS status FROM documents")
def _(spark, sf_dir):
    return security.integrity(archives.entries(_packed(spark, sf_dir, "zip"), with_payload=True))


@query("zip_salvage", "SELECT 'd/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    cut = _packed(spark, sf_dir, "zip").withColumn("content", F.substring("content", 1, F.length("content") - 22))
    return archives.entries(cut, with_payload=True, salvage=True).select("path", F.sha2("payload", 256).alias("sha256"))


@query("zip_compliance", "SELECT CAST(count(DISTINCT source || '-' || (doc_id % 50)) AS BIGINT) AS n, 'end record' AS section, 'ERROR' AS severity FROM documents")
def _(spark, sf_dir):
    broken = _packed(spark, sf_dir, "zip").withColumn("content", F.substring("content", 1, F.length("content") - 22))
    return archives.compliance(broken).groupBy("section", "severity").agg(F.count("*").alias("n"))


@query("volume_chains", """SELECT scheme, CAST(count(*) AS BIGINT) AS n_volumes, CAST(sum(size) AS BIGINT) AS total_size FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'numbered' ELSE 'part' END AS scheme, s_suppkey * 10 AS size FROM supplier, range(3)) GROUP BY scheme""")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.format_string("d/a%d.zip.%03d", "s_suppkey", "k")).otherwise(F.format_string("d/a%d.part%d.rar", "s_suppkey", "k"))
    found = volumes.chain_sizes(volumes.chains(rows.select(name.alias("path"), (F.col("s_suppkey") * 10).alias("size"))))
    return found.groupBy("scheme").agg(F.sum("n_volumes").alias("n_volumes"), F.sum("total_size").alias("total_size"))


@query("split_plan", """SELECT CAST(page_id AS VARCHAR) || '.zip' AS name, CAST(k AS INTEGER) AS volume, page_id || '.zip.' || lpad(CAST(k AS VARCHAR), 3, '0') AS path, (k - 1) * 1000 AS start, least(1000, size - (k - 1) * 1000) AS length FROM (SELECT page_id, size, unnest(range(1, greatest(1, (size + 999) // 1000) + 1)) AS k FROM (SELECT page_id, CAST(strlen(html) AS BIGINT) AS size FROM pages))""")
def _(spark, sf_dir):
    rows = catalog.page_entries(spark, sf_dir).select(F.concat(F.col("entry_idx").cast("string"), F.lit(".zip")).alias("name"), F.col("uncompressed_size").alias("size"))
    return volumes.split_plan(rows, 1000)


@query("store_offsets", f"WITH {_PAGES} SELECT page_id, CAST(coalesce(sum(size + strlen(path) + 30) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM p")
def _(spark, sf_dir):
    rows = catalog.page_entries(spark, sf_dir)
    return volumes.offsets(rows, "archive_id", "entry_idx", F.col("uncompressed_size"), volumes.local_header(F.col("path"))).select(F.col("entry_idx").cast("long").alias("page_id"), "offset")


@query("parity_round_trip", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    rows = _payloads(spark, sf_dir)
    middle = F.greatest(F.lit(1), (F.length("payload") / 2).cast("int"))
    hurt = F.concat(F.substring(F.col("payload"), F.lit(1), middle), F.when(F.length("payload") > middle, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))), F.substring(F.col("payload"), middle + 2, F.length("payload")))
    return parity.repaired(rows.withColumn("payload", hurt), parity.recovery_records(rows, "doc_id"), "doc_id").select("doc_id", F.sha2("payload", 256).alias("sha256"))


_CONFIGS = ", ".join(f"('{name}', {level})" for name, level in codecs.CONFIGS)


@query("codec_matrix", f"SELECT codec, level, CAST(sum(strlen(text)) AS BIGINT) AS original, true AS round_trip FROM documents, (VALUES {_CONFIGS}) AS c(codec, level) WHERE text <> '' GROUP BY codec, level")  # all configurations
def _(spark, sf_dir):
    rows = _payloads(spark, sf_dir)
    return codecs.matrix_points(codecs.matrix(codecs.copies(rows), "copies", sized=rows), "copies").select("codec", "level", "original", "round_trip")


# -- safety -----------------------------------------------------------------------------------


@query("security_risk", """WITH e AS (SELECT source, doc_id, CASE WHEN doc_id % 97 = 0 THEN '../' ELSE '' END || doc_id || CASE WHEN doc_id % 53 = 0 THEN '.exe' ELSE '.txt' END AS path, doc_id % 97 = 0 AS t, doc_id % 53 = 0 AS x FROM documents)
SELECT source, CASE WHEN bool_or(t) THEN 'CRITICAL' WHEN bool_or(x) THEN 'WARNING' ELSE 'SAFE' END AS level, count(*) FILTER (t) AS n_traversal, CAST(0 AS BIGINT) AS n_bombs, count(*) FILTER (t OR x) AS n_suspicious FROM e GROUP BY source""")
def _(spark, sf_dir):
    k = F.col("doc_id")
    path = F.concat(F.when(k % 97 == 0, "../").otherwise(""), k.cast("string"), F.when(k % 53 == 0, ".exe").otherwise(".txt"))
    rows = catalog.table(spark, sf_dir, "documents").select("source", path.alias("path"), F.col("n_chars").alias("uncompressed_size"), F.col("n_chars").alias("compressed_size"))
    return security.risk(rows, "source")


@query("path_sanitize", """WITH r AS (SELECT page_id, page_id % 7 AS k, array_to_string([x FOR x IN string_split(replace(url, '://', '/'), '/') IF x != ''], '/') AS p FROM pages)
SELECT page_id, CASE k WHEN 1 THEN 'C:/' || p WHEN 2 THEN p || '/CON.txt' WHEN 3 THEN p || '/y' WHEN 4 THEN 'srv/share/' || p WHEN 5 THEN p || '/f.txt' ELSE p END AS path, k = 0 AS traversal, k IN (1, 4) AS absolute, k = 4 AS unc,
 length(CASE k WHEN 1 THEN 'C:/' || p WHEN 2 THEN p || '/CON.txt' WHEN 3 THEN p || '/y' WHEN 4 THEN 'srv/share/' || p WHEN 5 THEN p || '/f.txt' ELSE p END) > 260 AS long, k = 2 AS device, CASE k WHEN 5 THEN ':ads' ELSE ':' END AS stream FROM r""")
def _(spark, sf_dir):
    k = F.col("page_id") % 7
    tail = F.regexp_replace("url", "://", "/")
    raw = (
        F.when(k == 0, F.concat(F.lit("../"), "url")).when(k == 1, F.concat(F.lit("C:\\"), "url")).when(k == 2, F.concat("url", F.lit("/CON.txt"))).when(k == 3, F.concat("url", F.lit("/x/../y")))
        .when(k == 4, F.concat(F.lit("\\\\srv\\share\\"), "url")).when(k == 5, F.concat(tail, F.lit("/f.txt:ads"))).otherwise(F.concat("url", F.lit("/./")))
    )
    return catalog.table(spark, sf_dir, "pages").select("page_id", payload.sanitize(raw).alias("s")).select("page_id", "s.*")


@query("extractable", "SELECT page_id, page_id % 5 >= 3 AS good FROM pages")
def _(spark, sf_dir):
    k = F.col("page_id")
    tail = F.regexp_replace("url", "^[a-z]+://", "")
    raw = F.when(k % 5 == 0, F.concat(F.lit("a/../"), tail)).when(k % 5 == 1, F.concat(F.lit("/"), tail)).when(k % 5 == 2, F.col("url")).otherwise(tail)
    return catalog.table(spark, sf_dir, "pages").select("page_id", paths.is_extractable(raw).alias("good"))


@query("root_layout", f"WITH {_PAGES} SELECT split_part(path, '/', 1) AS host, count(DISTINCT split_part(path, '/', 2)) AS n_roots, CASE WHEN count(DISTINCT split_part(path, '/', 2)) = 1 THEN 'direct' ELSE 'wrap' END AS mode, CASE WHEN count(DISTINCT split_part(path, '/', 2)) = 1 THEN max(split_part(path, '/', 2)) END AS single_root FROM p GROUP BY 1")
def _(spark, sf_dir):
    rows = catalog.page_entries(spark, sf_dir).select(F.col("archive_id").alias("host"), paths.strip_components(F.col("path"), 1).alias("path"))
    return security.root_layout(rows, "host")


# -- statistics -------------------------------------------------------------------------------


@query("pareto_front", "SELECT p_partkey, coalesce(y > m + 1e-7, true) AS is_optimal FROM (SELECT p_partkey, p_size AS y, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM part)")
def _(spark, sf_dir):
    points = catalog.table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("x"), F.col("p_size").alias("y"))
    return bench.pareto(points, "p_brand").select("p_partkey", "is_optimal")


def _points(spark, sf_dir):
    return catalog.table(spark, sf_dir, "part").select(F.col("p_brand").alias("suite"), F.col("p_partkey").cast("string").alias("codec"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


@query("pareto_tiers", oracles.TIERS)
def _(spark, sf_dir):
    return bench.tiers(_points(spark, sf_dir), "suite")


@query("monotone_spline", oracles.SPLINE)
def _(spark, sf_dir):
    return bench.interpolated(_points(spark, sf_dir), "suite").withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


_WELCH = """WITH a AS (SELECT l_linestatus AS metric, avg(l_tax) AS m, stddev_samp(l_tax) AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linestatus AS metric, avg(l_tax) AS m, stddev_samp(l_tax) AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT metric, round((b.m - a.m) / sqrt(a.s * a.s / a.n + b.s * b.s / b.n), 6) AS t, round(power(a.s * a.s / a.n + b.s * b.s / b.n, 2) / (power(a.s * a.s / a.n, 2) / (a.n - 1) + power(b.s * b.s / b.n, 2) / (b.n - 1)), 3) AS df, round((b.m - a.m) / a.m * 100, 6) AS delta_pct FROM a JOIN b USING (metric)"""


def _sides(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("metric"), "l_returnflag", "l_tax")
    return rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'")


@query("ab_test", _WELCH)
def _(spark, sf_dir):
    return bench.welch(*_sides(spark, sf_dir), "metric", "l_tax", with_p=False).select("metric", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("delta_pct", 6).alias("delta_pct"))


@query("ab_verdict", oracles.VERDICT)
def _(spark, sf_dir):
    return bench.welch(*_sides(spark, sf_dir), "metric", "l_tax").select("metric", F.round("p", 6).alias("p"), "verdict")


@query("regression_audit", """WITH w AS (SELECT o_orderpriority AS k, o_orderstatus AS s, avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS b, avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1995-01-01') AS a FROM orders GROUP BY ALL), r AS (SELECT k, s, b, a, CASE WHEN b > 0 THEN (a - b) / b * 100 END AS c FROM w WHERE a IS NOT NULL)
SELECT k, s, 'price' AS measure, round(c, 6) AS change_pct, CASE WHEN c IS NULL THEN 'NO_BASELINE' WHEN c > 3 THEN 'GAIN' WHEN c < -10 THEN 'CRITICAL' WHEN c < -3 THEN 'WARNING' ELSE 'FLAT' END AS verdict FROM r""")
def _(spark, sf_dir):
    orders = catalog.table(spark, sf_dir, "orders")
    side = lambda where: orders.where(where).groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.avg("o_totalprice").alias("price"))
    found = bench.audit(side("o_orderdate >= timestamp_ntz'1995-01-01'"), side("o_orderdate < timestamp_ntz'1995-01-01'"), ("k", "s"), ("price",))
    return found.select("k", "s", "measure", F.round("change_pct", 6).alias("change_pct"), "verdict")


@query("matrix_summary", "SELECT count(*) AS n_points, max(l_quantity) AS peak_compress_mbs, max(l_extendedprice) AS peak_decompress_mbs, round(max(greatest(0, (1 - l_discount) * 100)), 6) AS max_savings_pct, count(*) FILTER (l_tax = 0) AS n_optimal, count(*) >= 50 AND count(*) FILTER (l_tax = 0) > 0 AS passed FROM lineitem")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("compress_mbs"), F.col("l_extendedprice").alias("decompress_mbs"), F.lit(1.0).alias("original"), F.col("l_discount").alias("compressed"), (F.col("l_tax") == 0).alias("is_optimal"))
    return bench.matrix_summary(rows).withColumn("max_savings_pct", F.round("max_savings_pct", 6))


@query("log_metrics", "SELECT 'step ' || s_suppkey AS metric, 'mb_s' AS unit, CAST(s_suppkey AS DOUBLE) AS number FROM supplier")
def _(spark, sf_dir):
    return reports.log_metrics(catalog.table(spark, sf_dir, "supplier").select(F.explode(F.array(F.format_string("step %d: %d.0 MB/s", "s_suppkey", "s_suppkey"), F.lit("nothing here"))).alias("value")))


@query("json_contract", "SELECT n_nationkey AS k, '{\"path\":\"' || n_name || '\",\"status\":\"same\"}' AS json FROM nation")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("path"), F.lit("same").alias("status"))
    names = reports.CONTRACTS["diff"]
    return rows.select(F.col("n_nationkey").alias("k"), F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()])).alias("json"))


@query("throttle", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
g(user_id, event_id, us, k) AS (SELECT user_id, event_id, us, k FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.us, e.k FROM g JOIN e ON e.user_id = g.user_id AND e.k = (SELECT min(f.k) FROM e f WHERE f.user_id = g.user_id AND f.us >= g.us + 86400000000))
SELECT user_id, event_id FROM g""")
def _(spark, sf_dir):
    events = catalog.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return throttle.throttle(events, "user_id", "ts", interval=86_400_000_000).select("user_id", "event_id")


from stratalog.plans import registry_more  # noqa: E402, F401 - it registers its queries
