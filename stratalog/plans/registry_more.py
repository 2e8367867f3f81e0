"""Queries of the rest of the inventory, each on an input on which a wrong implementation differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import dsl, paths, payload, signatures
from stratalog.operators import bench, diff, mutations, search, security, tree, volumes
from stratalog.plans import catalog, commands
from stratalog.plans.registry import _DOCS, _PAGES, _packed, _payloads, query
from stratalog.sources import archives, containers, reports
from stratalog.streaming import ingest


def _pick(values: list[str], k: Column) -> Column:
    """The value at a place counted from 0, in a ring."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def _sql_rows(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


# -- names and numbers ------------------------------------------------------------------------

#: Endings and what the catalogue calls them.
_KINDS = [
    ("a.tar.gz", "tar", "gzip"), ("a.TGZ", "tar", "gzip"), ("a.tar.bz2", "tar", "bzip2"), ("a.tbz2", "tar", "bzip2"), ("a.tbz", "tar", "bzip2"), ("a.tar.xz", "tar", "xz"), ("a.txz", "tar", "xz"),
    ("a.tar.zst", "tar", "zstd"), ("a.tzst", "tar", "zstd"), ("a.tar.lz4", "tar", "lz4"), ("a.tar.br", "tar", "brotli"), ("a.tar.lz", "tar", "lzip"), ("a.zipx", "zip", "none"), ("a.7z", "7z", "none"),
    ("a.tar", "tar", "none"), ("a.cpio", "cpio", "none"), ("a.ar", "ar", "none"), ("a.iso", "iso", "none"), ("a.wim", "wim", "none"), ("a.gz", "raw", "gzip"), ("a.lz4", "raw", "lz4"), ("a.br", "raw", "brotli"), ("a", "zip", "none"),
]
_MIMES = [("a.swift", "text/x-swift"), ("b.JS", "application/javascript"), ("c.json", "application/json"), ("d.html", "text/html"), ("e.png", "image/png"), ("f.jpeg", "image/jpeg"), ("g.svg", "image/svg+xml"), ("h.pdf", "application/pdf"), ("i.7z", "application/x-7z-compressed"), ("j.gz", "application/gzip"), ("k.cpp", "text/x-c++"), ("l.h", "text/x-chdr"), ("m.rs", "text/x-rust"), ("n.mov", "video/quicktime"), ("o.", "application/octet-stream"), (".md", "application/octet-stream"), ("p.tar.zst", "application/zstd")]


@query("kinds_by_ending", f"SELECT p_partkey, p_name || '/' || ending AS path, container, filter FROM part JOIN {_sql_rows([(i, *r) for i, r in enumerate(_KINDS)], 'i, ending, container, filter')} ON p_partkey % {len(_KINDS)} = i")
def _(spark, sf_dir):
    path = F.concat_ws("/", "p_name", _pick([e for e, _, _ in _KINDS], F.col("p_partkey")))
    return catalog.table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), paths.container_and_filter(path).alias("c")).select("p_partkey", "path", "c.*")


@query("mime_types", f"SELECT p_partkey, mime FROM part JOIN {_sql_rows([(i, *r) for i, r in enumerate(_MIMES)], 'i, name, mime')} ON p_partkey % {len(_MIMES)} = i")
def _(spark, sf_dir):
    return catalog.table(spark, sf_dir, "part").select("p_partkey", paths.mime(F.concat(F.lit("d.txt/"), _pick([n for n, _ in _MIMES], F.col("p_partkey")))).alias("mime"))


_SIZE = "CAST(o_orderkey * 7919 + power(2, o_orderkey % 41) AS BIGINT)"
_UNIT = "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {0} WHEN n < 1073741824 THEN {1} ELSE printf('%.2f GB', n / 1073741824.0) END"


def _trimmed(unit: int, name: str) -> str:
    v = f"(n / {unit}.0)"
    return f"CASE WHEN round(({v} - floor{v}) * 10) = 0 THEN printf('%.0f {name}', {v}) ELSE printf('%.1f {name}', {v}) END"


@query("human_sizes", f"SELECT o_orderkey, {_UNIT.format(_trimmed(1024, 'KB'), _trimmed(1048576, 'MB'))} AS short, {_UNIT.format(*[f'''printf('%.1f {u}', n / {d}.0)''' for u, d in (('KB', 1024), ('MB', 1048576))])} AS long FROM (SELECT o_orderkey, {_SIZE} AS n FROM orders)")
def _(spark, sf_dir):
    size = (F.col("o_orderkey") * 7919 + F.pow(F.lit(2.0), F.col("o_orderkey") % 41)).cast("long")
    return catalog.table(spark, sf_dir, "orders").select("o_orderkey", paths.human_size(size).alias("short"), paths.human_size(size, trim=False).alias("long"))


@query("pax_fractions", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN -o_orderkey WHEN 2 THEN o_orderkey WHEN 3 THEN o_orderkey END AS secs,
 CAST(CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 500000000 WHEN 2 THEN 123456789 WHEN 3 THEN 0 END AS INTEGER) AS nanos FROM orders""")
def _(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 6 == 0, k).when(F.col("o_orderkey") % 6 == 1, F.concat(F.lit("-"), k, F.lit(".5"))).when(F.col("o_orderkey") % 6 == 2, F.concat(k, F.lit(".1234567899"))).when(F.col("o_orderkey") % 6 == 3, F.concat(k, F.lit("."))).when(F.col("o_orderkey") % 6 == 4, F.concat(k, F.lit("s"))).otherwise(F.lit(""))
    return catalog.table(spark, sf_dir, "orders").select("o_orderkey", paths.pax_time(text).alias("t")).select("o_orderkey", "t.*")


@query("completion_parts", f"WITH {_PAGES} SELECT page_id, regexp_extract(path, '^(.*/)?', 0) AS folder, split_part(path, '/', -1) AS typed FROM p")
def _(spark, sf_dir):
    folder, typed = paths.completion_parts(F.col("path"))
    return catalog.page_entries(spark, sf_dir).select(F.col("entry_idx").cast("long").alias("page_id"), folder.alias("folder"), typed.alias("typed"))


@query("normalised_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/b/' || page_id WHEN 1 THEN 'x/' || page_id WHEN 2 THEN page_id || '/d' ELSE '/' END AS path, CASE WHEN page_id % 4 = 3 THEN '/home/u/x' ELSE '/home/u' END AS home FROM pages")
def _(spark, sf_dir):
    k = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("./a\\b\\"), k, F.lit("/"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("././x//"), k)).when(F.col("page_id") % 4 == 2, F.concat(k, F.lit("\\\\d//"))).otherwise(F.lit("/"))
    return catalog.table(spark, sf_dir, "pages").select("page_id", paths.normalised(raw).alias("path"), paths.expand_home(F.when(F.col("page_id") % 4 == 3, "~/x").otherwise("~"), "/home/u").alias("home"))


@query("free_names", """WITH w AS (SELECT DISTINCT p_brand AS name, CAST(substr(p_brand, 7) AS INTEGER) AS b FROM part)
SELECT name, CASE WHEN b % 4 = 0 THEN name WHEN b % 4 = 1 THEN name || ' 2' WHEN b % 4 = 2 THEN name || ' 4' ELSE name || ' 3' END AS free FROM w""")
def _(spark, sf_dir):
    names = catalog.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"))
    b = F.substring("name", 7, 9).cast("int") % 4
    # taken: nothing or a gap's far side; the name; the name and 2 and 3 and 5; the name and 2 and 02 and 4
    numbers = F.when(b == 0, F.array(F.lit(" 2"))).when(b == 1, F.array(F.lit(""), F.lit(" 3"))).when(b == 2, F.array(F.lit(""), F.lit(" 2"), F.lit(" 3"), F.lit(" 5"))).otherwise(F.array(F.lit(""), F.lit(" 2"), F.lit(" 02"), F.lit(" 4")))
    taken = names.distinct().select(F.explode(F.transform(numbers, lambda n: F.concat("name", n))).alias("name"))
    return security.free_names(names, taken)


# -- the filter language ----------------------------------------------------------------------

#: Queries, what the parser makes of them, and whether they had to be read as one pattern.
_CANONICAL = [
    ("ext:txt AND size:<5000", "(ext:txt AND size:<5000)", True),
    ("ext:swift,rs OR NOT name:*.md", "(ext:swift,rs OR NOT (name:*.md))", True),
    ("", "[MATCH_ALL]", True),
    ("a b", "(name:a AND name:b)", True),
    ("(", "name:(", False),
    ("size:>1KB", "size:>1024", True),
]


@query("dsl_canonical", f"SELECT query, canonical, parsed FROM {_sql_rows(_CANONICAL, 'query, canonical, parsed')}")
def _(spark, sf_dir):
    rows = [(q, str(tree_), warning is None) for q, _, _ in _CANONICAL for tree_, warning in [dsl.parse_leniently(q)]]
    return spark.createDataFrame(rows, "query string, canonical string, parsed boolean")


@query("dsl_lenient", f"WITH {_PAGES} SELECT page_id FROM p WHERE contains(lower(path), '(blog')")
def _(spark, sf_dir):
    return dsl.filter_entries(catalog.page_entries(spark, sf_dir), "(blog").select(F.col("entry_idx").cast("long").alias("page_id"))


@query("dsl_options", f"""WITH {_PAGES}, q AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN path || '/.git/HEAD' WHEN 1 THEN path || '/._x' WHEN 2 THEN '__MACOSX/' || path ELSE path END AS path FROM p)
SELECT page_id FROM q WHERE page_id % 5 > 2 AND NOT contains(path, 'blog.') AND NOT contains(path, '/fr/')""")
def _(spark, sf_dir):
    k = F.col("entry_idx") % 5
    path = F.when(k == 0, F.concat("path", F.lit("/.git/HEAD"))).when(k == 1, F.concat("path", F.lit("/._x"))).when(k == 2, F.concat(F.lit("__MACOSX/"), "path")).otherwise(F.col("path"))
    return dsl.filter_entries(catalog.page_entries(spark, sf_dir).withColumn("path", path), "", no_junk=True, no_vcs=True, ignore=("blog.", "/fr/")).select(F.col("entry_idx").cast("long").alias("page_id"))


# -- orders -----------------------------------------------------------------------------------

_PARTS = "SELECT p_partkey, p_partkey % 4 = 0 AS d, p_partkey % 10 AS a, p_partkey AS b, p_size AS s, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 7 % 101 END AS m, lower(p_brand) AS k FROM part"
_MODES = {"name_asc": "a, b", "name_desc": "a DESC, b DESC", "size_asc": "s", "size_desc": "s DESC", "date_asc": "m NULLS LAST", "date_desc": "m DESC NULLS LAST", "kind": "k"}


@query("sort_modes", " UNION ALL ".join(f"SELECT '{mode}' AS mode, p_partkey, row_number() OVER (ORDER BY d DESC, {order}, a, b) AS pos FROM ({_PARTS})" for mode, order in _MODES.items()))
def _(spark, sf_dir):
    key = F.col("p_partkey")
    rows = catalog.table(spark, sf_dir, "part").select("p_partkey", F.format_string("Vol%d part %d", key % 10, key).alias("name"), (key % 4 == 0).alias("is_directory"), F.col("p_size").alias("size"), F.when(key % 5 != 0, key * 7 % 101).alias("mtime"), F.col("p_brand").alias("kind"), F.col("p_name").alias("path"))
    out = None
    for mode in search.MODES:
        one = search.placed(search.ordered(rows, mode).select("p_partkey")).select(F.lit(mode).alias("mode"), "p_partkey", "pos")
        out = one if out is None else out.unionByName(one)
    return out


@query("natural_order_of_long_numbers", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 40, p_partkey // 40) AS pos FROM part")
def _(spark, sf_dir):
    # 1 followed by up to 39 zeros, beyond any integer type
    key = F.col("p_partkey")
    name = F.concat(F.lit("v00"), F.concat(F.lit("1"), F.repeat(F.lit("0"), (key % 40).cast("int"))), F.lit(" n"), F.floor(key / 40).cast("string"))
    return search.placed(catalog.table(spark, sf_dir, "part").orderBy(search.natural_key(name)).select("p_partkey"))


@query("tree_order", f"""WITH {_DOCS} SELECT path, row_number() OVER (ORDER BY parent, is_dir DESC, lower(name), path) AS pos FROM (
 SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, false AS is_dir, split_part(path, '/', 3) AS name FROM d UNION ALL
 SELECT DISTINCT lang || '/' || source, lang, true, source FROM d UNION ALL SELECT DISTINCT lang, '', true, lang FROM d)""")
def _(spark, sf_dir):
    return search.placed(tree.tree_order(tree.nodes(catalog.document_entries(spark, sf_dir))).select("path"))


@query("recent_runs", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25")
def _(spark, sf_dir):
    return search.recent(catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("ts")), 25).select("run_id")


@query("tree_sizes", f"""WITH {_DOCS}, s AS (SELECT unnest(['', lang, lang || '/' || source]) AS dir, size, packed FROM d)
SELECT dir, count(*) AS n_files, CASE WHEN dir = '' THEN (SELECT count(DISTINCT lang) + count(DISTINCT lang || '/' || source) FROM d) WHEN contains(dir, '/') THEN 0 ELSE (SELECT count(DISTINCT source) FROM d WHERE lang = dir) END AS n_dirs, CAST(sum(size) AS BIGINT) AS total_uncompressed, CAST(sum(packed) AS BIGINT) AS total_compressed FROM s GROUP BY dir""")
def _(spark, sf_dir):
    return tree.rollup(catalog.document_entries(spark, sf_dir))


@query("encryption_tiers", f"WITH {_DOCS} SELECT source AS archive_id, CASE WHEN bool_or(doc_id % 35 = 0) THEN 'header+data' WHEN bool_or(doc_id % 7 = 0) THEN 'data' ELSE 'none' END AS tier FROM d GROUP BY source")
def _(spark, sf_dir):
    rows = catalog.document_entries(spark, sf_dir)
    return tree.encryption_tier(rows, F.col("entry_idx") % 35 == 0, "archive_id")


# -- comparing and editing --------------------------------------------------------------------


@query("entry_diff_lists", """SELECT CAST(k AS VARCHAR) AS path, CASE WHEN k % 7 = 0 THEN 'only_a' WHEN k % 5 = 0 THEN 'only_b' ELSE 'modified' END AS status,
 row_number() OVER (ORDER BY CASE WHEN k % 7 = 0 THEN 'only_a' WHEN k % 5 = 0 THEN 'only_b' ELSE 'modified' END, CAST(k AS VARCHAR)) AS pos FROM (SELECT o_orderkey AS k FROM orders) WHERE (k % 5 = 0) <> (k % 7 = 0) OR (k % 11 = 0 AND k % 5 <> 0 AND k % 7 <> 0)""")
def _(spark, sf_dir):
    from stratalog.plans.registry import _halves

    return search.placed(diff.diff(*_halves(spark, sf_dir)).where("status <> 'same'").orderBy("status", "path").select("path", "status"))


@query("found_entries", f"WITH {_DOCS} SELECT path, size FROM d WHERE contains(lower(name), '7') AND lang = 'en'")
def _(spark, sf_dir):
    entries = catalog.document_entries(spark, sf_dir).where("path like 'en/%'")
    nodes = tree.nodes(entries)
    hits = nodes.where(F.lower("name").contains("7")).select("path")  # directories among the hits name no entry
    return diff.found_entries(hits, entries.select("path", F.col("uncompressed_size").alias("size")))


@query("entry_by_path", f"WITH {_DOCS} SELECT doc_id FROM d WHERE path = (SELECT path FROM d WHERE doc_id = 42)")
def _(spark, sf_dir):
    entries = catalog.document_entries(spark, sf_dir)
    wanted = entries.where("entry_idx = 42").first()["path"]
    return diff.by_path(entries, f"//{wanted}").select(F.col("entry_idx").cast("long").alias("doc_id"))


@query("word_lists", "SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT unnest(string_split(p_type, ' ')) FROM part UNION ALL SELECT n_name FROM nation)")
def _(spark, sf_dir):
    words = lambda name, column: catalog.table(spark, sf_dir, name).select(F.explode(F.split(column, " ")).alias("word"))
    return diff.word_list(words("part", "p_name"), words("part", "p_type"), catalog.table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")))


@query("converted", f"WITH {_DOCS} SELECT 'backup/' || path AS path, size AS uncompressed_size, CAST(NULL AS BIGINT) AS compressed_size FROM d")
def _(spark, sf_dir):
    return diff.converted(catalog.document_entries(spark, sf_dir), "backup").select("path", "uncompressed_size", "compressed_size")


# -- payloads ---------------------------------------------------------------------------------


@query("file_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", payload.digests(F.col("payload")).alias("d")).select("doc_id", "d.md5", "d.sha1", "d.sha256")


@query("crc_of_chunks", "SELECT doc_id, true AS same FROM documents WHERE text <> ''")
def _(spark, sf_dir):
    rows = _payloads(spark, sf_dir)
    cut = archives.chunks(rows.withColumnRenamed("payload", "content"), "doc_id", 1000).select("doc_id", "chunk", F.crc32("bytes").alias("crc32"), F.length("bytes").cast("long").alias("size"))
    whole = rows.select("doc_id", F.crc32("payload").alias("crc"))
    return payload.combined_crc32(cut, "doc_id", "chunk").join(whole, "doc_id").select("doc_id", (F.col("crc32") == F.col("crc")).alias("same"))


@query("strided_entropy", """WITH l AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents WHERE text <> ''),
b AS (SELECT doc_id, len(l) AS n, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM l),
c AS (SELECT doc_id, x, count(*) AS k FROM b WHERE n <= 512 OR (i % (n // 512) = 0 AND i // (n // 512) < 512) GROUP BY ALL), p AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM c)
SELECT doc_id, round(greatest(0, -sum(p * log2(p))), 6) AS entropy FROM p GROUP BY doc_id""")
def _(spark, sf_dir):
    return _payloads(spark, sf_dir).where(F.length("payload") > 0).select("doc_id", F.round(payload.sampled_entropy(512)(F.col("payload")), 6).alias("entropy"))


@query("bypass", "SELECT p_partkey, p_partkey % 3 = 0 AS bypass FROM part WHERE p_partkey <= 24")
def _(spark, sf_dir):
    # a megabyte of digests, one of repeated bytes, and half a megabyte of digests
    k = F.col("p_partkey")
    noise = lambda n: F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sha2(F.concat_ws("-", k.cast("string"), i.cast("string")), 256)), ""))
    made = F.when(k % 3 == 0, noise(32_768)).when(k % 3 == 1, F.repeat(F.lit("ab"), 1 << 19).cast("binary")).otherwise(noise(16_384))
    return catalog.table(spark, sf_dir, "part").where("p_partkey <= 24").select("p_partkey", payload.bypass_compression(made).alias("bypass"))


@query("codec_rules", """SELECT l_orderkey, l_linenumber, r.algorithm, CAST(r.level AS INTEGER) AS level, CAST(r.speed AS DOUBLE) AS throughput_mbs, round(greatest(0::DOUBLE, (1 - ratio::DOUBLE * coalesce(r.factor, 1)) * 100) * CASE WHEN r.algorithm = 'store' THEN 0 ELSE 1 END, 6) AS savings_pct FROM (
 SELECT *, CASE WHEN e > 7.92 AND ratio > 0.98 THEN {'algorithm': 'store', 'level': 0, 'speed': 6500.0, 'factor': 1.0} WHEN kind = 'instant' AND ratio < 0.5 THEN {'algorithm': 'zstd', 'level': 1, 'speed': 3000.0, 'factor': 1.0}
  WHEN kind = 'instant' THEN {'algorithm': 'lz4', 'level': 1, 'speed': 4000.0, 'factor': 1.0} WHEN kind = 'cold' THEN {'algorithm': 'lzma2', 'level': 9, 'speed': 500.0, 'factor': 0.75} WHEN ratio < 0.4 THEN {'algorithm': 'zstd', 'level': 3, 'speed': 1800.0, 'factor': 0.9}
  ELSE {'algorithm': 'deflate', 'level': 6, 'speed': 1200.0, 'factor': 1.0} END AS r
 FROM (SELECT l_orderkey, l_linenumber, l_quantity / 6.25 AS e, (l_orderkey * 7 + l_linenumber) % 105 / 100.0 AS ratio, CASE l_linenumber % 3 WHEN 0 THEN 'instant' WHEN 1 THEN 'cold' ELSE 'balanced' END AS kind FROM lineitem))""")
def _(spark, sf_dir):
    kind = payload.scenario(_pick(["over the LAN", "Archive for years", "daily"], F.col("l_linenumber")))
    r = payload.recommendation(F.col("l_quantity") / 6.25, (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 105 / 100.0, kind)
    out = catalog.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    return out.withColumn("savings_pct", F.round("savings_pct", 6))


@query("charset_marks", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' WHEN 3 THEN 'utf-16' ELSE CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END END AS charset, text AS back FROM documents")
def _(spark, sf_dir):
    k = F.col("doc_id") % 4
    mark = lambda h: F.unhex(F.lit(h))
    raw = F.when(k == 1, F.concat(mark("EFBBBF"), F.encode("text", "UTF-8"))).when(k == 2, F.concat(mark("FFFE"), F.encode("text", "UTF-16LE"))).when(k == 3, F.concat(mark("FEFF"), F.encode("text", "UTF-16BE"))).otherwise(F.encode("text", "UTF-8"))
    return catalog.table(spark, sf_dir, "documents").select("doc_id", payload.charset(raw).alias("charset"), payload.decoded(raw).alias("back"))


def _hex(text: str) -> str:
    return f"lower(array_to_string(regexp_extract_all(hex(encode(substr({text}, greatest(0, length(p_name) - 17) + 1, 32))), '..'), ' '))"


@query("hex_differences", f"""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN strlen(p_name) - 1 END AS "offset", CASE WHEN p_partkey % 3 <> 0 THEN 'offset ' || (strlen(p_name) - 1) || chr(10) || '- ' || {_hex('p_name')} || chr(10) || '+ ' || {_hex("left(p_name, length(p_name) - 1) || '!'")} END AS diff FROM part""")
def _(spark, sf_dir):
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.lit("!")))
    return catalog.table(spark, sf_dir, "part").select("p_partkey", payload.hex_diff(F.col("p_name").cast("binary"), other.cast("binary")).alias("d")).select("p_partkey", "d.*")


#: Formats: bytes before the magic (behind it for the one at the end), the magic, and what is found.
_MAGICS = [(0, "377ABCAF271C", "7z"), (0, "FD377A585A00", "xz"), (0, "526172211A070100", "rar"), (0, "28B52FFD", "zstd"), (0, "78617221", "xar"), (0, "4D5357494D000000", "wim"), (0, "4D534346", "cab"), (0, "213C617263683E0A", "ar"), (0, "FF060000734E61507059", "snappy"), (0, "4C5A4950", "lzip"), (0, "41413031", "aar"), (0, "04224D18", "lz4"), (0, "6276782D", "lzfse"), (0, "504B0304", "zip"), (0, "1F8B", "gzip"), (0, "425A68", "bzip2"), (257, "757374617200", "tar"), (0x8001, "4344303031", "iso"), (2, "2D6C68", "lzh"), (0, "00", "unknown")]


@query("sniff_all", f"SELECT page_id, format FROM pages JOIN {_sql_rows([(i, f) for i, (_, _, f) in enumerate(_MAGICS)], 'i, format')} ON page_id % {len(_MAGICS)} = i")
def _(spark, sf_dir):
    k = F.col("page_id")
    before = F.repeat(F.lit("A"), _pick([str(n) for n, _, _ in _MAGICS], k).cast("int")).cast("binary")
    content = F.concat(before, F.unhex(_pick([m for _, m, _ in _MAGICS], k)), F.rpad("html", 40_000, "A").cast("binary"))
    return catalog.table(spark, sf_dir, "pages").select("page_id", signatures.sniff(content).getField("format").alias("format"))


@query("sniff_ends", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'zip' WHEN 1 THEN 'dmg' WHEN 2 THEN '7z' ELSE 'zip' END AS format, CASE page_id % 4 WHEN 0 THEN 90 WHEN 1 THEN 100 ELSE 95 END AS confidence, CAST(CASE WHEN page_id % 4 = 2 THEN 100 + page_id WHEN page_id % 4 = 3 THEN 64 + page_id END AS INTEGER) AS embedded_at FROM pages")
def _(spark, sf_dir):
    k = F.col("page_id")
    raw = lambda h: F.unhex(F.lit(h))
    fill = lambda n: F.repeat(F.lit("A"), n).cast("binary")
    end = F.concat(fill(F.lit(200)), raw("504B0506"), fill(F.lit(18)))
    image = F.concat(fill(F.lit(700)), raw("6B6F6C79"), fill(F.lit(508)))
    seven = F.concat(raw("4D5A"), fill((98 + k).cast("int")), raw("377ABCAF271C"), fill(F.lit(50)))
    zipped = F.concat(raw("4D5A"), fill((62 + k).cast("int")), raw("504B0304"), fill(F.lit(50)))
    content = F.when(k % 4 == 0, end).when(k % 4 == 1, image).when(k % 4 == 2, seven).otherwise(zipped)
    return catalog.table(spark, sf_dir, "pages").select("page_id", signatures.sniff(content).alias("s")).select("page_id", "s.format", "s.confidence", "s.embedded_at")


# -- archives ---------------------------------------------------------------------------------


@query("damaged_integrity", """SELECT source || '-' || (doc_id % 50) AS archive_id, count(*) AS n_files, count(*) FILTER (doc_id % 5 <> 0) AS n_verified, count(*) FILTER (doc_id % 5 = 0) AS n_corrupted, CAST(sum(strlen(text)) + count(*) FILTER (doc_id % 5 = 0) AS BIGINT) AS bytes_read,
 CASE WHEN bool_or(doc_id % 5 = 0) THEN 'CORRUPTED' ELSE 'PASSED' END AS status FROM documents GROUP BY 1""")
def _(spark, sf_dir):
    rows = archives.entries(_packed(spark, sf_dir, "zip"), with_payload=True)
    hurt = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 5 == 0
    return security.integrity(rows.withColumn("payload", F.when(hurt, F.concat("payload", F.unhex(F.lit("00")))).otherwise(F.col("payload"))), "archive_id")


@query("inspected", "SELECT DISTINCT source || '-' || (doc_id % 50) AS path, 'gzip' AS format, 100 AS confidence FROM documents")
def _(spark, sf_dir):
    return archives.inspect(_packed(spark, sf_dir, "tar.gz")).select("path", "format", "confidence")


@query("compliance_summary", "SELECT source || '-' || (doc_id % 50) AS archive_id, CAST(CASE WHEN any_value(doc_id % 50) % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors, any_value(doc_id % 50) % 2 = 1 AS is_compliant FROM documents GROUP BY 1")
def _(spark, sf_dir):
    made = _packed(spark, sf_dir, "zip")
    even = F.substring_index("path", "-", -1).cast("int") % 2 == 0
    hurt = made.withColumn("content", F.when(even, F.substring("content", 1, F.length("content") - 22)).otherwise(F.col("content")))
    found = security.issue_summary(archives.compliance(hurt), "archive_id")
    out = made.select(F.col("path").alias("archive_id")).join(found, "archive_id", "left")
    return out.select("archive_id", F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"), F.coalesce("is_compliant", F.lit(True)).alias("is_compliant"))


@query("bombs", """WITH e AS (SELECT source, doc_id, n_chars * 1000 AS size, n_chars * 1000 // (doc_id % 300 + 1) AS packed FROM documents), f AS (SELECT *, coalesce(packed > 0 AND size / packed > 100 AND size > 1000000, false) AS bomb FROM e)
SELECT source, CASE WHEN bool_or(bomb) THEN 'WARNING' ELSE 'SAFE' END AS level, CAST(0 AS BIGINT) AS n_traversal, count(*) FILTER (bomb) AS n_bombs, count(*) FILTER (bomb) AS n_suspicious FROM f GROUP BY source""")
def _(spark, sf_dir):
    size = F.col("n_chars") * 1000
    rows = catalog.table(spark, sf_dir, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), size.alias("uncompressed_size"), F.floor(size / (F.col("doc_id") % 300 + 1)).alias("compressed_size"))
    return security.risk(rows, "source")


@query("tar_checksums", "SELECT doc_id, doc_id % 3 <> 0 AS good FROM documents")
def _(spark, sf_dir):
    @F.pandas_udf("boolean")
    def good(doc_id, text):
        import pandas as pd

        out = []
        for k, t in zip(doc_id, text, strict=True):
            header = bytearray(containers.pack_tar([(f"{k}.txt", (t or "").encode(), 0)])[:512])
            if k % 3 == 0:
                header[0] ^= 1
            out.append(containers.tar_checksum_ok(bytes(header)))
        return pd.Series(out)

    return catalog.table(spark, sf_dir, "documents").select("doc_id", good("doc_id", "text").alias("good"))


@query("volume_bytes", """SELECT page_id || '.zip.' || lpad(CAST(k AS VARCHAR), 3, '0') AS path, sha256(substr(hex(encode(html)), (k - 1) * 2000 + 1, 2000)) AS digest FROM (SELECT page_id, html, unnest(range(1, greatest(1, (strlen(html) + 999) // 1000) + 1)) AS k FROM pages)""")
def _(spark, sf_dir):
    files = catalog.table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".zip")).alias("name"), F.col("html").cast("binary").alias("content"))
    return volumes.cut(files, 1000).select("path", F.sha2(F.hex("bytes"), 256).alias("digest"))


@query("stored_zip", "SELECT source || '-' || (doc_id % 50) AS archive_id, 'd/' || doc_id || '.txt' AS path, 'store' AS method, CAST(strlen(text) AS BIGINT) AS compressed_size, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    return archives.entries(_packed(spark, sf_dir, "zip", level=0), with_payload=True).select("archive_id", "path", "method", "compressed_size", F.sha2("payload", 256).alias("sha256"))


@query("zstd_tar_round_trip", "SELECT source || '-' || (doc_id % 50) AS archive_id, 'd/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS uncompressed_size, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    return archives.entries(_packed(spark, sf_dir, "tar.zst"), with_payload=True).select("archive_id", "path", "uncompressed_size", F.sha2("payload", 256).alias("sha256"))


@query("pax_long_names", "SELECT 'd' || repeat('x', 150) || '/' || doc_id || repeat('y', 120) AS path, CAST(strlen(text) AS BIGINT) AS uncompressed_size FROM documents")
def _(spark, sf_dir):
    # names beyond a header's field come in a header of their own, which goes before the entry
    rows = catalog.table(spark, sf_dir, "documents").select(F.lit("long").alias("archive_id"), F.concat(F.lit("d" + "x" * 150 + "/"), F.col("doc_id").cast("string"), F.lit("y" * 120)).alias("path"), F.col("text").cast("binary").alias("payload"), F.lit(0).cast("long").alias("mtime_epoch"))
    return archives.entries(archives.pack(rows.withColumn("archive_id", F.col("path").substr(155, 2)), "archive_id", "tar").withColumnRenamed("archive_id", "path")).select("path", "uncompressed_size")


@query("recovered_by_command", "SELECT CAST(n_nationkey AS VARCHAR) AS task, n_nationkey % 4 <> 0 AS success, CASE WHEN n_nationkey % 4 <> 0 THEN 1 END AS n_rows FROM nation")
def _(spark, sf_dir):
    keys = [r.n_nationkey for r in catalog.table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    one = catalog.table(spark, sf_dir, "region").limit(1)
    tasks = {str(k): (lambda k=k: one.select("missing" if k % 4 == 0 else "r_name")) for k in keys}
    return commands.batch(spark, tasks).select("task", "success", F.col("n_rows").cast("int").alias("n_rows"))


# -- history and statistics -------------------------------------------------------------------


def _runs(spark, sf_dir) -> DataFrame:
    """Orders as runs; every fifth undoes the one before it, every tenth redoes it; batches of a customer are undone as a whole."""
    k = F.col("o_orderkey")
    orders = catalog.table(spark, sf_dir, "orders").select(k, "o_custkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    plain = orders.select(k.cast("string").alias("run_id"), F.lit("create").alias("command"), F.lit(0).alias("at"), F.create_map(F.lit("macro"), F.col("o_custkey").cast("string")).alias("metadata"))
    undo = orders.where(k % 5 == 0).select(F.concat(F.lit("u"), k.cast("string")).alias("run_id"), F.lit("undo").alias("command"), F.lit(1).alias("at"), F.create_map(F.lit("run_id"), k.cast("string")).alias("metadata"))
    redo = orders.where(k % 10 == 0).select(F.concat(F.lit("r"), k.cast("string")).alias("run_id"), F.lit("redo").alias("command"), F.lit(2).alias("at"), F.create_map(F.lit("run_id"), k.cast("string")).alias("metadata"))
    whole = orders.where("o_custkey % 9 = 0").select("o_custkey").distinct().select(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("run_id"), F.lit("undo").alias("command"), F.lit(3).alias("at"), F.create_map(F.lit("macro"), F.col("o_custkey").cast("string")).alias("metadata"))
    return plain.unionByName(undo).unionByName(redo).unionByName(whole).withColumn("ts", F.timestamp_seconds(F.col("at"))).drop("at")


@query("undo_history", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE (o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0) AND o_custkey % 9 <> 0")
def _(spark, sf_dir):
    return ingest.undone(_runs(spark, sf_dir)).select("run_id")


@query("redo_history", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE (o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0) OR o_custkey % 9 = 0")
def _(spark, sf_dir):
    return ingest.redoable(_runs(spark, sf_dir)).select("run_id")


@query("pareto_of_all", "SELECT p_partkey, coalesce(y > m + 1e-7, true) AS is_optimal FROM (SELECT p_partkey, p_size AS y, max(p_size) OVER (ORDER BY p_retailprice DESC, p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM part)")
def _(spark, sf_dir):
    return bench.pareto(catalog.table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").alias("y"))).select("p_partkey", "is_optimal")


@query("throughput", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1e6 / nullif(l_quantity, 0), 9) AS mb_s, round(l_quantity * 3 / l_extendedprice, 9) AS cycles_per_byte, round(l_linenumber / (l_quantity * 3), 9) AS ipc FROM lineitem")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("bytes"), F.col("l_quantity").alias("seconds"), (F.col("l_quantity") * 3).alias("cycles"), F.col("l_linenumber").alias("instructions"))
    return bench.throughput(rows, "cycles", "instructions").select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in ("mb_s", "cycles_per_byte", "ipc")])


@query("log_lines", """SELECT k, metric, unit, number FROM (SELECT s_suppkey AS k, 'step ' || s_suppkey AS metric, CASE s_suppkey % 3 WHEN 0 THEN 'mb_s' WHEN 1 THEN 'ms' ELSE 'mops_s' END AS unit, CAST(s_suppkey + 0.5 AS DOUBLE) AS number FROM supplier)""")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.when(k % 3 == 0, F.format_string("  step %d = %d.5 MB/s (peak)", k, k)).when(k % 3 == 1, F.format_string("step %d ..... %d.5 ms", k, k)).otherwise(F.format_string("step %d: %d.5 M ops/s", k, k))
    lines = catalog.table(spark, sf_dir, "supplier").select(F.explode(F.array(line, F.format_string("%d MB", k), F.lit(""))).alias("value"))
    return reports.log_metrics(lines).withColumn("k", F.regexp_extract("metric", r"(\d+)", 1).cast("long"))


@query("list_contract", f"""WITH {_DOCS} SELECT '{{"path":"' || path || '","uncompressedSize":' || size || ',"compressedSize":' || packed || ',"crc32":' || doc_id || ',"isDirectory":false,"isEncrypted":' || (doc_id % 7 = 0) || ',"mtime":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE CAST(mtime AS VARCHAR) END || '}}' AS json FROM d""")
def _(spark, sf_dir):
    rows = catalog.document_entries(spark, sf_dir).withColumns({"crc32": F.col("entry_idx").cast("long"), "mtime_epoch": F.when(F.col("entry_idx") % 3 != 0, F.col("mtime_epoch"))})
    return reports.as_json(rows, "list")


@query("synthetic_corpora", "SELECT * FROM (VALUES ('log', CAST(3 AS BIGINT), true), ('noise', CAST(3 AS BIGINT), false), ('text', CAST(3 AS BIGINT), true), ('xml', CAST(3 AS BIGINT), true), ('zeros', CAST(3 AS BIGINT), true)) AS v(kind, n, compressible)")
def _(spark, sf_dir):
    out = None
    for kind in ("zeros", "text", "xml", "log", "noise"):
        one = reports.corpus(spark, kind, 3).select(F.lit(kind).alias("kind"), payload.entropy("payload").alias("h"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind").agg(F.count("*").alias("n"), (F.max("h") < 7.0).alias("compressible"))


# -- commands ---------------------------------------------------------------------------------

_PACKED = "z AS (SELECT source || '-' || (doc_id % 50) AS archive_id, 'd/' || doc_id || '.txt' AS path, doc_id, text, CAST(strlen(text) AS BIGINT) AS size FROM documents)"


def _archives(spark, sf_dir, container="zip", keep="true", changed=False) -> DataFrame:
    """Archives of the documents as a table of files, some left out or changed."""
    rows = catalog.table(spark, sf_dir, "documents").where(keep).select(F.concat_ws("-", "source", (F.col("doc_id") % 50).cast("string")).alias("archive_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.lit(changed) & (F.col("doc_id") % 11 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("payload"), (F.col("doc_id") * 2 + 1_600_000_000).alias("mtime_epoch"))
    return archives.pack(rows, "archive_id", container).select(F.col("archive_id").alias("path"), F.length("content").cast("long").alias("size"), "content")


@query("command_list", f"WITH {_PACKED} SELECT archive_id, path, size AS uncompressed_size FROM z WHERE size > 2048 AND contains(path, '7')")
def _(spark, sf_dir):
    return commands.list_(spark, _archives(spark, sf_dir), "size:>2KB AND name:*7*").select("archive_id", "path", "uncompressed_size")


@query("command_first", f"WITH {_PACKED} SELECT least(5, count(*)) AS n, true AS kept FROM z WHERE size > 100")
def _(spark, sf_dir):
    return commands.first(spark, _archives(spark, sf_dir), "size:>100", 5).agg(F.count("*").alias("n"), F.bool_and(F.col("uncompressed_size") > 100).alias("kept"))


@query("command_info", f"WITH {_PACKED} SELECT archive_id, count(*) AS n_entries, CAST(sum(size) AS BIGINT) AS total_uncompressed, false AS any_encrypted FROM z GROUP BY archive_id")
def _(spark, sf_dir):
    return commands.info(spark, _archives(spark, sf_dir)).select("archive_id", "n_entries", "total_uncompressed", "any_encrypted")


@query("command_tree", f"WITH {_PACKED} SELECT 'd' AS path, 1 AS depth, CAST(sum(size) AS BIGINT) AS total_uncompressed, count(*) AS n_files FROM z")
def _(spark, sf_dir):
    return commands.show_tree(spark, _archives(spark, sf_dir), 1).select("path", "depth", "total_uncompressed", "n_files")


@query("command_diff", f"WITH {_PACKED} SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'only_b' WHEN doc_id % 7 = 0 THEN 'only_a' ELSE 'modified' END AS status FROM z WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0) OR (doc_id % 11 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0)")
def _(spark, sf_dir):
    return commands.compare(spark, _archives(spark, sf_dir, "tar", "doc_id % 5 <> 0"), _archives(spark, sf_dir, "tar.gz", "doc_id % 7 <> 0", changed=True))


@query("command_hash", "SELECT CAST(page_id AS VARCHAR) AS path, md5(html) AS md5, sha256(html) AS sha256 FROM pages")
def _(spark, sf_dir):
    files = catalog.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return commands.hashes(spark, files).select("path", "md5", "sha256")


@query("command_check", f"WITH {_PACKED}, a AS (SELECT archive_id, any_value(doc_id % 50) AS k, count(*) AS n FROM z GROUP BY archive_id) SELECT archive_id, CASE WHEN k % 2 = 0 THEN n END AS n_files, CASE WHEN k % 2 = 0 THEN n END AS n_verified, CASE WHEN k % 2 = 0 THEN 'PASSED' ELSE 'CORRUPTED' END AS status FROM a")
def _(spark, sf_dir):
    odd = F.substring_index("path", "-", -1).cast("int") % 2 == 1
    hurt = _archives(spark, sf_dir).withColumn("content", F.when(odd, F.substring("content", 1, F.length("content") - 30)).otherwise(F.col("content")))
    return commands.check(spark, hurt).select("archive_id", "n_files", "n_verified", "status")


@query("command_cat", "SELECT 'd/42.txt' AS path, text FROM documents WHERE doc_id = 42")
def _(spark, sf_dir):
    return commands.cat(spark, _archives(spark, sf_dir), "/d/42.txt").select("path", F.col("payload").cast("string").alias("text"))


@query("command_extract", "SELECT archive_id, path, target, digest, reason FROM (SELECT source AS archive_id, CASE WHEN doc_id % 9 = 0 THEN '../' || doc_id ELSE './x//' || doc_id END AS path, CASE WHEN doc_id % 9 <> 0 THEN 'x/' || doc_id END AS target, CASE WHEN doc_id % 9 <> 0 THEN md5(text) END AS digest, CASE WHEN doc_id % 9 = 0 THEN 'unsafe path' END AS reason FROM documents)")
def _(spark, sf_dir):
    k = F.col("doc_id")
    rows = catalog.table(spark, sf_dir, "documents").select("source", F.when(k % 9 == 0, F.concat(F.lit("../"), k.cast("string"))).otherwise(F.concat(F.lit("./x//"), k.cast("string"))).alias("path"), F.col("text").cast("binary").alias("payload"), F.lit(0).cast("long").alias("mtime_epoch"))
    return commands.extract(spark, archives.pack(rows, "source").withColumnRenamed("source", "path")).select("archive_id", "path", "target", F.md5("payload").alias("digest"), "reason")


@query("command_repair", f"WITH {_PACKED} SELECT archive_id, path, sha256(text) AS sha256 FROM z")
def _(spark, sf_dir):
    hurt = _archives(spark, sf_dir).withColumn("content", F.substring("content", 1, F.length("content") - 40))
    return commands.repair(spark, hurt).select("archive_id", "path", F.sha2("payload", 256).alias("sha256"))


@query("command_split_join", "SELECT page_id || '.html.*' AS chain, md5(html) AS digest FROM pages WHERE strlen(html) > 700".replace(".html.*", ".html"))
def _(spark, sf_dir):
    files = catalog.table(spark, sf_dir, "pages").where("octet_length(html) > 700").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.octet_length("html").cast("long").alias("size"), F.col("html").cast("binary").alias("content"))
    parts = commands.split(spark, files, 700).select("path", F.length("bytes").cast("long").alias("size"), F.col("bytes").alias("content"))
    return commands.join(spark, parts).select("chain", F.md5("content").alias("digest"))


@query("command_convert", f"WITH {_PACKED} SELECT archive_id, path, size AS uncompressed_size, sha256(text) AS sha256 FROM z")
def _(spark, sf_dir):
    made = commands.convert(spark, _archives(spark, sf_dir, "tar.zst"), "zip").withColumnRenamed("archive_id", "path")
    return archives.entries(made, with_payload=True).select("archive_id", "path", "uncompressed_size", F.sha2("payload", 256).alias("sha256"))


@query("command_delete", f"WITH {_DOCS} SELECT path FROM d WHERE NOT (size > 2048 AND lower(ext) = 'txt')")
def _(spark, sf_dir):
    return commands.delete(catalog.document_entries(spark, sf_dir), "size:>2KB ext:txt").select("path")


@query("command_update", f"WITH {_DOCS} SELECT path, mtime + CASE WHEN doc_id % 4 = 0 THEN 9 ELSE 0 END AS mtime_epoch, size + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS uncompressed_size FROM d UNION ALL SELECT 'new/' || path, mtime + 9, size + 1 FROM d WHERE doc_id % 40 = 0")
def _(spark, sf_dir):
    known = catalog.document_entries(spark, sf_dir)
    later = known.withColumns({"uncompressed_size": F.col("uncompressed_size") + 1, "mtime_epoch": F.col("mtime_epoch") + F.when(F.col("entry_idx") % 4 == 0, 9).otherwise(-9)})
    fresh = later.where("entry_idx % 40 = 0").withColumn("path", F.concat(F.lit("new/"), F.col("path")))
    return commands.update(known, later.unionByName(fresh)).select("path", "mtime_epoch", "uncompressed_size")


@query("edit_session", "SELECT 'committed' AS state, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN 2 * o_custkey ELSE o_custkey END) AS BIGINT) AS total, count(*) FILTER (o_orderkey % 3 <> 0) AS n FROM orders UNION ALL SELECT 'rolled back', CAST(sum(o_custkey) AS BIGINT), count(*) FROM orders")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("v"))
    session = diff.Session(rows)
    doubled = rows.withColumn("v", F.col("v") * 2)
    session.upsert(doubled.where("path % 7 = 0")).delete(rows.where("path % 3 = 0"))
    sums = lambda state, table: table.agg(F.lit(state).alias("state"), F.sum("v").alias("total"), F.count("*").alias("n"))
    return sums("committed", session.commit()).unionByName(sums("rolled back", session.rollback()))


@query("damaged_archives", """SELECT mutation, count(DISTINCT source || '-' || (doc_id % 50)) AS n_archives, true AS answered FROM documents, (VALUES ('empty'), ('cut_tail'), ('cut_head'), ('byte'), ('zeros'), ('ones'), ('inserted'), ('removed'), ('twice'), ('swapped')) AS v(mutation) GROUP BY mutation""")
def _(spark, sf_dir):
    # whatever is broken, a reader gives entries or an error for each archive
    hurt = mutations.damaged(_packed(spark, sf_dir, "zip"), "path").withColumn("path", F.concat_ws("|", "mutation", "path"))
    found = archives.entries(hurt, with_payload=True).groupBy("archive_id").agg((F.count("error") <= 1).alias("one"))
    mutation = F.substring_index("archive_id", "|", 1)
    return found.groupBy(mutation.alias("mutation")).agg(F.count("*").alias("n_archives"), F.bool_and("one").alias("answered"))


@query("mutation_bytes", """SELECT page_id, 'twice' AS mutation, sha256(html || html) AS digest FROM pages UNION ALL SELECT page_id, 'empty', sha256('') FROM pages""")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return mutations.damaged(rows, "page_id").where("mutation IN ('twice', 'empty')").select("page_id", "mutation", F.sha2("content", 256).alias("digest"))


@query("markdown_report", "SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS report FROM nation")
def _(spark, sf_dir):
    text = reports.markdown(catalog.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"))
    return spark.createDataFrame([(text,)], "report string")
