import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import dsl, globs, paths

NOW = 1_000_000
VECTORS = [
    ("ext:txt AND size:<5000", "docs/readme.txt", 1024, 0, True),
    ("ext:txt AND size:<5000", "docs/readme.txt", 10000, 0, False),
    ("ext:txt AND size:<5000", "docs/readme.pdf", 1024, 0, False),
    ("ext:swift,rs AND size:>1000", "Sources/Main.swift", 2048, 0, True),
    ("ext:swift,rs AND size:>1000", "Sources/Main.swift", 500, 0, False),
    ("name:*.txt OR size:<500", "readme.txt", 10000, 0, True),
    ("name:*.txt OR size:<500", "video.mp4", 100, 0, True),
    ("name:*.txt OR size:<500", "video.mp4", 10000, 0, False),
    ("ext:rs OR ext:swift", "a.RS", 1, 0, True),
    ("", "anything", 1, 0, True),
    ("main", "src/Main.rs", 1, 0, True),
    ("src main", "src/Main.rs", 1, 0, True),
    ("src !main", "src/Main.rs", 1, 0, False),
    ("NOT (ext:rs || ext:py) && size:>1KB", "a.txt", 2000, 0, True),
    ("size:1.5K", "a", 1537, 0, True),
    ("size = 5", "a", 5, 0, True),
    ("size!=5", "a", 5, 0, False),
    ("size > 1MB", "a", 1 << 20, 0, False),
    ("modified:<1d", "a", 1, NOW - 86399, True),
    ("modified:<1d", "a", 1, NOW - 86401, False),
    ("date:>1w", "a", 1, NOW - 7 * 86400, True),
    ("mtime:>=1970-01-02", "a", 1, 86400, True),
    ("ext:tar.gz", "a.tar.gz", 1, 0, False),
    ("name:007", "x007.bin", 1, 0, True),
    ("name:007", "x7.bin", 1, 0, False),
    ("unknown:foo*", "food", 1, 0, True),
    ('"a b"', "x/a b.txt", 1, 0, True),
    ("size:>oops", "size:>oops is here", 1, 0, True),  # does not parse: one pattern
    ("name:[ab]?.txt", "dir/bX.txt", 1, 0, True),
    ("ext:.TXT", "r.txt", 1, 0, True),
]


def test_vectors(spark):
    for query, path, size, mtime, wanted in VECTORS:
        row = spark.createDataFrame([(path, size, mtime)], "path string, uncompressed_size long, mtime_epoch long")
        assert row.where(dsl.compile_query(query, now=NOW)).count() == int(wanted), query


def test_descriptions_and_warnings():
    assert str(dsl.parse("ext:a,b size:>1K OR NOT x")) == "((ext:a,b AND size:>1024) OR NOT (name:x))"
    assert str(dsl.parse("")) == "[MATCH_ALL]"
    assert dsl.parse_leniently("(a")[1] == "missing )" and dsl.parse_leniently("a")[1] is None
    with pytest.raises(dsl.FilterError):
        dsl.parse("size:abc")


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([dsl.Pattern("ab"), dsl.Pattern("*.t?t"), dsl.Extensions(("txt", "b")), dsl.Compare("size", rng.choice([">", "<", ">=", "<=", "=", "!="]), rng.randrange(4)), dsl.Compare("modified", "<", 2)])
    kind = rng.choice([dsl.Both, dsl.Either, dsl.Not])
    return kind(random_tree(rng, depth - 1)) if kind is dsl.Not else kind(random_tree(rng, depth - 1), random_tree(rng, depth - 1))


def evaluate(tree, path, size, mtime):
    name = path.rsplit("/", 1)[-1]
    match tree:
        case dsl.Pattern(text):
            return bool(re.fullmatch(r".*\.t.t", path, re.I | re.S)) if "*" in text else text in path.lower()
        case dsl.Extensions(values):
            return (name.rsplit(".", 1)[1].lower() if "." in name[1:] and not name.endswith(".") else "") in values
        case dsl.Compare(field, op, value):
            x = size if field == "size" else mtime
            return {">": x > value, "<": x < value, ">=": x >= value, "<=": x <= value, "=": x == value, "!=": x != value}[op]
        case dsl.Both(a, b):
            return evaluate(a, path, size, mtime) and evaluate(b, path, size, mtime)
        case dsl.Either(a, b):
            return evaluate(a, path, size, mtime) or evaluate(b, path, size, mtime)
        case dsl.Not(a):
            return not evaluate(a, path, size, mtime)


def test_random_trees_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["", "d/"]) + rng.choice(["ab", "xAB", ".b", "q"]) + rng.choice([".txt", ".b", "", ".", ".tXt"]), rng.randrange(4), rng.randrange(4)) for _ in range(60)]
    frame = spark.createDataFrame(rows, "path string, uncompressed_size long, mtime_epoch long")
    on = dsl.Columns(F.col("path"), F.col("uncompressed_size"), F.col("mtime_epoch"))
    trees = [random_tree(rng, 4) for _ in range(25)]
    found = frame.select("*", *[dsl.condition(t, on).alias(f"c{k}") for k, t in enumerate(trees)]).collect()
    for r in found:
        assert [r[f"c{k}"] for k in range(len(trees))] == [evaluate(t, r.path, r.uncompressed_size, r.mtime_epoch) for t in trees]


def test_sizes_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) path", "id uncompressed_size", "id mtime_epoch").write.parquet(str(tmp_path / "t"))
    plan = dsl.filter_entries(spark.read.parquet(str(tmp_path / "t")), "size:>5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(uncompressed_size,5)" in plan


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*?[]{},!/.\\", max_size=8))
def test_globs_are_regular_expressions_or_refused(glob):
    try:
        made = globs.to_regex(glob)
    except ValueError:
        assert "{" in glob
        return
    if not re.search(r"\[[^\]]*\]", glob):
        re.compile(made)


def test_path_sets(spark):
    rows = spark.createDataFrame([("src/main.swift",), ("build/out.tmp",), (".git/HEAD",), (".DS_Store",), ("/src/a/b.py",), ("x/lib.tmp/y",)], "path string")
    keep = lambda **o: [r.path for r in rows.where(globs.path_filter(F.col("path"), **o)).collect()]
    assert keep(include=["*.swift", "src/**"], exclude=["*.tmp"], no_vcs=True, no_junk=True) == ["src/main.swift", "/src/a/b.py"]
    assert keep(exclude=["*.tmp"]) == ["src/main.swift", ".git/HEAD", ".DS_Store", "/src/a/b.py"]
    assert keep(include=["src/*"]) == ["src/main.swift"]
    assert keep(include=["*.tmp"], exclude=["lib*"], strict_exclude=True) == ["build/out.tmp"]


def test_path_functions(spark):
    def of(column_of, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "p string").select(column_of(F.col("p"))).collect()]

    assert of(paths.basename, "a/b.txt", "dir/", "x") == ["b.txt", "", "x"]
    assert of(paths.extension, "a.tar.gz", ".bashrc", "x.", "d.e/f", "a/.b.c") == ["gz", "", "", "", "c"]
    assert of(lambda p: paths.strip_components(p, 2), "/var/log/app.log", "./a/b/c", "a/b", "a//b//c/d") == ["app.log", "c", None, "c/d"]
    assert of(paths.normalised, "a\\b//c/", "././x", "/") == ["a/b/c", "x", "/"]
    assert of(paths.is_extractable, "a/b", "../a", "/a", "C:x", "a/..b", "./", "a/.../b", "http://x") == [True, False, False, False, False, False, False, False]
    assert of(paths.pax_time, "1.5", "12", "7.1234567891", "x") == [(1, 500_000_000), (12, 0), (7, 123_456_789), None]
    assert [tuple(r) for r in of(paths.container_and_filter, "a.TGZ", "b.tar.zst", "c.xz", "d", "e.7z")] == [("tar", "gzip"), ("tar", "zstd"), ("raw", "xz"), ("zip", "none"), ("7z", "none")]


def test_sizes_as_text(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1 << 20,), (5 * (1 << 30) // 2,)], "n long")
    assert [r[0] for r in rows.select(paths.human_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "2.50 GB"]
    assert rows.where("n = 1024").select(paths.human_size(F.col("n"), trim=False)).first()[0] == "1.0 KB"


def test_dos_times(spark):
    rows = spark.createDataFrame([(0x5899, 0x6E2A), (0, 0)], "d int, t int").select(paths.dos_to_epoch(F.col("d"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [1714052960, None]
    back = spark.createDataFrame([(1714052961,), (0,)], "e long").select(*paths.epoch_to_dos(F.col("e"))).collect()
    assert [tuple(r) for r in back] == [(0x5899, 0x6E2A), (33, 0)]
