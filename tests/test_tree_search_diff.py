import pytest
from pyspark.sql import functions as F

from stratalog.functions import fuzzy
from stratalog.operators import diff, search, security, tree

ENTRY = "path string, entry_idx int, uncompressed_size long, compressed_size long, is_directory boolean, is_encrypted boolean"


def entries(spark, *rows):
    return spark.createDataFrame([(p, k, s, c, p.endswith("/"), False) for k, (p, s, c) in enumerate(rows)], ENTRY)


def totals_of(frame):
    return {r.dir: (r.n_files, r.n_dirs, r.total_uncompressed, r.total_compressed) for r in tree.rollup(frame).collect()}


def test_small_trees(spark):
    assert totals_of(entries(spark, ("Project/src/main.rs", 150, 1), ("Project/README.md", 200, 1)))[""] == (2, 2, 350, 2)
    deep = totals_of(entries(spark, ("a/b/c/d/file1.bin", 1024, 512), ("a/b/c/d/file2.bin", 2048, 1024)))
    assert deep[""] == (2, 4, 3072, 1536) and deep["a/b/c/d"] == (2, 0, 3072, 1536)
    empty = totals_of(entries(spark, ("x/", 99, 99), ("x/y/", 0, 0), ("top", 5, None)))
    assert empty == {"": (1, 2, 5, 0), "x": (0, 1, 0, 0), "x/y": (0, 0, 0, 0)}


def test_root_is_the_sum_of_leaves(spark):
    rows = [(f"Folder_{i % 7}/Sub_{i % 11}/file_{i}.dat", (i % 1024) * 1024, i) for i in range(3000)]
    root = totals_of(entries(spark, *rows))[""]
    assert root == (3000, 7 + 77, sum(r[1] for r in rows), sum(r[2] for r in rows))


def test_nodes_children_and_rendering(spark):
    frame = entries(spark, ("a/file10", 1, 1), ("a/file9", 1, 1), ("a/z/x", 1, 1), ("b", 1, 1))
    nodes = tree.nodes(frame)
    assert [r.name for r in tree.children(nodes, "a").collect()] == ["z", "file9", "file10"]
    assert [r.path for r in tree.deepest_first(nodes).limit(1).collect()] == ["a/z/x"]
    text = tree.render(nodes).splitlines()
    assert text[0].startswith("├── a/") and text[-1].startswith("└── b") and "│   └── file9" in "\n".join(text)


def test_totals_composition_and_duplicates(spark):
    frame = entries(spark, ("a.TXT", 10, 5), ("b.txt", 20, 5), ("c", 10, None), ("d/", 0, 0))
    r = tree.totals(frame).first()
    assert (r.n_entries, r.n_dirs, r.total_uncompressed, r.ratio_pct, r.any_encrypted) == (4, 1, 40, 25.0, False)
    assert [(r.ext, r.n, round(r.end_angle)) for r in tree.composition(frame).orderBy(F.desc("n")).collect()] == [("txt", 2, 240), ("other", 1, 360)]
    twice = entries(spark, ("a", 1, 1), ("a", 2, 2))
    assert [r.uncompressed_size for r in tree.last_of_each_path(twice).collect()] == [2]
    assert tree.totals(frame.where("false")).first().n_entries == 0
    assert tree.encryption_tier(frame, F.lit(False)).first().tier == "none"


ITEMS = "name string, is_directory boolean, size long, mtime timestamp, kind string, path string, is_archive boolean"


@pytest.fixture
def items(spark):
    names = [("img_10", False, 3, "2024-01-02"), ("Img_1", False, 9, None), ("img_02", False, 5, "2024-01-03"), ("img_2", False, 5, "2024-01-01"), ("zdir", True, 0, None), (".hidden", False, 1, None), ("img.zip", False, 1, None)]
    return spark.createDataFrame([(n, d, s, m, "k", n, n.endswith(".zip")) for n, d, s, m in names], ITEMS.replace("mtime timestamp", "mtime string")).withColumn("mtime", F.col("mtime").cast("timestamp"))


def test_orders(items):
    names = lambda mode: [r.name for r in search.ordered(items.where("name like 'i%' or name like 'I%' or is_directory"), mode).collect()]
    assert names("name_asc") == ["zdir", "img.zip", "Img_1", "img_02", "img_2", "img_10"]
    assert names("date_asc")[-2:] == names("date_desc")[-2:] == ["img.zip", "Img_1"]
    assert names("date_desc")[1] == "img_02" and names("size_desc")[1] == "Img_1"
    with pytest.raises(ValueError):
        search.ordered(items, "colour")


def test_completion(items):
    assert [r.name for r in search.complete(items, "IMG", 3).collect()] == ["img.zip", "Img_1", "img_02"]
    assert [r.name for r in search.complete(items, "").limit(1).collect()] == ["zdir"]
    assert [r.name for r in search.complete(items, ".h").collect()] == [".hidden"]
    assert search.contains(items, "G_1").count() == 2


def test_fuzzy_scores(spark):
    assert fuzzy.score("main.rs", "main.rs") == (7 * 15 + 30 + 6 * 20 + 30 + 500, list(range(7)))
    assert fuzzy.score("abc", "") == (0, []) and fuzzy.score("ab", "abc") is None
    assert fuzzy.score("fooBar", "fb") == (10 + 5 + 30 + 10 + 25 - 2, [0, 3])
    rows = spark.createDataFrame([("docs/architecture.md", "architecture.md"), ("src/archive/writer.rs", "writer.rs"), ("none", "none")], "path string, name string")
    found = fuzzy.search(rows, "arch").collect()
    assert [r.name for r in found] == ["architecture.md", "writer.rs"]
    assert found[0].score == fuzzy.score("architecture.md", "arch")[0] + 100 and found[1].places == [4, 5, 6, 7]


def test_diff_with_itself_is_same(spark):
    a = spark.createDataFrame([("x", 1, 5), ("y", 2, None), (None, 3, 1)], "path string, uncompressed_size long, crc32 long").where("path is not null")
    assert [(r.status, r.n) for r in diff.diff_counts(a, a).collect()] == [("same", 2)]
    b = spark.createDataFrame([("x", 1, 6), ("z", 2, 1)], a.schema)
    assert {r.path: r.status for r in diff.diff(a, b).collect()} == {"x": "modified", "y": "only_a", "z": "only_b"}


MANIFEST = "relative_path string, entry_type string, byte_size long, sha256 string, posix_mode int, symlink_target string"


def test_manifests(spark):
    ours = spark.createDataFrame([("a", "regular", 1, "x", 0o644, None), ("b", "symlink", 0, None, 0o777, "t"), ("c", "directory", 0, None, 0o755, None), ("d", "regular", 1, "x", 0o644, None)], MANIFEST)
    theirs = spark.createDataFrame([("a", "regular", 2, "y", 0o600, None), ("b", "symlink", 0, None, 0o777, "u"), ("c", "regular", 0, None, 0o755, None), ("e", "regular", 1, "x", 0o644, None)], MANIFEST)
    found = lambda **o: sorted((r.relative_path, r.issue) for r in diff.compare_manifests(ours, theirs, **o).collect())
    assert found() == [("a", "sha256"), ("a", "size"), ("b", "symlink"), ("c", "type"), ("d", "extra"), ("e", "missing")]
    assert ("a", "mode") in found(full_modes=True)
    assert diff.compare_manifests(ours, ours).count() == 0


def test_edits(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, v int")
    out = diff.edited(base, base.where("path = 'a'"), spark.createDataFrame([("b", 9), ("d", 4)], base.schema))
    assert sorted(map(tuple, out.collect())) == [("b", 9), ("c", 3), ("d", 4)]
    assert diff.by_path(base.withColumn("path", F.concat(F.lit("/"), "path")), "b").first().v == 2
    assert [r.word for r in diff.word_list(spark.createDataFrame([("x",)], "word string"), spark.createDataFrame([("x",)], "word string")).collect()] == ["x"]


def test_names_that_are_taken_get_numbers(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    taken = names("a", "a 2", "a 3", "a 5", "b", "b 02", "c 2", "e", *[f"e {k}" for k in range(2, 1000)], "f 2 2", "f 2")
    found = {r.name: r.free for r in security.free_names(names("a", "b", "c", "d", "e", "f 2", "a"), taken).collect()}
    assert {k: v for k, v in found.items() if k != "e"} == {"a": "a 4", "b": "b 2", "c": "c", "d": "d", "f 2": "f 2 3"} and found["e"].startswith("e_")


def test_numbers_of_any_length_in_natural_order(spark):
    names = ["v2", "v10", "v" + "9" * 22, "v1" + "0" * 24, "v002", "v", "w1", "v2b", "v2a", "V3"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in rows.orderBy(search.natural_key(rows.name)).collect()] == ["v", "v002", "v2", "v2a", "v2b", "V3", "v10", "v" + "9" * 22, "v1" + "0" * 24, "w1"]


def test_an_edit_session(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    session = diff.Session(base)
    session.delete(base.where("path = 'a'")).upsert(spark.createDataFrame([("c", 3)], "path string, v int"))
    assert sorted(r.path for r in session.base.collect()) == ["a", "b"]
    assert sorted(r.path for r in session.commit().collect()) == ["b", "c"]
    session.delete(base)
    assert sorted(r.path for r in session.rollback().collect()) == ["b", "c"]
    assert sorted(r.path for r in session.rollback().collect()) == ["a", "b"]
