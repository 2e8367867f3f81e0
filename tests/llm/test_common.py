import os
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalog.llm import common


def test_tables_are_written_to_the_shared_folder(spark):
    root = common.shared_root(spark)
    df = common.written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "test", by="k")
    assert sorted((r.k, r["count"]) for r in df.collect()) == [(0, 4), (1, 3), (2, 3)]
    assert df.inputFiles()[0].removeprefix("file://").startswith(root.removeprefix("file:"))
    assert spark.conf.get(common._CLEANUP) == "false"
    path = df.scratch_path.removeprefix("file:")
    assert os.path.exists(path)
    common.discard(df, None, spark.range(1), spark.range(1).withColumnRenamed("id", "scratch_path"))
    assert not os.path.exists(path)


def test_scratch_goes_when_the_session_was_stopped(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from stratalog.llm import common
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
common.written(spark.range(3), "left")
import os
assert sum(f.startswith("stratalog-") for f in os.listdir("{tmp_path}")) == 1
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    for _ in range(50):
        left = [f for f in os.listdir(tmp_path) if f.startswith("stratalog-")]
        if not left:
            break
        time.sleep(0.2)
    assert left == []


def test_two_writes_at_once_keep_the_setting(spark):
    with common.cleaning(spark):
        with common.cleaning(spark):
            assert spark.conf.get(common._CLEANUP) == "true"
        assert spark.conf.get(common._CLEANUP) == "true"
    assert spark.conf.get(common._CLEANUP) == "false"


def test_names_that_clash():
    assert common.free_name(["__hit", "__HIT_"], "__hit") == "__hit__" and common.free_name(["a"], "__hit") == "__hit"


def test_pieces_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "b" * 50, "", "c", "d" * 9])], names=["k", "text"])
    cut = list(common.pieces(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [p.column("k").to_pylist() for p in cut] == [[0, 1], [2], [3, 4, 5]]
    data, offsets = common.utf8(cut[2].column("text"))
    assert offsets.tolist() == [0, 0, 1, 10] and bytes(data) == b"c" + b"d" * 9


def test_long_rows_hash_alike_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    table = common.byte_class(range(33, 256))
    words = common.Words(*common.utf8(pa.array([text])), table)
    whole = words.hashes(), words.windows(words.hashes(), 13)[1]
    monkeypatch.setattr(common, "BLOCK", 50)
    assert (words.hashes() == whole[0]).all() and (words.windows(words.hashes(), 13)[1] == whole[1]).all()


def test_dotted_names_and_back(spark):
    df = spark.sql("SELECT 1 AS `a.b`, 2 AS __column0, 3 AS `x``y`, 4 AS text")
    plain = common.undotted(df)
    assert plain.columns == ["__column0_", "__column0", "__column2", "text"] and plain.toDF(*df.columns).schema == df.schema


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    a, b = ([r.doc_id for r in common.sampled(df.repartition(n), "doc_id", 100).collect()] for n in (1, 7))
    assert len(a) == 100 and a == b and common.sampled(df.where("false"), "doc_id", 5).count() == 0


def test_samples_are_bounded_in_bytes(spark):
    df = spark.range(100).select("id", F.lit(10).alias("n"))
    assert sorted(r.id for r in common.within(df, F.col("n"), 45, "id").collect()) == [0, 1, 2, 3, 4]


def test_covered_words():
    assert common.covered(np.array([1, 2, 8]), 3, 10).tolist() == [False, True, True, True, True, False, False, False, True, True]
