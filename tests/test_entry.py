import random

import duckdb
import numpy as np
import pytest

import __spark_entry__
from stratalog.operators import codecs
from stratalog.plans import registry
from stratalog.streaming import throttle

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return connection


def cell(v):
    if v is None or isinstance(v, float) and v != v:
        return "-"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    frame = registry.QUERIES[name](spark, DIR)
    rows = frame.collect()
    if name not in registry.SQL:
        return
    found = oracle.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    wanted = sorted([cell(v) for _, v in sorted(zip(names, r, strict=True))] for r in found.fetchall())
    assert sorted([cell(r[c]) for c in sorted(frame.columns)] for r in rows) == wanted


def test_sizes_of_very_long_documents(spark, tmp_path):
    sizes = [1023, 1536, (1 << 20) - 1, 1 << 20, 5 << 19, 5 << 29]
    spark.createDataFrame([(i, "text", "en", "src0", n) for i, n in enumerate(sizes)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.size_text for r in registry.QUERIES["size_and_mime"](spark, str(tmp_path)).collect()}
    assert found == {0: "1023 B", 1: "1.5 KB", 2: "1024.0 KB", 3: "1.0 MB", 4: "2.5 MB", 5: "2.50 GB"}


def test_whole_orders(spark):
    """Every row of the table has a place."""
    sf = DIR.replace("sf0.001", "sf0.01")
    rows = registry.QUERIES["sort_natural"](spark, sf).orderBy("pos").collect()
    keys = sorted((r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()), key=lambda k: (-(k % 10), -k))
    assert [r.p_partkey for r in rows] == keys and [r.pos for r in rows] == list(range(1, len(keys) + 1))
    rows = registry.QUERIES["deepest_first"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count() > 100
    assert [(r.depth, r.path) for r in rows] == sorted(((r.depth, r.path) for r in rows), reverse=True)


def test_every_codec_configuration_is_run(spark):
    rows = registry.QUERIES["codec_matrix"](spark, DIR).collect()
    assert {(r.codec, r.level) for r in rows} == set(codecs.CONFIGS) and len(rows) == 64 and all(r.round_trip for r in rows)


def test_flagship(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[0] == "dir" and frame.first().n_files > 0


def test_greedy_throttle():
    rng = random.Random(1)
    times = np.sort(np.array([rng.randrange(1000) for _ in range(200)]))
    keep, last = [], None
    for t in times:
        keep.append(last is None or t >= last + 37)
        last = t if keep[-1] else last
    assert throttle.passing(times, 37).tolist() == keep
    assert throttle.interval_us(500) == round(1e6 / 120) and throttle.interval_us(0.1) == 1_000_000


def test_throttled_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00.4"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:00")], "u long, ts string").selectExpr("u", "cast(ts as timestamp) ts").write.parquet(source)
    events = spark.readStream.schema("u long, ts timestamp").parquet(source)
    out = throttle.throttle_stream(events, "u", "ts", 1.0)
    query = out.writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.u, r.n) for r in spark.sql("select u, count(*) n from throttled group by u").collect()) == [(1, 2), (2, 1)]


def test_throttle_remembers_across_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(10**9), k) for k in range(3000)] + [("b", None, -1)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        frame = spark.createDataFrame(rows, "u string, us long, k long").selectExpr("u", "timestamp_micros(us) AS ts", "k")
        found = {r.k for r in throttle.throttle(frame, "u", "ts", interval=5_000_000).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = set()
    for u in ("a", "b", None):
        last = None
        for t, k in sorted((t, k) for x, t, k in rows if x == u and t is not None):
            if last is None or t >= last + 5_000_000:
                wanted.add(k)
                last = t
    assert found == wanted
