"""run() against the same decisions made one document at a time."""

import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from stratalog.llm import bpe, language, secrets
from tests.llm.test_decontaminate import brute
from tests.llm.test_dedup import least_reachable, reference_fingerprint

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_run_is_the_brute_force_pipeline(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    network = language.train(documents)
    names, scores = network.judge(pa.array([t for _, t in rows]))
    rows = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= language.LEAST_SCORE]
    component = least_reachable([(i, reference_fingerprint(t)) for i, t in rows])
    rows = [r for r, c in zip(rows, component, strict=True) if r[0] == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    verdict = brute(rows, items)
    rows = [r for r in rows if not verdict[r[0]][4]]
    scanner, codec = secrets.Scanner(), bpe.Codec(bpe.vocabulary())
    wanted = {i: codec.digest(secrets.cut(t, scanner.spans(t.encode())))[:3] for i, t in rows}
    found = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == wanted and len(found) == len(wanted)


def test_stages_keep_the_columns_of_documents(spark, documents):
    docs = documents
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == documents.columns


def test_stages_take_nulls_and_empty_tables(spark, docs_of):
    for rows in ([], [(None, None), (1, None), (2, ""), (3, "word " * 10), (3, "word " * 10)]):
        docs = docs_of(rows)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, DIR).count() <= len(rows)


def test_stages_take_columns_with_clashing_names(spark, docs_of):
    docs = docs_of([(1, "the word " * 10), (2, None), (3, "other text of some length here")])
    docs = docs.selectExpr("*", "1 AS fp", "2 AS score", "array(1) AS items", "'x' AS lang_pred", "map('a', 1) AS component_id", "current_date() AS held_out", "named_struct('a', 1) AS spans", "0 AS rank", "1 AS `a.b`", "2 AS __known", "3 AS __HIT", "4 AS __row", "5 AS __found", "6 AS Text_2")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        assert out.where("doc_id = 3").first().rank == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == 3


def test_entry_has_a_query_for_each_operator():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_take_very_long_texts(spark, docs_of):
    long = " ".join(f"word{i % 977} of the long text" for i in range(300_000))
    docs = docs_of([(1, "the " + long), (2, "the words of a short text and of the others here"), (3, "the " + long + " end")])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    rows = {r.doc_id: r for r in docs.collect()}
    assert sorted(rows) == [1, 2] and rows[1].n_tokens > 1_000_000


def test_the_entry_works_without_a_library_of_these_operators(tmp_path):
    """An import error anywhere in the training-data part takes only their queries away."""
    import subprocess
    import sys

    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tree_rollup' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    import os

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"})
