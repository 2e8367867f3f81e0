import hashlib
import pickle
import random
import re

import duckdb
import pytest

from stratalog.llm import decontaminate, sql
from tests.llm.conftest import by_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = {}
    for doc_id, text in docs:
        w, hit, who = split(text), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    who |= found
        out[doc_id] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def cases(seed=1):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "é", "Ünder", "日本", "x1", "2", "K", "the", "of"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 13, 14, 30])))) for i in range(9)]
    items += [(9, None), (10, ""), (11, "!!"), (12, items[0][1]), (None, "alpha alpha of"), (100, "Zeta")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "zeta, ZETA; zeta2 zeta")]
    for i in range(4, 60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 40, 300]))]
        if rng.random() < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = split(rng.choice(items[:9])[1])
        docs.append((i, rng.choice([" ", ", ", "\n-"]).join(words)))
    return docs + [(60, docs[20][1]), (61, "alpha " * 50_000)], items


@pytest.mark.parametrize("limit", [1 << 20, 10], ids=["broadcast", "join"])
def test_against_brute_force(spark, docs_of, limit):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS doc_id")
    found = decontaminate.scan(docs_of(docs).selectExpr("*", "0 AS n_words", "0 AS items", "0 AS h"), benchmark, limit=limit)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    assert got == brute(docs, items)


def test_sql_agrees_with_brute_force():
    docs, items = cases(7)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in docs[:-1]])
    connection.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(r) for r in items])
    found = connection.execute(sql.ORACLES["op1_decontaminate"]).fetchall()
    assert {r[0]: tuple(r[1:]) for r in found} == brute(docs[:-1], items)


def test_spans_can_be_removed(spark, docs_of):
    text = "Été one two three, end"
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    row = decontaminate.scan(docs_of([(1, text)]), benchmark).first()
    assert decontaminate.remove_spans(text, [(s.start, s.end) for s in row.spans]) == "Été , end"
    assert decontaminate.remove_spans(None, []) is None


def brute_cut(text, items):
    """text without the words under any window of the items, character by character."""
    at = [(m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]
    w, hit = split(text), set()
    for item, other in items:
        g = split(other)
        n = min(13, len(g))
        for j in range(len(g) - n + 1 if n and item is not None else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == g[j : j + n]:
                    hit |= set(range(k, k + n))
    out, last = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[last : at[k][0]])
        last = at[k][1]
    return None if text is None else "".join([*out, text[last:]])


@pytest.mark.parametrize("limit", [1 << 20, 10], ids=["broadcast", "join"])
def test_passages_are_cut_out_of_tables(spark, docs_of, limit):
    docs, items = cases(5)
    docs = [*docs[:-1], (None, docs[20][1]), (20, "alpha " * 40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = docs_of(docs).selectExpr("*", "true AS __hit", "1 AS __SPANS", "2 AS `a.b`")
    kept = decontaminate.remove_passages(frame, benchmark, limit)
    assert kept.schema == frame.schema
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=key) == sorted([(i, brute_cut(t, items)) for i, t in docs], key=key)
    assert decontaminate.remove_documents(frame, benchmark, limit).columns == frame.columns


def test_the_set_is_small():
    rng = random.Random(1)
    rows = [(str(k), " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))) for k in range(200)]
    made = decontaminate.WindowSet(rows + rows[:50])
    size = sum(len(t) for _, t in rows)
    assert len(pickle.dumps(made)) < 7 * 1.25 * size + (2 << 20) and sum(len(w.hashes) for w in made.windows.values()) == 200 * 388


def test_documents_are_removed_and_repeated_rows_stay(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = docs_of([(1, "one two three"), (2, "four"), (2, "four"), (None, "five"), (3, None)])
    for limit in (1 << 20, 1):
        kept = decontaminate.remove_documents(docs, benchmark, limit)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "five"), (2, "four"), (2, "four"), (3, "")]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert by_id(decontaminate.scan(docs_of([(1, "a b")]), none))[1].n_hit == 0
    assert decontaminate.scan(docs_of([]), none).count() == 0
