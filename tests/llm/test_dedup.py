"""SimHash components and substring dedup against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from stratalog.llm import components, simhash, sql, substrings
from tests.llm.conftest import by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def reference_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if shingles and 2 * counts[i] > len(shingles))


def least_reachable(rows):
    ids, fps = [i for i, _ in rows], np.array([f for _, f in rows], dtype=np.uint64)
    label = np.array([10**9 if i is None else i for i in ids])
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 4) for f in fps]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "\x1c", "日本", "\u00a0"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 60, 200]))] for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "oNE")]
    for i in range(5, 200):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 3, rng.choice([" ", "\r\n", "  "]).join(w)))
    return [*rows, (7, "a b c d " * 60_000), (None, rows[9][1])]


def test_fingerprints_and_components(spark, docs_of):
    rows = texts()
    found = simhash.components_of(docs_of(rows).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS root")).collect()
    got = {r.doc_id: r for r in found}
    fps = [(i, reference_fingerprint(t)) for i, t in rows]
    assert {i: f"{f:016x}" for i, f in fps} == {i: r.fingerprint for i, r in got.items()}
    assert [got[i].component_id for i, _ in rows] == least_reachable(fps)
    assert len(found) == len(rows)


def test_repeated_rows_and_empty_tables(spark, docs_of):
    rows = simhash.components_of(docs_of([(5, "x y"), (5, "x y"), (9, "x y")])).collect()
    assert [r.component_id for r in rows] == [5, 5, 5]
    assert simhash.components_of(docs_of([])).count() == 0
    kept = simhash.deduplicate(docs_of([(5, "x y"), (5, "x y"), (9, "x y"), (None, "x y"), (7, "other words altogether here"), (None, "none of these has any id"), (None, "none of these has any id")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "7", "None"]


def test_of_rows_with_one_id_the_same_one_stays(spark, docs_of):
    rows = [(5, f"text number {k} of five with words of its own: {'abcdefgh'[k] * 40}") for k in range(8)]
    kept = [simhash.deduplicate(docs_of(some).selectExpr("*", "1 AS `a.b`", "2 AS `__ROW`", "map('k', doc_id) AS m").repartition(n)).collect() for n, some in ((1, rows), (4, rows[::-1]))]
    assert kept[0] == kept[1] and len({r.doc_id for r in kept[0]}) == 1 and kept[0][0]["a.b"] == 1


def around(n, seed=1):
    """Some fingerprints, and others up to four, eight ... bits from them."""
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    for _ in range(4):
        f = out[-1].copy()
        for _ in range(4):
            f ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        out.append(f)
    return np.unique(np.concatenate(out))


def partition(fps, edges):
    joined = components.Union(len(fps))
    place = {int(f): i for i, f in enumerate(fps)}
    for a, b in edges:
        joined.join(place[int(a)], place[int(b)])
    return [joined.find(k) for k in range(len(fps))]


def all_links(fps):
    return partition(fps, ((a, b) for a in fps for b in fps[np.bitwise_count(fps ^ a) <= 4]))


@pytest.mark.parametrize("large", [64, 2])
def test_forests_lose_no_link(monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    fps = around(60)
    for keys, owners in (simhash.signatures(fps), (np.zeros(len(fps), dtype=np.uint64), fps)):
        a, b, huge = simhash.forest(keys, owners)
        assert partition(fps, zip(a, b, strict=True)) == all_links(fps) and not huge


def test_filing_again_loses_no_pair():
    rng = np.random.default_rng(4)
    for path in ("0", "1", "2", "02", "121", "2001"):
        fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        left, width = simhash.rest(fps, path)
        assert (left < np.uint64(1 << width)).all() and width == 64 - sum(simhash.segments(w)[int(d)][1] for w, d in zip(widths(path), path, strict=True))
        other = fps.copy()
        for _ in range(4):
            other ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
        met = np.zeros(len(fps), dtype=bool)
        for (_, a), (_, b) in zip(simhash.refiled(7, path, fps), simhash.refiled(7, path, other), strict=True):
            met |= a == b
        assert met.all()


def widths(path):
    out = [64]
    for d in path:
        out.append(out[-1] - simhash.segments(out[-1])[int(d)][1])
    return out[:-1]


@pytest.mark.parametrize("huge", [3, 1 << 14])
def test_links_of_huge_keys(spark, monkeypatch, huge):
    """Fingerprints that agree in two segments, so that every file of those is huge and goes through all filings."""
    monkeypatch.setattr(simhash, "HUGE", huge)
    monkeypatch.setattr(simhash, "LARGE", 2)
    fps = np.unique(np.concatenate([around(12), around(40) & np.uint64(0x3FFFFF) | np.uint64(0x5555 << 40)]))
    found = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), len(fps))[0].collect()
    edges = [(np.uint64(r.a % (1 << 64)), np.uint64(r.b % (1 << 64))) for r in found]
    assert partition(fps, edges) == all_links(fps)
    assert all(np.bitwise_count(a ^ b) <= 4 for a, b in edges)


def test_rounds_are_logarithmic(spark):
    chain = [(i, i + 1) for i in range(5000)]
    star = [(10_000, 10_001 + i) for i in range(3000)]
    rounds = []
    found = {r.node: r.root for r in components.roots(spark.createDataFrame(chain + star, "a long, b long").coalesce(2), rounds).collect()}
    assert len({found[i] for i in range(5001)}) == 1 and len({found[10_000 + i] for i in range(3001)}) == 1 and len(set(found.values())) == 2
    assert len(rounds) <= 12 and all(b <= 0.6 * a for a, b in zip(rounds, rounds[1:], strict=False) if a > 50)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 200)]
    found = {r.node: r.root for r in components.roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[100 + i] for i in range(40)}) == 1
    assert found[200] == found[300] and len(set(found.values())) == 3
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows):
    first, words = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words[i] = WORD.findall(text or "")
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def passages(seed=6):
    rng = random.Random(seed)
    words = ["a", "B", "é", "日本", "c,", "d", "\x1c", "e\u00a0f"]
    shared = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 60)]
    rows = [(0, None), (1, ""), (2, "  ")]
    for i in range(3, 80):
        w = [rng.choice(words) + (str(rng.randrange(60)) if rng.random() < 0.7 else "") for _ in range(rng.choice([5, 13, 30, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        rows.append((i * 5 - 100, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(9001, rows[20][1]), (9002, rows[20][1]), (9003, "k l m n o p q r s t u v w x y z " * 5000)]
    return rows


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_removal_in_any_number_of_batches(spark, docs_of, monkeypatch, batches):
    monkeypatch.setattr(substrings, "PIECE", 3000)
    whole = substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda docs: whole(docs, batches))
    rows = passages()
    found = by_id(substrings.deduplicate(docs_of([*rows, (None, rows[30][1])]).selectExpr("*", "1 AS starts", "2 AS text_key"), keep_text=True))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items() if i is not None} == brute_removal(rows)
    assert found[None].n_removed == 0
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found.values())


def test_batches_are_of_like_size_and_runs_are_compacted(spark, docs_of, monkeypatch):
    sizes, made = [], []
    fill, close = substrings.Index.fill, substrings.Index.close
    monkeypatch.setattr(substrings.Index, "fill", lambda self, docs: (sizes.append(docs.count()), fill(self, docs))[1])
    monkeypatch.setattr(substrings.Index, "close", lambda self: (made.append((self.compactions, len(self.runs), self.buckets)), close(self))[1])
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(substrings, "ROW_ENTRIES", 7)
    rows = [*passages(), (1 << 60, passages()[20][1])]  # one id far from the others
    rows += [(700_000, "a b c " * 10)] * 5
    found = by_id(substrings.deduplicate(docs_of(rows)))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items()} == brute_removal(rows)
    assert len(sizes) == 5 and max(sizes) <= 2 * len(rows) / 5 and made[0][0] == 1 and made[0][2] > 4


def test_lines_that_a_text_repeats(spark, docs_of):
    """A text of one line many times is sent as that line's windows once, and loses all of them if a smaller id has the line."""
    line = " ".join(f"w{i}" for i in range(15))
    rows = [(1, f"{line} a"), (2, f"{line} " * 400 + "own words"), (3, "x " * 500), (4, "x " * 12), (5, "x " * 30 + f"{line} z {line}")]
    found = by_id(substrings.deduplicate(docs_of(rows)))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items()} == brute_removal(rows)
    starts = {r.doc_id: len(r.starts) // 4 for r in substrings.repeated_windows(docs_of(rows)).collect()}
    assert starts[2] == 3 and starts[5] <= 4


def test_an_index_sees_earlier_batches_first(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(20))
    index = substrings.Index(spark, 4)
    assert index.add(docs_of([(50, text)])).count() == 0
    assert [r.doc_id for r in index.add(docs_of([(1, text), (2, "other")])).collect()] == [1]
    index.compact()
    assert len(index.runs) == len(index.digests) == 1 and index.compactions == 1
    assert [r.doc_id for r in index.add(docs_of([(0, "x " + text)])).collect()] == [0]


def test_sql_agrees_with_brute_force():
    rows = [r for r in passages() if r[0] < 9003]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    found = connection.execute(sql.ORACLES["op8_substring_dedup"]).fetchall()
    assert {r[0]: tuple(r[1:]) for r in found} == brute_removal(rows)


def test_empty_table(spark, docs_of):
    assert substrings.deduplicate(docs_of([])).count() == 0
    assert by_id(substrings.deduplicate(docs_of([(1, None), (2, None)])))[1].n_words == 0
