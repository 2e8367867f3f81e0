"""The trained operators: language, toxicity, URL filter.  Held-out accuracy and defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import common, language, toxicity, urlfilter
from tests.llm.conftest import by_id

SOUNDS = {"en": "the ing ould tion with and that er".split(), "de": "der ung sch ein ich und zu ße".split(), "fr": "les eau eux que tion ç é de la".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def out_of_sample(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_rows(spark):
    rows = spark.range(200).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in rows] == [out_of_sample(r.id) for r in rows]


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(4)
    return [(i, prose(rng, lang, rng.choice([3, 20, 400])), lang) for i in range(400) for lang in [rng.choice(list(SOUNDS))]]


@pytest.fixture(scope="module")
def network(spark, spoken):
    return language.train(spark.createDataFrame([*spoken, (900, None, "en"), (901, "x", None), (None, "x", "en"), (902, "123", "en")], "doc_id long, text string, lang string"))


def test_language_of_held_out_texts(docs_of, spoken, network):
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 ?!", None), (903, "ça", "en"), (904, prose(random.Random(1), "de", 60_000), None), (905, spoken[0][1], None), (906, spoken[0][1], "zz")]
    rows = by_id(language.predict(docs_of([*spoken, *extra]).selectExpr("*", "1 AS score", "true AS held_out_"), network))
    tested = [(r, lang) for i, _, lang in spoken if out_of_sample(i) for r in [rows[i]]]
    assert all(r.held_out for r, _ in tested) and np.mean([r.lang_pred == lang for r, lang in tested]) > 0.95
    assert [(rows[i].lang_pred, rows[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert rows[904].lang_pred == "de" and rows[905].score == rows[906].score == rows[0].score
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_gradient_is_the_slope():
    net, rng = language.Network(["a", "b"]), np.random.default_rng(1)
    x, y = rng.integers(0, 158, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        p = net.probabilities(x)
        return -np.log(p[np.arange(6), y]).mean()

    g = net.gradients(x, y)[-1]
    before, step = loss(), 1e-2
    net.out[3, 1] += step
    assert abs((loss() - before) / step - g[3, 1]) < 5e-3


def test_language_without_anything_to_learn(docs_of):
    net = language.train(docs_of([(1, None, "en"), (2, "abc", None)]).select("doc_id", "text", "lang"))
    assert by_id(language.predict(docs_of([(1, "abc")]), net))[1].lang_pred == "und"
    assert language.predict(docs_of([]), net).count() == 0


def test_language_filter_keeps_columns(docs_of, network):
    docs = docs_of([(1, prose(random.Random(3), "fr", 50)), (2, "123"), (3, None), (4, prose(random.Random(3), "en", 50))])
    kept = language.keep_known(docs, network)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [1, 4]


@pytest.fixture(scope="module")
def toxic_set(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1200):
        toxic, words = rng.random() < 0.15, prose(rng, "en", rng.choice([20, 80, 200])).split()
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorg", "Blarg", "quxious", "vrak" + rng.choice(SOUNDS["en"])]))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_texts(spark, docs_of, toxic_set):
    docs, labels = toxic_set
    frame, marks = docs_of([*docs, (5000, None), (5001, ""), (5002, docs[3][1]), (5003, "zorg blarg " * 90_000)]), spark.createDataFrame([*labels, (7, None), (None, 1), labels[0]], "doc_id long, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), marks)
    rows, truth = by_id(toxicity.score(frame.selectExpr("*", "1 AS score"), model)), dict(labels)
    tested = [(rows[i].predicted, y) for i, y in truth.items() if out_of_sample(i)]
    assert np.mean([p == y for p, y in tested]) > 0.95 and np.mean([p for p, y in tested if y]) > 0.9
    assert rows[5000].score == rows[5001].score and 0 <= rows[5001].score < toxicity.THRESHOLD
    assert rows[5002].score == rows[3].score and rows[5003].predicted == 1


def test_toxicity_labels_of_the_held_out_quarter_are_not_used(spark, docs_of, toxic_set):
    docs, labels = toxic_set
    frame = docs_of(docs).select("doc_id", "text")
    turned = [(i, 1 - y if out_of_sample(i) else y) for i, y in labels]
    a, b = (toxicity.train(frame, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a.bias == b.bias and (a.keys == b.keys).all() and (a.weights == b.weights).all()


def test_toxicity_without_positives(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert by_id(toxicity.score(docs_of([(1, "a")]), toxicity.train(docs_of([(1, "a")]).select("doc_id", "text"), none)))[1].score == 0
    assert toxicity.score(docs_of([]), toxicity.train(docs_of([]).select("doc_id", "text"), none)).count() == 0


def test_risk_is_not_negative_where_positives_fill_the_unlabelled_text():
    positive = [np.array([2, 4], dtype=np.uint64)] * 30
    model = toxicity.fit(positive, positive + [np.array([8], dtype=np.uint64)] * 10, prior=0.9)
    assert np.isfinite(model.bias) and np.isfinite(model.weights).all()


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "https://a.example.com/en/x?q=1#f", "https://a.example.com/EN/x", "http://x.com", "http://x.com/", "http://x.com?y=/en/",
    "http://com/z", "http://xcom/z", "ftp://a.net/es/1", "http://a.net/fr/", "http://a.net/de/", "http://b.org/en/5.html", "http://b.org/en/5.html", "http://www.example.com/en", "a://b://c/d", "http://example.com/en/1", "http://é.com/" + "9" * 20_000,
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS bin_hyphens", "2 AS suffix")
    rows = by_id(urlfilter.judge(pages), "page_id")
    import re

    for i, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            raw = re.match(r"[^/?#]*", rest)[0]
            host, path = "".join(c.lower() if c.isascii() else c for c in raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best and best.host + best.path), url
        assert rows[i].verdict in ("allow", "block") and (best is None or rows[i].verdict == ("block" if best.blocks else "allow"))
    assert rows[15].verdict == rows[16].verdict


def test_trees_learn_what_rules_label(spark):
    rng = random.Random(2)
    rows = [(f"http://{rng.choice('abc')}.{rng.choice(['com', 'net'])}/{'x' * rng.randint(1, 9)}/{rng.randint(0, 10**6)}", i) for i in range(800)]
    frame = spark.createDataFrame(rows, "url string, i long")
    host, path = urlfilter.parts(frame.url)
    known = urlfilter.lexical(frame.withColumns({"host": host, "path": path})).withColumn("blocked", (frame.url.contains(".net/")) & (frame.url.rlike("/x{5,}/")))
    model = urlfilter.train(known.where("i % 4 <> 2"))
    tested = urlfilter.binned(urlfilter.with_affixes(known.where("i % 4 = 2"), model), model.cuts).select(((model.margin() > 0) == known.blocked).cast("int").alias("ok")).collect()
    assert np.mean([r.ok for r in tested]) > 0.95


def test_url_statistics_of_every_section(spark):
    rows = [(f"http://h.com/s{k:04d}/{i}", k % 2 == 0) for k in range(1500) for i in range(2)]
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    host, path = urlfilter.parts(frame.url)
    known = urlfilter.lexical(frame.withColumns({"host": host, "path": path}))
    found = urlfilter.with_affixes(known, urlfilter.train(known)).collect()
    assert len(found) == 3000
    assert all((r.section_blocked, r.section_share, r.suffix_share) == (0.75 if r.blocked else 0.25, 2 / 3000, 1.0) for r in found)


def test_url_filter_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://b.org/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urlfilter.judge(pages).collect()} == {"allow"}
    assert urlfilter.judge(pages.where("false")).count() == 0


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    plan = urlfilter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_hashes_do_not_depend_on_place():
    words = common.Words(*common.utf8(pa.array(["ab cd", "x ab", None, "cd ab cd"])), common.byte_class(range(97, 123)))
    h = words.hashes().tolist()
    assert h[0] == h[3] == h[5] and h[1] == h[4] == h[6] and len(set(h)) == 3


def test_language_network_against_a_plain_forward_pass():
    """One text at a time, one filter place at a time, without pair tables or batches."""
    rng = random.Random(3)
    net = language.Network(["a", "b", "c"])
    net.biases = {w: np.float32(0.05) * np.arange(language.FILTERS, dtype=np.float32) for w in language.WIDTHS}
    texts = ["Ab1 é", prose(rng, "fr", 90), "日本" * 70, " ", None, "12"]
    names, scores = net.judge(pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        raw = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            assert (name, score) == ("und", 0.0)
            continue
        total, n = np.zeros(3), 0
        for at in range(0, len(raw), language.WINDOW):
            x = [int(language.byte_classes()[b]) for b in raw[at : at + language.WINDOW]]
            x += [0] * (language.WINDOW - len(x))
            hidden = []
            for w in language.WIDTHS:
                for f in range(language.FILTERS):
                    best = max(sum(float(net.filters[w][k][x[p + k]][f]) for k in range(w)) for p in range(language.WINDOW - w + 1))
                    hidden.append(max(0.0, best + float(net.biases[w][f])))
            z = [sum(h * float(net.out[i][c]) for i, h in enumerate([*hidden, 1.0])) for c in range(3)]
            e = np.exp(np.array(z) - max(z))
            total, n = total + e / e.sum(), n + 1
        assert name == "abc"[int(np.argmax(total / n))] and abs(score - (total / n).max()) < 1e-4


def test_every_language_can_be_predicted(spark):
    rows = [(i, f"{chr(0x4E00 + i // 5)}" * 40, f"l{i // 5:03d}") for i in range(5 * 260)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), together=600)
    assert len(net.languages) == 260


def test_samples_of_repeated_ids_are_bounded(spark, monkeypatch):
    """One id, and one row, a hundred thousand times: what reaches the driver stays small, and the others are still learned."""
    rng, seen = random.Random(5), []
    fit, learn = language.Network.fit, toxicity.fit
    monkeypatch.setattr(language.Network, "fit", lambda self, windows, labels, **k: (seen.append(len(windows)), fit(self, windows, labels, steps=200))[1])
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior: (seen.append(len(positive) + len(unlabelled)), learn(positive, unlabelled, prior))[1])
    rows = [(k, prose(rng, lang, 12) + (" zorg blarg" if k % 3 == 0 else ""), lang) for k in range(1, 300) for lang in [rng.choice(list(SOUNDS))]]
    hot = next(k for k in range(1000, 2000) if not out_of_sample(k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    same = spark.range(100_000).selectExpr(f"{hot} AS doc_id", "'the same and the same ing' AS text", "'en' AS lang")
    other = spark.range(3000).selectExpr(f"{hot} AS doc_id", "concat('der text und ', id) AS text", "'de' AS lang")
    docs = docs.unionByName(same).unionByName(other)
    net = language.train(docs, per_language=50)
    assert seen.pop() <= 3 * 50 * language.WINDOWS_PER_TEXT and net.languages == ["de", "en", "fr"]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1, 300)] + [(hot, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), labels, positives=60, unlabelled=200)
    assert 60 < seen.pop() <= 260 and len(model.keys)
    room = toxicity.train(docs.select("doc_id", "text"), labels, positives=60, unlabelled=200, room=2000)
    assert seen.pop() < 60 and room.prior == model.prior


def test_the_risk_by_single_texts():
    """The estimator from its definition, one text at a time; and the trained model has less of it than the one it started from."""
    rng = np.random.default_rng(2)
    zp, zu, prior = rng.normal(size=40), rng.normal(size=90), 0.3
    up = lambda z: np.log(1 + np.exp(-z))
    down = lambda z: np.log(1 + np.exp(z))
    positive, negative = toxicity.risk(zp, zu, prior)
    assert abs(positive - prior * sum(up(z) for z in zp) / 40) < 1e-12
    assert abs(negative - (sum(down(z) for z in zu) / 90 - prior * sum(down(z) for z in zp) / 40)) < 1e-12
    texts = [np.unique(rng.integers(1, 40, 8)).astype(np.uint64) * np.uint64(2) for _ in range(200)]
    marked = [np.append(t, np.uint64(1000)) for t in texts[:60]]
    unlabelled = texts[60:] + [np.append(t, np.uint64(1000)) for t in texts[:30]]
    model = toxicity.fit(marked, unlabelled, 0.18)
    margin = lambda rows: np.array([model.bias + model.weights[np.isin(model.keys, t)].sum() for t in rows])
    total = lambda a, b: sum(max(0.0, x) for x in toxicity.risk(a, b, 0.18))
    assert total(margin(marked), margin(unlabelled)) < total(np.full(60, -1.0), np.full(len(unlabelled), -1.0))
    assert np.mean(margin(marked) > 0) == 1


def test_very_long_toxic_texts_are_learned_from(spark):
    rows = [(k, ("zorg blarg vrak " * 100_000 if k < 24 else "calm words of a day number ") + str(k)) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k < 24)) for k in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, labels)
    assert len(model.keys) and by_id(toxicity.score(spark.createDataFrame([(1, "zorg blarg vrak zorg blarg vrak zorg")], "doc_id long, text string"), model))[1].predicted == 1


def test_a_tree_is_the_best_of_all():
    """grow() against the gain of every split, counted from the rows."""
    rng = random.Random(6)
    cells = [urlfilter.Cell(float(rng.random() < 0.4), rng.randint(1, 5), tuple(rng.randint(0, 3) for _ in urlfilter.FEATURES)) for _ in range(120)]
    margins = [rng.uniform(-1, 1) for _ in cells]
    slopes = [(c.n * (c.label - 1 / (1 + np.exp(-m))), c.n / (1 + np.exp(-m)) / (1 + np.exp(m))) for c, m in zip(cells, margins, strict=True)]

    def gain(rows, place, cut):
        sides = [[slopes[i] for i in rows if (cells[i].bins[place] <= cut) == left] for left in (True, False)]
        value = lambda x: sum(g for g, _ in x) ** 2 / (sum(h for _, h in x) + urlfilter.SMOOTH)
        return value(sides[0]) + value(sides[1]) - value(sides[0] + sides[1])

    after = list(margins)
    tree = urlfilter.grow(cells, after)
    every = list(range(len(cells)))
    best = max(gain(every, p, c) for p in range(len(urlfilter.FEATURES)) for c in range(3))
    feature, cut, left, right = tree
    assert abs(gain(every, urlfilter.FEATURES.index(feature), cut) - best) < 1e-9

    def value(t, bins):
        while not isinstance(t, float):
            t = t[2] if bins[urlfilter.FEATURES.index(t[0])] <= t[1] else t[3]
        return t

    assert all(abs(b - a - value(tree, c.bins)) < 1e-12 for a, b, c in zip(margins, after, cells, strict=True))
    leaf = [i for i in every if value(tree, cells[i].bins) == value(tree, cells[0].bins)]
    assert abs(value(tree, cells[0].bins) - urlfilter.RATE * sum(slopes[i][0] for i in leaf) / (sum(slopes[i][1] for i in leaf) + urlfilter.SMOOTH)) < 1e-9
