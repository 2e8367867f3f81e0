import random

from stratalog.llm import extract
from tests.llm.conftest import by_id


def page(title, paragraphs, note="Read our news daily", extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f'<html><head><title>{title}</title><style>p{{}}</style></head><body><div class="x"><span>{note}</span></div><div><h1>{title}</h1>{body}</div>{extra}<footer>f</footer></body></html>'


def test_structure_decides():
    html = """<div>a<b>b</b> c<br>d<!-- x > y --><p>p1<p>p2 &amp; &#233;</div><div class="reader comments">no</div><aside>no</aside><nav>no</nav>
    <p title="a>b">x&nbsp;y</p><script>if(a<b){}</script><form>no</form><div id="ad-1">no</div><div hidden>no</div>a &lt;b&gt; < c</p>end"""
    assert extract.main_text(html) == "ab c d p1 p2 & é x y a <b> < c end"
    assert extract.main_text("<nav>n</nav>out<article><header>H</header><h1>T</h1>in<footer>no</footer></article>") == "H T in"
    assert extract.main_text("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>") == "one two a b"
    for broken in (None, "", "<", "<p", '<p a="', "</p></div>", "<!--", "<script>x", "&#xFFFFFFF;"):
        assert isinstance(extract.main_text(broken), str)
    assert extract.main_text("<div>" * 3000 + "deep") == "deep"


def tree(html):
    return extract.parse(html).measured()


def brute_score(a, b):
    if a.tag != b.tag:
        return 0
    x, y = a.elements(), b.elements()
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_score(x[i], y[j]))
    return 1 + best[-1][-1]


def test_alignment_is_simple_tree_matching():
    rng = random.Random(3)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else ''}</{t}>" for t in (rng.choice(["div", "span", "b"]) for _ in range(rng.randint(0, 3))))

    for _ in range(300):
        a, b = tree(some(3)), tree(some(3))
        score, pairs = extract.align(a, b)
        assert score == len(pairs) == brute_score(a, b) and all(x.tag == y.tag for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == score


def test_constant_nodes_become_template_and_slots_content(spark):
    rows = [(i, f"http://h.org/{i}", page(f"T{i}", [f"first {i}", f"second {i}"] * (1 + i % 3))) for i in range(30)]
    rows += [(100, "http://other.org/1", page("Alone", ["only"])), (101, None, None), (102, "x", ""), (103, "http://h.org/3", rows[3][2]), (104, "http://H.ORG/9", page("Odd", ["p"], note="Something else"))]
    rows += [(105, "http://long.org/", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS host", "1 AS salt", "2 AS text")
    found = by_id(extract.extract(pages), "page_id")
    for i in range(30):
        assert found[i].text == " ".join([f"T{i}"] + [f"first {i}", f"second {i}"] * (1 + i % 3))
    assert found[100].text == "Read our news daily Alone only"  # one page shows no template
    assert (found[101].text, found[102].text, found[101].n_chars) == ("", "", 0)
    assert found[103].text == found[3].text and found[104].text == "Something else Odd p"
    assert found[105].n_chars == 499_999 and len(found) == len(rows)
    assert extract.extract(pages.where("false")).count() == 0


def test_copies_of_one_page_make_no_template():
    assert extract.induce([page("T", ["a"])] * 5) is None


def test_all_different_pages_of_a_host_count(spark):
    rows = [(10 * h + i, f"http://h{h}.org/{i}", page(f"T{h} {i}", [f"first {i}"])) for h in range(12) for i in range(3)]  # three different pages are enough on every host
    rows += [(1000 + i, f"http://copies.org/{i}", page("Copy", ["same"])) for i in range(300)]
    rows += [(2000 + i, f"http://copies.org/other/{i}", page(f"O{i}", [f"first {i}"])) for i in range(3)]
    found = by_id(extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    for h in range(12):
        assert [found[10 * h + i].text for i in range(3)] == [f"T{h} {i} first {i}" for i in range(3)]
    assert {found[1000 + i].text for i in range(300)} == {"Copy same"}
    assert [found[2000 + i].text for i in range(3)] == [f"O{i} first {i}" for i in range(3)]


def test_template_is_what_most_pages_of_a_host_say(spark):
    # the note is on 18 of 40 pages, so that some five of them may have it mostly, but most have not
    rows = [(i, f"http://h.org/{i}", page(f"T{i}", [f"first {i}"], note="Rare note" if i % 20 < 9 else f"Own {i}")) for i in range(40)]
    for shift in range(6):
        moved = [(k, f"{u}?{shift}", h.replace("</body>", f"<i>{shift}</i></body>")) for k, u, h in rows]
        found = by_id(extract.extract(spark.createDataFrame(moved, "page_id long, url string, html string")), "page_id")
        assert all(("Rare note" if i % 20 < 9 else f"Own {i}") in found[i].text for i in range(40))


def test_long_lists_are_matched_exactly():
    rng = random.Random(5)
    kinds = ["<div><b></b></div>", "<div><i></i><i></i></div>", "<p></p>", "<span><b></b></span>", "<div></div>", "<ul><li></li></ul>"]
    for n, m in ((300, 900), (1, 40), (7, 3)):
        a, b = (tree("<main>" + "".join(rng.choices(kinds, k=k)) + "</main>") for k in (n, m))
        score, pairs = extract.align(a, b)
        small = {(x.shape, y.shape): brute_score(x, y) for x in a.elements()[0].elements() for y in b.elements()[0].elements()} if n < 300 else None
        if small is None:
            seen = {}
            best = [0] * (m + 1)
            for x in a.elements()[0].elements():
                row = [0]
                for j, y in enumerate(b.elements()[0].elements()):
                    key = (x.shape, y.shape)
                    if key not in seen:
                        seen[key] = brute_score(x, y)
                    row.append(max(best[j + 1], row[j], best[j] + seen[key]))
                best = row
            assert score == best[-1] + 2
        else:
            assert score == brute_score(a, b)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) == score


def test_deep_elements_keep_their_place():
    deep = "<div>" * 200
    assert extract.main_text(f"<div><article>{deep}text</div>{'</div>' * 199}<p>more</p></article></div>out") == "text more"
    assert extract.main_text(f"{deep}<nav>no<b>no</b></nav><aside>no</aside>yes") == "yes"
    far = tree("<b>" * 30_000 + "x"), tree("<b>" * 29_000 + "<i>x</i>")
    assert extract.align(*far)[0] == 29_001
    assert extract.main_text("<div>" * 50_000 + "deep" + "</span>" * 50_000, extract.unpacked(extract.packed(far[0]))) == "deep"


def test_template_in_long_pages_survives_an_inserted_block(spark):
    def long_page(i):
        items = [f"<p>item {i} {k}</p>" if k % 2 else f"<div>item {i} {k}</div>" for k in range(600 + i)]
        return "<body>" + ("<h2>New</h2>" if i % 2 else "") + "".join(items[:300]) + "<h3>Always here</h3>" + "".join(items[300:]) + "<h4>End</h4></body>"

    rows = [(i, f"http://long.org/{i}", long_page(i)) for i in range(6)]
    found = by_id(extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert all("Always here" not in found[i].text and "End" not in found[i].text and f"item {i} 599" in found[i].text for i in range(6))


def test_constant_lists_of_varying_links_are_menus(spark):
    def listed(i, menu):
        links = "".join(f"<div><a href='/{i}/{k}'>Topic {i} {k}</a></div>" for k in range(4))
        body = f"<div class='share widget'><p>body of {i} with <a href='x'>a link {i}</a> and more words than all the rest has together, as a body does</p><ul><li><a href='y'>own list {i}</a></li></ul></div>"
        return f"<body><div>{links if menu else ''}</div><div class='widget'>side words {i}</div>{body}<p>end {i}</p></body>"

    rows = [(i, f"http://menus.org/{i}", listed(i, True)) for i in range(8)]
    rows += [(100, "http://few.org/1", listed(100, True))]
    found = by_id(extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    for i in range(8):  # the wrapper tells the menu from the body, and a doubtful word does not drop what holds most of the text
        assert found[i].text == f"body of {i} with a link {i} and more words than all the rest has together, as a body does own list {i} end {i}"
    assert found[100].text == "Topic 100 0 Topic 100 1 Topic 100 2 Topic 100 3 end 100"  # one page of a host: only its own markup counts


def test_every_host_of_the_sample_has_a_wrapper_with_parts(spark):
    pages = extract.common.read(spark, "/root/testdata/sf0.01", "pages")
    narrow = pages.select("page_id", "url", extract.host(pages.url).alias("host"), "html")
    enough = narrow.groupBy("host").agg({"html": "approx_count_distinct"}).where("`approx_count_distinct(html)` >= 3").count()
    made = [extract.unpacked(r.wrapper) for r in extract.wrappers(narrow).collect()]
    assert len(made) == enough and all(any(n.part == extract.BODY for n in w.walk()) for w in made)


BLOCK_TAGS = "article aside blockquote br div footer form h1 h2 header li main nav ol p section table td tr ul".split()


def brute_text(page):
    """Well-formed markup without a wrapper, read by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.blocks, self.tops = [], [""], 0

        def handle_starttag(self, tag, attrs):
            words = set((dict(attrs).get("class") or "").split())
            gone = bool(self.open and self.open[-1][1]) or tag in extract.DROPPED_TAGS or bool(words & (extract.DROPPED_WORDS | extract.DOUBTFUL_WORDS))
            if tag in BLOCK_TAGS:
                self.blocks.append("")
            if tag != "br":
                self.open.append((tag, gone, tag == "article" or bool(self.open and self.open[-1][2])))

        def handle_endtag(self, tag):
            self.open.pop()
            if tag in BLOCK_TAGS:
                self.blocks.append("")

        def handle_data(self, data):
            if self.open and not self.open[-1][1] and (self.open[-1][2] or not self.article):
                self.blocks[-1] += data

    reader = Reader()
    reader.article = "<article" in page
    reader.feed(page)
    return " ".join(t for b in reader.blocks if (t := " ".join(b.split())))


def test_whole_texts_agree_with_brute_force():
    rng = random.Random(11)
    words = ["one", "zwei", "trois &amp; more", "  four\n", "&#233;t&eacute;", "x<b>y</b>z"]

    def some(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "p", "section", "ul", "nav", "aside", "span", "i", "div class='ad'", "div class='social'", "div class='text'", "footer"])
            name = tag.split()[0]
            inner = f"<li>{rng.choice(words)}</li>" * 2 if name == "ul" else rng.choice(words) if name == "p" or not depth else some(depth - 1)
            out.append(f"<{tag}>{inner}</{name}>" if name not in ("span", "i") else f"<{tag}>{rng.choice(words)}</{name}> ")
        return rng.choice(words).join(out)

    for k in range(300):
        page = f"<html><body><nav><ul><li>m</li></ul></nav>{some(2)}" + (f"<article><h1>T{k}</h1>{some(2)}</article>" if k % 2 else "") + "<footer>f</footer></body></html>"
        assert extract.main_text(page) == brute_text(page)


def test_sample_pages_give_their_articles(spark):
    """The sample's pages have one article each: its text, read by plain patterns, is what the query returns."""
    import html
    import re

    pages = extract.common.read(spark, "/root/testdata/sf0.01", "pages")
    found = by_id(extract.extract(pages), "page_id")
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|article)\b[^>]*>", inner)
        text = " ".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))
        assert found[r.page_id].text == text


def test_wrappers_find_menus_and_bodies_that_no_tag_names(spark):
    """The sample's menus and articles as plain divs: on hosts with enough pages, the wrapper alone gives the same text."""
    from pyspark.sql import functions as F

    pages = extract.common.read(spark, "/root/testdata/sf0.01", "pages")
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)(?:nav|article)>", "<$1div>"))
    whole, bare = (by_id(extract.extract(x), "page_id") for x in (pages, plain))
    hosts = {}
    for r in pages.collect():
        hosts.setdefault(r.url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower(), set()).add((r.page_id, r.html))
    some = [i for h in hosts.values() if len({x for _, x in h}) >= 3 for i, _ in h]
    assert len(some) > 200 and all(bare[i].text == whole[i].text for i in some)
    alone = [i for h in hosts.values() if len({x for _, x in h}) < 3 for i, _ in h]
    assert all(bare[i].text != whole[i].text for i in alone)  # where there is no wrapper, menus stay


def test_a_page_repeated_very_often_is_one_reference(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", page(f"T{i}", [f"p{i}"])) for i in range(4)], "page_id long, url string, html string")
    row = pages.where("page_id = 0").first()
    both = pages.unionByName(spark.range(20_000).selectExpr("0L AS page_id", f"'{row.url}' AS url", f"'{row.html}' AS html"))
    narrow = both.select("page_id", "url", extract.host(both.url).alias("host"), "html")
    known = narrow.where(extract.F.length("html") > 0).withColumns({"digest": extract.F.unhex(extract.F.md5(extract.F.col("html").cast("binary"))), "rank": extract.F.xxhash64("page_id", "url")})
    different = extract.common.written(known.groupBy("host", "digest").agg(extract.F.min("rank").alias("rank")), "different")
    plan = extract.frames(known, different)._jdf.queryExecution().toString()
    assert different.count() == 4 and "Aggregate" in plan
    texts = extract.extract(both).groupBy("page_id", "text").count().collect()
    assert {(r.page_id, r.text, r["count"]) for r in texts} == {(0, "T0 p0", 20_001), (1, "T1 p1", 1), (2, "T2 p2", 1), (3, "T3 p3", 1)}
