"""Operators on vectors and pages against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.llm import metric, pages, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def clustered(seed, n, size=16, noise=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 6, size))
    return (centres[draw.integers(0, len(centres), n)] + noise * draw.normal(size=(n, size))).astype(np.float32)


ODD = [
    (9001, None, 1), (9002, [1.0] * 15 + [None], 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [0.0] * 15, 1),
    (9005, [0.0] * 16, 1), (9006, [1.0] * 16, None), (9007, [1.0, 2.0], 1), (9050, [], 1), (9100, [1.0, 2.0], 1),
]


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    found = clustered(0, 500)
    found[7] = found[3]  # ties
    ids = list(range(500)) + [0, 1, 2, 7, 50]  # rows that repeat an id stay rows of their own
    found = np.concatenate([found, found[:3], found[20:22]])
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, found)] + ODD + [(5, [float("nan")] * 16, 0), (100, None, 0)]
    table = spark.createDataFrame(rows, VECTORS).withColumn("ids", F.lit("x")).withColumn("asks", F.lit(1)).repartition(3)
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, 5).collect()
    whole = np.floor(256 * found.astype(float)).astype(np.int64)
    want = []
    for q in range(len(ids)):
        if ids[q] % 50 == 0:
            scores = whole @ whole[q]
            best = sorted((c for c in range(len(ids)) if c != q), key=lambda c: (-scores[c], ids[c]))[:5]
            want += [(ids[q], k + 1, ids[c], scores[c]) for k, c in enumerate(best)]
    assert sorted(tuple(r) for r in got if r.query_id < 9000) == sorted(want)
    assert [tuple(r)[:3] for r in got if r.query_id > 9000] == [(9100, 1, 9007)]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("cell", [16, 100_000])
def test_near_vectors_are_exact(spark, monkeypatch, cell):
    monkeypatch.setattr(metric, "CELL", cell)
    monkeypatch.setattr(metric, "BLOCK", 32)
    found = clustered(1, 600, noise=0.06)
    found[10:60] = found[10]  # a class of copies
    found[60:110] = found[10] + 0.002 * found[60:110]  # a dense group
    label = np.arange(600) % 2
    rows = [(i, v.tolist(), int(label[i])) for i, v in enumerate(found)] + ODD
    got = {r.id: r for r in metric.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(7), 0.98).collect()}
    unit = found.astype(float) / np.linalg.norm(found.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(600, dtype=bool)
    part = np.arange(600)
    while True:
        low = np.where(linked, part[None, :], 600).min(axis=1)
        new = np.minimum(part, low)
        if (new == part).all():
            break
        part = new
    assert len(got) == len(rows) and linked.sum() > 1000
    for i in range(600):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), part[i], part[i] == i)
    assert all(got[i].n_links == (i in (9007, 9100)) for i, _, _ in ODD)
    assert got[9100].component_id == 9007


def test_pivots_replicate_what_the_triangle_inequality_asks_for():
    draw = np.random.default_rng(3)
    found = draw.normal(size=(400, 3))
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    reach = 0.2
    home, cells = {}, {}
    for row, cell, own in metric.homes(found, found[:6], reach):
        for r, c, o in zip(row, cell, own):
            cells.setdefault(r, set()).add(c)
            if o:
                home[r] = c
    apart = np.linalg.norm(found[:, None] - found[None], axis=2)
    assert all(home[a] in cells[b] for a in range(400) for b in np.flatnonzero(apart[a] <= reach))
    assert sum(map(len, cells.values())) < 400 * 6


def test_vectors_without_ids_and_empty_tables(spark):
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.001], 1), (4, [0.0, 1.0], 1)]
    got = metric.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.id if r.id is not None else 99, r.n_links, r.component_id) for r in got) == [(3, 2, 3), (3, 2, 3), (4, 0, 4), (99, 2, 3)]
    assert metric.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><div id="cookie-banner">We use cookies</div><nav><ul><li>Home<li>News</ul></nav>
<div class="wrap"><main><article><header><h1>Caf&eacute; &amp; co</h1></header><p>One<br>two <a href="x">link</a>,
 <b>bold</b>.<ul><li>a<li>b</ul><span class="share">Share!</span><div class="x9">{again}</div><p>{own}<!-- c --></article>
<section id="comments"><article><p>Nice post</p></article></section></main></div>
<aside>side</aside><form><p>Name</p><input></form><footer>(c) now</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE.replace("{again}", "Sign up for updates").replace("{own}", f"Own words {i}")) for i in range(12)]
    rows += [
        (50, "http://other.example.com/", "<p>First<p>Second &lt;b&gt; <i>x</i>y<div>Third\n  line</div>tail"), (51, None, None), (52, "u", ""),
        (53, "http://h.example.com/x", "plain text only"), (53, "http://h.example.com/x", "plain text only"),
        (54, "http://h.example.com/y", "<article><p>cut off <b"), (None, "http://h.example.com/z", "<div>a</div>" * 3000),
    ]
    table = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, host string")
    got = pages.main_text(table).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"page_id", "url", "host", "text", "n_chars"}
    for i in range(12):
        assert by[i].text == f"Café & co\nOne two link, bold.\na\nb\nOwn words {i}", by[i].text
    assert by[50].text == "First\nSecond <b> xy\nThird line\ntail"
    assert (by[51].text, by[52].text, by[53].text, by[54].text) == ("", "", "plain text only", "cut off")
    assert by[None].text.count("\n") == 2999 and all(r.n_chars == len(r.text) for r in got)
    assert pages.main_text(table.limit(0)).collect() == []


@pytest.mark.parametrize("start", ["<!-->", "<!--->", "<!-- a --!>", "<!-- <b> -- > -->"])
def test_comments_end_as_browsers_end_them(spark, start):
    assert _texts(spark, [f"<article><h1>T</h1>{start}<p>Body</p></article>"]) == ["T\nBody"]


def test_words_in_longer_names_are_only_a_prior(spark):
    bodies = [f'<article><h1>T{i}</h1><div class="comments-are-fun"><p>Body {i}</p></div><section id="reply-rates"><p>Rates {i}</p></section></article>'
              f'<div class="comment-list"><p>Reader {i}</p></div>' for i in range(25)]
    assert _texts(spark, bodies) == [f"T{i}\nBody {i}\nRates {i}" for i in range(25)]
    whole = '<div class="comments-are-fun"><p>All of it</p></div>'
    assert _texts(spark, [whole]) == ["All of it"]


def test_small_hosts_and_copies_keep_their_text(spark):
    page = "<html><body><article><h1>Same</h1><p>words of the copy</p></article><div>note</div></body></html>"
    table = spark.createDataFrame([(i, f"http://{'a' if i < 3 else 'b'}.example.com/{i}", page) for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in pages.main_text(table).collect()} == {"Same\nwords of the copy"}


def _texts(spark, bodies, host="big.example.com"):
    rows = [(i, f"http://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_importance_decides_inside_articles_and_against_marks(spark):
    bodies = [
        f"<article><h1>Title {i}</h1><p>Own words {i}</p><p>Read our terms</p><div class='share-price'>Price <b>{i}.50</b></div>"
        f"<div class='share'>Tell others</div><p>Now <span class='share-price'>{i} francs</span>, <span class='share'>share</span> up</p></article>"
        f"<div class='note'>Remark {i}</div><div class='foot'>All rights kept</div><div class='ad'>Buy {i}</div>"
        for i in range(60)
    ]
    want = [f"Title {i}\nOwn words {i}\nPrice {i}.50\nNow {i} francs, up\nRemark {i}" for i in range(60)]
    assert _texts(spark, bodies) == want
    # copies of one article count once, so that they don't erase it
    assert _texts(spark, [*bodies, *[bodies[0].replace("Buy 0", f"Buy more {i}") for i in range(100)]]) == [*want, *[want[0]] * 100]


def test_a_mark_on_the_whole_page_and_small_hosts(spark):
    whole = "<div class='has-sidebar'><p>Text of the page, long enough</p><div class='ad'>Buy</div></div>"
    assert _texts(spark, [whole]) == ["Text of the page, long enough"]
    few = [f"<div class='x'>Always here</div><div class='y'>Only {i}</div>" for i in range(7)]
    assert _texts(spark, few) == [f"Only {i}" for i in range(7)]
    assert _texts(spark, few[:3]) == [f"Always here\nOnly {i}" for i in range(3)]


@pytest.mark.parametrize("tag", [
    "<svg/>", "<svg />", "<math/>", "<iframe/>", "<iframe src='x' />", "<iframe src='x'>in</iframe>", "<video-player></video-player>", "<title-bar>",
    "<svg-icon></svg-icon>", "<svg><path d='M0'/><title>t</title><text>in</text></svg>", "<video><p>in</p></video>", "<button>", "<object>", "<canvas>",
    "<select><option>in<option>in</select>", "<template><article><p>in</article></template>", "<script>in</script x>", "<button><div>in</div></button>",
])
def test_text_after_embedded_elements_stays(tag):
    def text(page):
        return [b[1] for b in pages.blocks_of(page)[0]]

    assert text(f"<article><h1>T</h1>{tag}<p>Body</p></article><footer>f</footer>") == ["T", "Body"]
    assert text(f"<article><h1>T</h1><ul><li>a {tag}</li><li>b</ul><p>Body <i>x</i></article>") == ["T", "a", "b", "Body x"]
    assert " ".join(text(f"<article><p>one {tag}two</p><p>Body</p></article>")) == "one two Body"


def test_query_blocks_are_numbered_without_their_vectors(spark):
    def windows(node):
        found = [node.output().mkString(" ")] if node.nodeName() == "Window" else []
        below = node.children()
        return found + [x for i in range(below.size()) for x in windows(below.apply(i))]

    table = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(200)], VECTORS)
    found = windows(topk.top_k(table, F.col("vec_id") % 50 == 0, 5)._jdf.queryExecution().optimizedPlan())
    assert any("block" in x for x in found) and not any("columns" in x for x in found), found


def test_a_line_of_some_articles_stays(spark):
    bodies = [f"<article><h1>Title {i}</h1><p>{'Some share this' if i % 4 == 0 else f'Own {i}'}</p></article>" for i in range(400)]
    assert [t.split("\n")[1] for t in _texts(spark, bodies)][:2] == ["Some share this", "Own 1"]
