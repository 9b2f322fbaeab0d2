import itertools
import random

from millrace.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><!-- no -->
<article><h1>A &amp; B</h1><p>First &lt;one&gt;,
 with <b>bold</b>&nbsp;text.<p>Second.<div class="ad">Buy now!</div><ul><li>Item one.</li><li>Item two.</li></ul>
<form>Name <input></form><section id="comments"><p>I disagree with all of this, it is long.</p></section><aside>Related</aside></article>
<div class="sidebar"><p>More.</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "A & B\n\nFirst <one>, with bold text.\n\nSecond.\n\nItem one.\n\nItem two."


def test_page_without_marks():
    body = "".join(f"<p>This is sentence number {i}, and it goes on for a while.</p>" for i in range(5))
    page = f'<body><div><a href="/">Home</a> <a href="/x">About</a></div><div>{body}</div></body>'
    assert html.main_text(page).count("sentence number") == 5 and "Home" not in html.main_text(page)


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda x: sum(-o for o, k in zip(odds, x, strict=True) if k) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: E731,B023
        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(html.minimum_cut(odds, edges)) - best) < 1e-9


def test_broken_pages():
    assert html.main_text("<article><p>one<p>two &am") == "one\n\ntwo &am"
    assert html.main_text("<article><p>one</p><p>tw</p") == "one\n\ntw"
    assert html.main_text("<article>" + "<p>x.</p>" * 3000).count("x.") == 3000
    for odd in (None, "", "   ", "<", "<!--", "<script>", "<a" * 2000, "</div>" * 50):
        assert html.main_text(odd) == ""


def test_marked_spans_inside_a_paragraph():
    assert html.main_text('<article><p>one <span class="ad">BUY <span>NOW</span></span> two <span>three</span>.</p><p>four.</p></article>') == "one two three.\n\nfour."
    assert html.main_text('<article><p>one <span class="ad">BUY</p><p>two.</p></article>') == "one\n\ntwo."


def test_nothing_else_is_dropped():
    code = '<article><p>Run <code>x = 1 <span class="hljs-comment"># note</span> y</code> first.</p>'
    assert html.main_text(code) == "Run x = 1 # note y first."
    assert html.main_text('<article><p>They said <span class="alert">this very word</span> was it.</p>') == "They said this very word was it."
    essay = "".join(f"<p>An essay on poetic form has many things to say about line {i}, and it says them at length here.</p>" for i in range(4))
    for name in ("form", "search", "related", "alert", "share"):
        assert html.main_text(f'<body><div class="{name}">{essay}</div><div class="{name}"><a href="/">x</a></div></body>').count("poetic") == 4
    assert html.main_text(f'<article>{essay}<noscript><p>What readers without scripts see is this long sentence of the article itself.</p></noscript></article>').count("readers without") == 1
    assert html.main_text(f'<article>{essay}</article><div class="related"><p>Another long story of the site, which is not this one, with much to say.</p></div>').count("\n\n") == 3
    assert "enable" not in html.main_text(f"<body><noscript>Enable scripts</noscript><article>{essay}</article></body>").lower()
    assert html.main_text('<article><p>a <span hidden>b</span> c.</p></article>') == "a c."


def test_repeated_rows_and_long_pages(spark):
    page = "<article>" + "<p>A sentence of a very long page that goes on.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, page), (1, page), (1, None)], "page_id long, html string")
    assert sorted(r.n_chars for r in html.extract(df).collect()) == [0, 20_000 * 46 - 2, 20_000 * 46 - 2]


def test_rows(spark):
    rows = [(1, "u", PAGE, "old", 5), (1, "u", PAGE, "old", 5), (2, None, None, None, None), (None, "v", "", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == 4 and sorted(r["n_chars"] for r in out)[:2] == [0, 0] and all(len(r["text"]) == r["n_chars"] for r in out)
    assert html.extract(df.limit(0)).count() == 0


def learnt(spark, pages):
    return html.fitted(spark.createDataFrame([(p,) for p in pages], "h string"))


def test_the_cut_decides_where_names_tell_nothing(spark, data):
    """The given pages, then the same without classes and with plain containers: the labels by text alone lose
    or add blocks on every page, the cut mends them."""
    import re

    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect() if r["html"]]
    model = learnt(spark, pages)
    right = alone = changed = 0
    for source in pages:
        want = html.main_text(source, model)
        page = html.Page(re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", source)))
        own, cut = (model.odds(page) > 0).tolist(), model.labels(page)
        right += want == "\n\n".join(t for t, k in zip(page.texts, cut, strict=True) if k)
        alone += want == "\n\n".join(t for t, k in zip(page.texts, own, strict=True) if k)
        changed += sum(a != b for a, b in zip(own, cut, strict=True))
    assert right >= 0.98 * len(pages) and alone < 0.5 * len(pages) and changed >= len(pages) / 2


def test_articles_within_marked_layouts():
    body = "".join(f"<p>Sentence number {i} of this page is here.</p>" for i in range(4))
    for around in ('<div class="has-sidebar">{}</div>', '<form action="/all">{}</form>', '<div class="promo-layout"><div>{}</div></div>'):
        got = html.main_text("<body>" + around.format(f"<article>{body}</article><div class='sidebar'><a href='/'>More</a></div>") + "</body>")
        assert got.count("Sentence") == 4 and "More" not in got


def test_what_is_no_markup_stays():
    page = '<article><p>An icon <svg class="i"/> and a formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> stand here.</p><object><p>The fallback of an object stays too.</p></object></article>'
    assert html.main_text(page) == "An icon and a formula x=2 stand here.\n\nThe fallback of an object stays too."


def test_many_undecided_blocks_take_little_time():
    import time

    rng = random.Random(1)
    n = 4000
    odds = [rng.uniform(-1, 1) for _ in range(n)]
    edges = [(i, i + 1, rng.uniform(0.5, 2)) for i in range(n - 1)] + [(i, i + 2, 0.6) for i in range(n - 2)]
    t = time.time()
    label = html.minimum_cut(odds, edges)
    assert len(label) == n and time.time() - t < 20


def test_clashing_names_and_no_sample(spark):
    df = spark.createDataFrame([(PAGE, "a", 1)], "html string, value string, h long")
    out = html.extract(df)
    assert out.columns == ["value", "h", "text", "n_chars"] and out.first()["text"].startswith("A & B")
