import itertools
import math
import re
from collections import Counter
from html import unescape

import pytest

from stayline.llm import extract
from stayline.llm.pages import Writer, html


@pytest.fixture(scope="module")
def model(spark):
    return extract.trained(spark, pages=500)


def gold(part):
    out = []

    def walk(x):
        for c in x.children:
            if isinstance(c, str):
                out.append(re.sub(r"<[^>]*>", "", c.replace("<br>", " ")) if x.label else "")
            else:
                out.append(" ")
                walk(c)
                out.append(" ")

    walk(part)
    return " ".join(unescape("".join(out)).split())


def test_pages_never_trained_on(model):
    shares, exact = [], 0
    for k in range(300):
        page = Writer(10**9 + k).page()
        want, got = gold(page), extract.main_text(html(page), model)
        a, b = Counter(want.split()), Counter(got.split())
        shares.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
        exact += want == got
    assert sum(shares) / len(shares) > 0.97 and exact > 270


def test_marginals_equal_enumeration(model):
    nodes, _ = extract.parse("<body><div class=ad>x</div><article><h1>Title</h1><p>Some text. More.</p><aside><p>Other.</p></aside></article></body>")
    shown = extract.evidence(nodes)
    n = len(nodes)
    own = [1 / (1 + math.exp(-sum((model.weights.get(e, 0.0) for e in s), model.weights["bias"]))) for s in shown]
    total, ones = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        weight = own[0] if y[0] else 1 - own[0]
        for i in range(1, n):
            e = model.edges.get(f"{nodes[nodes[i].parent].tag} {nodes[i].tag}") or model.edges.get(nodes[i].tag, model.other)
            weight *= (own[i] if y[i] else 1 - own[i]) * e[2 * y[nodes[i].parent] + y[i]]
        total += weight
        for i in range(n):
            ones[i] += weight * y[i]
    assert extract.marginals(nodes, model) == pytest.approx([x / total for x in ones], abs=1e-9)


def test_text_rules(model):
    page = '<html><head><title>no</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/a">No</a></li></ul></nav><!-- no --><article><h1>A &amp;  B</h1><p>One <b>t</b>wo&nbsp;three.<br>Four\n five, and so on it goes.<p>Open &lt;p&gt; and <i>more</i>.</article><footer>&copy; No.</footer>'
    assert extract.main_text(page, model) == "A & B One two three. Four five, and so on it goes. Open <p> and more."


@pytest.mark.parametrize("page", [None, "", " ", "<", "<<<>>>", "</p></div>", "<p", "<!--", "<script>x", "<a <b", "plain text", '<p class="x', "<p " + "x='" * 500, "<div>" * 3000])
def test_any_markup_is_read(model, page):
    assert isinstance(extract.main_text(page, model), str)


@pytest.mark.parametrize(
    "page, text",
    [
        ("plain text only, a whole article.", "plain text only, a whole article."),
        ("text <b>x</b> more", "text x more"),
        ("One line &amp; another.<br>The second paragraph stands here, after a break.", "One line & another. The second paragraph stands here, after a break."),
        ("<body>Straight in the body it stands, sentence by sentence. And on it goes.<br><br>A second paragraph of it, as long as that.</body>", "Straight in the body it stands, sentence by sentence. And on it goes. A second paragraph of it, as long as that."),
        ("<body><div><div><span>First sentence of the article, which is long enough.</span></div><div>Second sentence of the article, which goes on and on.</div></div></body>", "First sentence of the article, which is long enough. Second sentence of the article, which goes on and on."),
        ("<body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>An article without any container. It has two sentences.<footer>&copy; Us</footer></body>", "An article without any container. It has two sentences."),
    ],
)
def test_pages_without_containers(model, page, text):
    assert extract.main_text(page, model) == text


def test_deep_pages_take_time_in_proportion():
    import time

    start = time.perf_counter()
    nodes, _ = extract.parse("<div>" * 100_000 + "x</p></section>" + "<p>y<li>z" * 1000)
    assert len(nodes) == 102_001 and time.perf_counter() - start < 10
    nodes, _ = extract.parse("<div>" * 50_000 + "</nothing>" * 50_000)
    assert len(nodes) == 50_001 and time.perf_counter() - start < 20


def test_rows(spark, model):
    article = "<article><h1>Title here</h1><p>" + "A sentence of text. " * 2000 + "</p></article>"
    rows = [(1, "u", None, "t", 5), (2, None, "", "t", 5), (None, "u", article, "t", 5), (3, "u", article, "t", 5), (3, "u", article, "t", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract.extracted(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars) for r in got.collect()) == [("1", 0), ("2", 0), ("3", 40010), ("3", 40010), ("None", 40010)]
    assert extract.extracted(pages.limit(0), model).collect() == []
