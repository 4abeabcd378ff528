"""Operator 4: blocks, minimum cuts against all labellings, and main texts of pages."""

import itertools
import random

import numpy as np
import pytest

from basecov.llm import html_text as H
from basecov.llm.queries import QUERIES

WEIGHTS, BIAS = np.zeros(H.N_FEATURES), 0.3


def text(page):
    return H.main_text(page, WEIGHTS, BIAS)


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<article><h1>T &amp; U</h1><p>One <b>two<br>three<p>four &#233;&nbsp; x</article>", "T & U\nOne two three\nfour é x"),
        ("<nav><ul><li>menu</ul></nav><article><p>a</article><footer>f</footer>", "a"),
        ("<header>site</header><main><header><h1>h</h1></header><p>p</main>", "h\np"),
        ('<article><p>a<div class="ad">buy</div><aside>s</aside><form>f<input></form>b</article>', "a\nb"),
        ('<article>a</article><section id="comments"><p>reader</section>', "a"),
        ('<div class="sidebar">s</div><div id="content"><p>c</p></div><div role="contentinfo">n</div>', "c"),
        ("<script>var t='</p><p>x'</script><style>p{}</style><article>a<script>if(1<2)</script>b</article>", "ab"),
        ("<!-- <p>x --><article><!-- y -->a<!-- z", "a"),
        ('<article><p title="a>b">a</p><p hidden>h</p></article>', "a"),
        ('<div class="cookie-notice">we use</div><article>a', "a"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<head><title>t</title></head><body><article>a &lt b &am</article>", "a < b &am"),
        ("<html><head><title>t<body><article>a</article>", "a"),
        ("", ""),
        ("just text", "just text"),
    ],
)
def test_main_text(page, expected):
    assert text(page) == expected


def test_silent_containers_follow_their_neighbours():
    """Between two blocks of content a doubtful block of the same parent is content, far from them it is not."""
    page = "<body><div><article><p>A</p></article></div><div><p>doubt</p></div></body>"
    blocks = H.blocks_of(page)
    assert [b.says for b in blocks] == [1, 0]
    edges = {(0, 1): 1.0}
    assert H.min_cut([5.0, -0.5], edges) == [True, True] and H.min_cut([5.0, -1.5], edges) == [True, False]


def test_the_cut_overrules_content_containers():
    """Links at the end of an article go; alone between paragraphs they stay, because their neighbours hold them."""
    weights = np.zeros(H.N_FEATURES)
    weights[6], weights[8] = 3, -3
    offer, prose = "<p><a href=x>Subscribe to our letter</a>", "<p>A sentence of the story."
    end, between = f"<article>{prose}{prose}{offer}{offer}</article><footer>f</footer>", f"<article>{prose}{offer}{prose}</article>"
    assert H.main_text(end, weights, 0).count("Subscribe") == 0
    assert H.main_text(between, weights, 0).count("\n") == 2
    assert H.flow_counts(end, weights, 0)[1] > 0
    assert H.flow_counts(between, weights, 0)[2] == 1  # the link is labelled against its own gain


ADVERT = "Buy the new garden chair today, it is made of the best wood, comes in five colours and is sent to you without any cost at all."


@pytest.mark.parametrize("named", ['<div class="ad">{}</div>', '<p class="advert">{}</p>', '<div class="notice">{}</div>', "<aside>{}</aside>", "<form>{}</form>", '<div class="promo-box">{}</div>', '<div id="site-footer"><p>{}</p></div>', '<div class="user-comments"><article>{}</article></div>', '<div class="comments-wrapper"><article>{}</article></div>', '<section id="comments-container"><p>{}</p></section>'])
def test_named_boilerplate_never_stays(named):
    """Whatever it reads like, and whatever stands next to it."""
    weights = np.zeros(H.N_FEATURES)
    weights[9] = 9
    story = "<p>A first long paragraph of the story, with a full sentence.</p>"
    assert H.main_text(f"<article>{story}{named.format(ADVERT)}{story}</article>", weights, 1).count("\n") == 1
    assert H.main_text(f"<body>{named.format(ADVERT)}<article>{story}</article></body>", weights, 1).count("\n") == 0


def test_states_of_a_page_name_nothing():
    for words in ("has-sidebar", "no-comments", "comments-open", "header-fixed", "ad-free", "sidebar-left"):
        assert text(f'<div class="{words}"><p>a</p></div>') == "a"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<article><h1>T</h1><p>a</article><article class="comment"><p>reader</article>', "T\na"),
        ('<article><p>a</article><section class="comments"><article><h3>Ann</h3><p>reader</article></section>', "a"),
        ('<body class="comments"><div class="post no-comments has-sidebar"><article class="comments-open"><p>a</article></div>', "a"),
    ],
)
def test_articles_of_readers(page, expected):
    assert text(page) == expected


def test_minimum_cut_is_the_cheapest_labelling():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(label):
            return sum(g if g > 0 and not x else -g if g < 0 and x else 0 for g, x in zip(gain, label)) + sum(c for (i, j), c in edges.items() if label[i] != label[j])

        found = cost(H.min_cut(gain, edges))
        assert found == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_long_pages_and_deep_nesting():
    page = "<article>" + "<p>word" * 5000 + "</article>" + "<div>" * 3000 + "deep"
    assert text(page).count("\n") >= 4999
    assert text("<article>" + "<b" * 20_000) in ("", "<b" * 20_000)


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("html")
    rows = [(i, f"http://x/{i}", f"<nav><a href=x>home{i}</a></nav><article><h1>Title {i}</h1><p>Some words, number {i}, that make a sentence.</p></article><footer>&copy; x</footer>") for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<nav>only</nav>"), (None, "u", "<article>a</article>"), (1, "again", "<article>b")]
    spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "'x' AS text").write.parquet(str(path / "pages.parquet"))
    return str(path), rows


def test_query(spark, pages):
    path, rows = pages
    found = QUERIES["op4_min_cut_html"](spark, path).collect()
    assert len(found) == len(rows)
    by_url = {(r.page_id, r.url): r for r in found}
    for i in range(60):
        assert by_url[i, f"http://x/{i}"].text == f"Title {i}\nSome words, number {i}, that make a sentence."
    assert [by_url[k].text for k in ((100, None), (101, "u"), (102, "u"), (None, "u"), (1, "again"))] == ["", "", "", "a", "b"]
    assert all(r.n_chars == len(r.text) for r in found)


@pytest.mark.parametrize("page", ["<body><p>One line.</p><p>two</p></body>", "<nav><a href=x>home</a></nav><p>One line.</p><p>two</p>", "<article><p>One line.</p></article><p>two</p>"])
def test_query_on_pages_of_one_kind(spark, tmp_path, page):
    spark.createDataFrame([(i, "u", page) for i in range(3)], "page_id BIGINT, url STRING, html STRING").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r.text for r in QUERIES["op4_min_cut_html"](spark, str(tmp_path)).collect()] == ["One line.\ntwo"] * 3


def test_empty_table(spark, pages):
    empty = spark.read.parquet(pages[0] + "/pages.parquet").limit(0)
    weights, bias = H.learn(empty)
    assert H.extract(empty, weights, bias).count() == 0 and not weights.any()
