"""Main text: side parts inside articles, elements that are not what they look like, and time on broken pages."""

import time

import pytest

from panelspark.llm import pages

ARTICLE = "<body><nav><ul><li><a>Home</a></li></ul></nav><article><h1>Title of it</h1><p>First paragraph of the text, which is long enough to count.</p>%s<p>Second paragraph, with more words in it.</p></article></body>"
WHOLE = "Title of it First paragraph of the text, which is long enough to count. Second paragraph, with more words in it."


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    return pages.fitted(r[0] for r in rows if r[0])


@pytest.mark.parametrize("side", [
    '<section class="comments"><h2>Comments</h2><p>Nice article, I liked it very much indeed.</p></section>',
    '<div id="comments"><div class="comment"><p>Nice article, I liked it. Very, very much.</p></div><div class="comment"><p>Not me.</p></div></div>',
    '<div class="ad">Buy our product now, it is cheap.</div>', '<aside class="related"><p>More stories.</p></aside>', '<div class="share-bar"><a>Send</a></div>',
    "<svg-icon></svg-icon>", '<svg width="3" />', "<object-view></object-view>", "<template-x></template-x>", '<iframe src="x">', "<iframe>not supported</iframe>", "<svg><title>x</title></svg>",
    "<script>var t = '</p><p>';</script>", "<!-- <p>no</p> -->"])
def test_what_is_not_main_text(model, side):
    assert pages.main_text(ARTICLE % side, model) == WHOLE


def test_what_is_main_text(model):
    for more, text in (("<p>A <b title='x>y'>bold</b> word, and others.</p>", "A bold word, and others."), ("<ul><li>A point.</li><li>Another point.</li></ul>", "A point. Another point."),
                       ("<figure><figcaption>A picture of a thing.</figcaption></figure>", "A picture of a thing."), ("<p>4 < 5 & 6 &gt; 5, in words.</p>", "4 < 5 & 6 > 5, in words.")):
        a, b = WHOLE.split(" Second")
        assert pages.main_text(ARTICLE % more, model) == f"{a} {text} Second{b}"


def test_other_articles_and_classes_of_the_body(model):
    assert pages.main_text('<body><article><h1>Main</h1><p>The main story, long and good. It goes on and on.</p></article><article class="related"><h2>Other</h2><p>Another story to read there, it is good.</p></article></body>',
                           model) == "Main The main story, long and good. It goes on and on."
    assert "The main story" in pages.main_text('<body class="comments-open"><div class="page"><div class="content"><h1>Main</h1><p>The main story, long and good. It goes on.</p><p>More of it, in words.</p></div></div></body>', model)


@pytest.mark.parametrize("piece", ["<a", '<a "', "<a '\">", '<a ">', "<script>", "<iframe>", "<svg", "<", "<!--", "</", "<a b='"])
def test_broken_pages_take_linear_time(model, piece):
    t = time.time()
    pages.main_text(piece * (1_000_000 // len(piece)), model)
    assert time.time() - t < 5


def test_very_long_page(model):
    long = ARTICLE % ("<p>" + "word, and more. " * 100_000 + "</p>")
    assert len(pages.main_text(long, model)) > 1_500_000


def test_sample_is_bounded_and_repeats_count_once(spark):
    rows = [(i, ARTICLE % f"<p>Text {i % 5}, again.</p>") for i in range(60)] + [(99, None), (98, "")]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert len(got) == 62 and got[99] == got[98] == "" and "Text 3, again." in got[3]
