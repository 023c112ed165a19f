"""Main text of pages: written cases, the article markup of the given pages, held-out accuracy."""

import html as entities
import re

import pytest
from fixtures import prose

from parley.llm import html

PAGES = "page_id long, url string, html string"


def page(article, before="", after=""):
    return (f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>"</script></head><body>'
            f'<header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a></li></ul></nav>{before}'
            f'{article}{after}<footer>&copy; me</footer></body></html>')


CASES = [
    (page("<article><h1>Head</h1><p>One  two\n three</p><p>Four</article>"), "Head\nOne two three\nFour"),
    (page("<article><p>a &lt;b&gt; &amp;amp; caf&eacute; &#65;</p></article>"), "a <b> &amp; café A"),
    (page("<article><p>x<b>y</b>z<br>new</p></article>"), "xyz\nnew"),
    (page('<article><p>In</p><div class="ad">Buy buy buy buy buy buy</div><form>Mail <input></form><p>Out</p></article>'),
     "In\nOut"),
    (page("<main><p>Said</p><section class='comments'><article><p>first!</p></article></section></main>"), "Said"),
    (page("<article><p>" + prose(1, 900) + "</p></article>", '<aside>' + prose(2, 50) + "</aside>"), prose(1, 900)),
    (page("<article>" + "".join(f"<ul><li>i{k}</li></ul>" for k in range(40)) + "</article>"),
     "\n".join(f"i{k}" for k in range(40))),
    (page("<article><p>kept</p></article>", after='<div class="cookie notice">' + prose(3, 40) + "</div>"), "kept"),
    (page('<div id="content"><p>Body text here</p></div>', '<div class="sidebar">' + prose(4, 30) + "</div>"),
     "Body text here"),
    (page("<article><!-- hidden <p>no</p> --><p>yes</p><noscript>no</noscript></article>"), "yes"),
    (page("<article></article>"), ""), ("only text &amp; more", "only text & more"), ("", ""), (None, ""),
    ("<p>unclosed <b>bold", "unclosed bold"), ("< not a tag", "< not a tag"),
]


STATES = ["<body class='has-sidebar no-search'>{}</body>", "<body class='search modal' id=sidebar><header>Site</header>{}</body>",
          "<body class='has-header'><div class='sticky-header'>{}</div></body>", "<div id='page' class='share-enabled'>{}</div>",
          "<div class='modal'>{}</div><div class='related'><article><p>Other</p></article></div>",
          "<div class='content-sidebar-wrap'><div class='skip-lazy'>{}</div></div>"]
ARTICLES = ["<article class='post comments-open'><p>Kept</p><p>text</p></article>",
            "<main class='content no-sidebar'><p>Kept</p><p>text</p></main>", "<main class=search><p>Kept</p><p>text</p></main>",
            "<main id=main><article class='post notice'><p>Kept</p><p>text</p><div class='share-buttons'>Share this</div>"
            "<div class='ad-slot'>Buy</div></article><section class='comments-area'><article class='comment'>No</article></section></main>",
            "<article><p>Kept</p><p>text</p><article class='comment'>Nice</article></article>"]


#: Texts of others, longer than the article they stand beside or in.
OTHERS = ["<div id='comments'><article class='comment'>{}</article></div>", "<ol class='comment-list'><li><article>{}</article></li></ol>",
          "<div class='related-posts'><article>{}</article></div>", "<div class='comments-section-2'><p>{}</p></div>",
          "<div class='ad-slot-1'><p>{}</p></div>", "<div class='google_ads'>{}</div>", "<section class='responses'><p>{}</p></section>",
          "<article id='comment-17' class='comment even depth-1'><p>{}</p></article>", "<div itemprop='comment'>{}</div>",
          "<div class='modal'><div class='comments'><article>{}</article></div></div>"]


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    return html.learn_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@pytest.mark.parametrize("case", range(len(CASES)))
def test_cases(weights, case):
    source, text = CASES[case]
    assert html.extract(source, weights) == text


@pytest.mark.parametrize("article", range(len(ARTICLES)))
@pytest.mark.parametrize("state", range(len(STATES)))
def test_classes_that_tell_a_state(weights, state, article):
    """Classes of a page, an article or an element around it do not hide the article; real chrome stays out."""
    source = f"<html class='no-js modal'>{STATES[state].format(ARTICLES[article])}</html>"
    assert html.extract(source, weights) == "Kept\ntext"


@pytest.mark.parametrize("other", OTHERS)
@pytest.mark.parametrize("inner", [False, True])
def test_texts_of_others(weights, other, inner):
    """Comments, related pages and adverts stay out however long they are, after an article and inside it."""
    other = other.format(prose(7, 300))
    own = "<p>Kept</p><p>text</p>"
    body = f"<article>{own}{other}</article>" if inner else f"<article>{own}</article>{other}"
    assert html.extract(f"<html><body>{body}</body></html>", weights) == "Kept\ntext"


BROKEN = [("<div>" * 100_000 + "x", "x"), ("<div>" * 50_000 + "x" + "</p>" * 50_000, "x"), ("<a b " * 200_000, None),
          ('<a "' * 250_000, None), ("<!" * 500_000, None), ('<a b="' * 170_000, None), ("<a b=\"'" * 100_000 + ">", None),
          ("<a b='" * 99_999 + ">", None), ("<ul><li>" * 50_000 + "x", "x"), ("<p>" + "<b>" * 100_000 + "x", "x"),
          ("<article>" * 50_000 + "x", "x"), ("<p>1 < 2 " * 50_000, None), ("</div>" * 150_000 + "x", "x"), ("<!-->a<!--->b", "ab")]


@pytest.mark.parametrize("case", range(len(BROKEN)))
def test_broken_pages_take_linear_time(case):
    import time
    source, text = BROKEN[case]
    began = time.process_time()
    found = html.extract(source, {})
    assert time.process_time() - began < 20
    assert text is None or found == text


def test_tags_end_outside_quoted_values():
    assert html.extract("<article><p title='a > b' data-x=\"c>d\">it's <b class=x'y>so</b></p></article>", {}) == "it's so"


def test_region_is_the_best_of_all():
    import random
    r = random.Random(1)
    for _ in range(200):
        scores = [r.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(r.randrange(12))]
        a, b = html.best_region(scores)
        every = [(sum(scores[i:j]), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0.0, *(s for s, _ in every)])


def test_given_pages(spark, sf_dir):
    """The pages of the table that the weights were not learned from agree with their article element."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r for r in html.main_text(pages, sample=20).collect()}
    assert len(found) == pages.count()
    for row in pages.collect():
        inner = row["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\0", inner)).split("\0")
        text = "\n".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))
        own = found[row["page_id"]]
        assert (own["url"], own["text"], own["n_chars"]) == (row["url"], text, len(text))


def test_awkward_table(spark):
    rows = [(1, None, None), (None, "u", ""), (3, "u", page("<article><p>a</p></article>")),
            (3, "u", page("<article><p>a</p></article>")), (4, "v", "<p>" + "w " * 50_000)]
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS n_chars", "'z' AS name")
    got = sorted(((r["page_id"], r["text"][:5], r["n_chars"]) for r in html.main_text(table).collect()), key=repr)
    assert got == sorted([(1, "", 0), (None, "", 0), (3, "a", 1), (3, "a", 1), (4, "w w w", 99_999)], key=repr)
    assert html.main_text(spark.createDataFrame([], PAGES)).collect() == []
