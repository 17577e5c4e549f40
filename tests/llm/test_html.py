import html
import re

import pytest

from cohortlens.llm import html_extract
from cohortlens.llm.html_pages import labelled_pages
from cohortlens.llm.queries import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def model():
    return html_extract.fit(labelled_pages())


def test_query_against_the_article_element(text_spark):
    """In these tables the article is what stands in the article element."""
    pages = {r.page_id: r for r in text_spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = QUERIES["op4_html_extraction"](text_spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))
        assert r.text == " ".join(html.unescape(inner).split()) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


BAD = [
    '<section class="comments"><h2>Bad</h2><div class="comment"><p>Bad</p></div></section>',
    '<div class="cookie-banner"><p>Bad</p><button>Bad</button></div>',
    '<p class="notice">Bad</p>',
    "<aside><p>Bad words, and more of these.</p></aside>",
    '<div class="ad">Bad</div>',
    "<form><label>Bad</label><p>Bad</p></form>",
    '<ul class="menu"><li><a href="/">Bad</a></li></ul>',
    "<footer>Bad &copy;</footer>",
    "<script>Bad</script><style>Bad</style><!-- <p>Bad</p> -->",
    '<div hidden="">Bad</div>',
]
GOOD = [
    "<p>Good</p>",
    "<ul><li>Good<li>Good <a href='/'>link</a></ul>",
    "<p>Go<b>od</b><p>Good<br>Good",
    "<table><tr><td>Good<td>Good</table>",
    "Good",
    '<section class="chapter"><h3>Good</h3></section>',
]


@pytest.mark.parametrize("wrapper", ["<article>%s</article>", '<div class="content"><h1>Real</h1>%s</div>', "<main>%s</main>"])
def test_other_pages(model, wrapper):
    for bad in BAD:
        page = "<html><head><title>Bad</title></head><body>" + bad + wrapper % ("<p>Real text.</p>" + bad)
        text = html_extract.extract(page + "</body></html>", model)
        assert "Bad" not in text and "Real text." in text, (bad, text)
    for good in GOOD:
        text = html_extract.extract("<body>" + wrapper % (good + "<p>Real text.</p>"), model)
        assert "Good" in text and "Real text." in text, (good, text)


def test_text_rules(model):
    page = "<p> a &amp;amp; b&nbsp;\n c &#233;&lt;<b>x</b>y <p>z<div>q<br>r</div>s <3 t<"
    assert html_extract.extract(page, model) == "a &amp; b c é<xy z q r s <3 t<"
    assert html_extract.extract("<article><p>one</p><p>one</p>two</article>", model) == "one one two"
    assert [html_extract.extract(x, model) for x in (None, "", " ", "<br>")] == [""] * 4
    deep = html_extract.extract("<div>" * 20_000 + "x" + "<p>y" * 20_000, model)
    assert deep.split() == ["x"] + ["y"] * 20_000


def test_odd_rows(text_spark, model):
    frame = text_spark.createDataFrame(
        [(1, None, None, "t"), (1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, "u", "<p", None)],
        "page_id bigint, url string, html string, text string",
    )
    out, column = html_extract.main_text(frame, model)
    assert column == "text_" and sorted(r.text_ for r in out.collect()) == ["", "", "x", "x"]
    assert html_extract.main_text(frame.limit(0), model)[0].count() == 0
    labelled = text_spark.createDataFrame([(p,) for p in labelled_pages()[:40]], "html string")
    assert html_extract.extract("<body><article><p>x</p></article><nav>y</nav>", html_extract.train(labelled)) == "x"


def test_training_takes_pages_of_all_openings(text_spark, monkeypatch):
    monkeypatch.setattr(html_extract, "fit", lambda pages: pages)
    openings = ["<!DOCTYPE html>", "<body>", "<html>"]
    pages = [(f"{o}<p>{i}</p>",) for o in openings for i in range(100)]
    chosen = html_extract.train(text_spark.createDataFrame(pages, "html string"), size=60)
    again = html_extract.train(text_spark.createDataFrame(pages[::-1], "html string"), size=60)
    assert len(chosen) == 60 and chosen == again
    assert all(sum(p.startswith(o) for p in chosen) >= 8 for o in openings)


BODY = "<h1>Headline of it</h1><p>Real text one, a full sentence.</p><p>Real text two, a full sentence.</p>"
REAL = "Headline of it Real text one, a full sentence. Real text two, a full sentence."


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post tag-news comment-open share-on">{BODY}</article>',
        f'<main class="with-ads">{BODY}</main>',
        f'<form id="aspnetForm"><article>{BODY}</article></form>',
        f'<div class="page sidebar-right"><div class="single-ad-free">{BODY}</div></div>',
        f'<article>{BODY}</article><div class="responses"><div><p>A reader says no.</p></div></div>',
        f'<article>{BODY}</article><div><h3>Read next</h3><ul><li><a href="/a">A story</a><li><a href="/b">B</a></ul></div>',
        f'<div class="x1"><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">Help</a></div><article>{BODY}</article>',
        f'<article>{BODY}</article><section id="kommentare"><p>Nein.</p></section><div class="werbung">Kauf!</div>',
    ],
)
def test_names_on_wrappers_and_blocks_without_known_names(model, page):
    assert html_extract.extract(f"<html><body>{page}<footer>Bad</footer></body></html>", model) == REAL


def held_out_forms():
    """Page forms and names that no labelled page has: (page, text)."""
    outer = ['<div class="td-pb-span8">{}</div>', '<main id="maincontent">{}</main>', '<article itemscope>{}</article>',
             '<div id="root"><div class="css-1x">{}</div></div>', '<form name="f"><div id="ctl00">{}</div></form>',
             '<article class="hentry category-ads tag-menu">{}</article>', '<section class="single ad-free">{}</section>']
    noise = ['<div class="comments-area"><ol><li><p>First!</p></li></ol></div>', '<ul id="nav-links"><li><a href="/">Home</a></li></ul>',
             '<div class="cookie-bar"><p>We use cookies.</p></div>', '<div class="ad-slot">Buy now</div>',
             '<div class="sharebar share-buttons"><a href="/f">F</a> <a href="/t">T</a></div>', '<aside class="x"><p>Aside words.</p></aside>',
             '<div><a href="/1">One</a> &middot; <a href="/2">Two</a> &middot; <a href="/3">Three</a></div>',
             '<div class="reader-opinions comment"><p>I disagree.</p></div>', '<footer><p>All rights.</p></footer>']
    for i, wrap in enumerate(outer):
        for k in range(len(noise)):
            a, b, c = (noise[(i + k + j) % len(noise)] for j in (0, 2, 5))
            yield f"<html><body>{a}{wrap.format(BODY + b)}{c}</body></html>", REAL


def test_recall_and_precision_on_held_out_forms(model):
    hit = kept = wanted = 0
    for page, text in held_out_forms():
        got, want = html_extract.extract(page, model).split(), text.split()
        common = sum(min(got.count(w), want.count(w)) for w in set(want))
        hit, kept, wanted = hit + common, kept + len(got), wanted + len(want)
    print("recall", hit / wanted, "precision", hit / max(kept, 1))
    assert hit / wanted >= 0.97 and hit / kept >= 0.93


def test_marginals_equal_an_enumeration_of_all_labellings(model):
    rng = __import__("random").Random(4)
    for _ in range(15):
        n = rng.randint(1, 8)
        parent = [-1] + [rng.randrange(v) for v in range(1, n)]
        own = [rng.uniform(-3, 3) for _ in range(n)]
        weight = [0.0] * n
        total = 0.0
        for labels in __import__("itertools").product((0, 1), repeat=n):
            score = sum(o for o, y in zip(own, labels) if y)
            score += sum(model.pair[labels[parent[v]]][labels[v]] for v in range(1, n))
            total += (value := __import__("math").exp(score))
            for v in range(n):
                weight[v] += value * labels[v]
        _, odds, _ = model.messages(parent, own)
        assert [html_extract._odds(x) for x in odds] == pytest.approx([w / total for w in weight], abs=1e-9)
