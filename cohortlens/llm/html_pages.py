"""Labelled pages for the extractor: ``data-label`` says what is content (1) and what is not (0).

They are put together from a few wrappers of an article and usual page furniture around and inside it.
"""

from __future__ import annotations

import itertools

TEXT = "A plain sentence of the story, long enough to be read, with a <b>bold</b> word."
SHORT = "Yes."
ARTICLE = (
    f"<h1>A headline</h1><p>{TEXT}</p><p>{SHORT}</p><p><b>Lead words.<br><p>{TEXT} See <a href='/x'>this page</a>.</p>"
    f"<h2>Part two</h2><blockquote><p>{TEXT}</p></blockquote><ul><li>one point</li><li>another <a href='/y'>point</a></li>"
    f"</ul><table><tr><td>3</td><td>4</td></tr></table><p><em>Er</em> <span>and</span> <i>so</i> <strong>on</strong></p>"
    f"<div><p>{TEXT}</p></div><figure><figcaption>A caption</figcaption></figure><pre>code <code>x</code></pre>"
    f"<dl><dt>word<dd>{TEXT}</dl><div class='lead box'><p>{TEXT}</p>{TEXT}</div><p class='intro'>{TEXT}</p>"
    f"<section class='chapter part'><p>{TEXT}</p></section><div class='block'><p>{SHORT}</p></div><div>{SHORT}</div>"
    f"<section><h3>Part three</h3><p>{TEXT}</p><ol><li>first</li></ol><p><a href='/z'>A linked line</a></p></section>"
)

ARTICLES = [
    ARTICLE,
    f"<h1>A headline</h1><p>{TEXT}</p>",
    f"<p>{SHORT}</p>",
    f"<h1>A headline</h1><p><b>Lead words.<br><p>{SHORT}</p>",
    f"<div><p>{SHORT}</p></div>",
    f"<h2>A</h2><ul><li>{SHORT}</li></ul><p>{TEXT}</p>",
    f"<div class='lead'>{SHORT}</div><p>{SHORT}<br>{SHORT}</p><section><p>{SHORT}</p></section>",
]

# Wrappers of the article, with a place for furniture inside.
WRAPPERS = [
    "<article>{inside}{article}</article>",
    "<article class='post'>{article}{inside}</article>",
    "<main>{article}{inside}</main>",
    "<main id='main'><article id='article'>{inside}{article}</article></main>",
    "<div id='content'>{inside}{article}</div>",
    "<div class='article-body'>{article}{inside}</div>",
    "<div class='entry-content'><div class='text'>{article}{inside}</div></div>",
    "<section class='story'>{inside}{article}</section>",
    "<div role='main' class='page'>{article}{inside}</div>",
    "<div class='box container'><div class='row box'><div class='post-content'>{inside}{article}</div></div></div>",
    "<div>{article}</div>",
    "<div id='page'><div class='wrap'>{inside}{article}</div></div>",
    "<div class='outer'><div><div class='inner'>{article}{inside}</div></div></div>",
    "<section><div>{inside}{article}</div></section>",
    "{article}",
]
# Names of furniture on wrappers say what else is on the page; these hold long articles only.
NAMED_WRAPPERS = [
    "<article class='post tag-story comments-on share-yes'>{article}{inside}</article>",
    "<main class='has-ads no-sidebar'>{inside}{article}</main>",
    "<form id='form1' class='search-page'>{inside}{article}</form>",
    "<div class='layout menu-left related-off'><div class='col'>{article}{inside}</div></div>",
    "<form><div class='widget-area social'><section>{inside}{article}</section></div></form>",
]

WORDS = "A few words or a whole sentence that does not belong to the story."
LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("home", "news", "about", "help"))
INNER = [
    f"<p>{WORDS}</p>",
    f"<ul>{LINKS}</ul>",
    WORDS,
    f"<h3>More</h3><div><p>{WORDS} <a href='/a'>here</a></p></div>",
    f"<h2>Words</h2><span>{WORDS}</span> <em>and</em> <i>so</i> <strong>on</strong><br>{WORDS}",
    f"<table><tr><td>{WORDS}</td><td><a href='/b'>b</a></td></tr></table><ol><li><p>{WORDS}</p></li></ol>",
    f"<div><div><p>{SHORT}</p><p>{TEXT}</p></div><img src='x'><figure><figcaption>{WORDS}</figcaption></figure></div>",
    f"<h2>Words</h2><p><b>{WORDS}</b></p><ul><li>one</li></ul><span>{WORDS}</span>",
]

# Elements that are never content, whatever stands inside.
TAGS = "nav header footer aside form menu dialog".split()
# Names of furniture in class, id or role.
NAMES = (
    "nav navigation navbar menu breadcrumb pagination pager header masthead topbar toolbar logo footer colophon copyright "
    "sidebar aside side widget rail related recommended trending popular more notice alert cookie consent gdpr privacy "
    "popup modal overlay banner ad advert advertisement adsense sponsor sponsored promo promotion commercial form search "
    "login signup newsletter subscribe subscription comment respond reply discussion disqus feedback share social follow "
    "tag meta byline hidden skip complementary contentinfo dialog response reply reaction opinion "
    # German, French and Spanish
    "kommentar kommentare antwort werbung anzeige teilen verwandt mehr fusszeile kopfzeile seitenleiste hinweis suche "
    "commentaire commentaires publicite annonce partager voir plus pied entete barre avis recherche "
    "comentario comentarios publicidad anuncio compartir relacionado pie cabecera aviso buscar"
).split()

COMPOUNDS = (
    "page-header site-header main-menu user-comments article-comments post-footer content-ad page-footer "
    "entry-meta story-related body-promo main-sidebar article-share container-notice text-advert"
).split()


def _furniture() -> list[str]:
    out = []
    for i, tag in enumerate(TAGS):
        for k in range(len(INNER)):
            out.append(f"<{tag} data-label=\"0\">{INNER[(i + k) % len(INNER)]}</{tag}>")
    rotating = itertools.cycle(["section", "ul", "span", "ol", "aside"])
    for i, name in enumerate(NAMES):
        plural = f"class='box {name}s'"
        holders = ["div", "p", next(rotating), "div"]
        for k, given in enumerate((f"class='{name}'", f"class='{name}'", f"id='{name}-box'", plural)):
            tag = holders[k]
            inner = INNER[(i + 3 * k) % len(INNER)] if tag in ("div", "section", "aside") else WORDS
            inner = f"<li>{WORDS}</li>{LINKS}" if tag in ("ul", "ol") else inner
            out.append(f"<{tag} {given} data-label=\"0\">{inner}</{tag}>")
    for i, name in enumerate(COMPOUNDS):
        inner = INNER[i % len(INNER)]
        out.append(f"<section id='{name}' data-label=\"0\">{inner}</section>")
        out.append(f"<div class='{name}' data-label=\"0\">{inner}</div>")
    bare = [
        f"<div style='display:none' data-label=\"0\">{WORDS}</div>",
        f"<div hidden data-label=\"0\"><p>{WORDS}</p></div>",
        f"<p aria-hidden='true' data-label=\"0\">{WORDS}</p>",
        f"<div data-label=\"0\"><ul>{LINKS}</ul></div>",
        "<div data-label=\"0\"><a href='/1'>One story</a> | <a href='/2'>Another story</a> | <a href='/3'>Third</a></div>",
        "<p data-label=\"0\"><a href='/1'>First page</a> <a href='/2'>Second</a> <a href='/3'>Third</a></p>",
        f"<section data-label=\"0\"><h3>More</h3><p><a href='/1'>One story</a></p><p><a href='/2'>Another</a></p></section>",
        f"<div data-label=\"0\"><h4>More</h4><ul>{LINKS}</ul></div>",
        "<div data-label=\"0\"><h3>More of the same</h3><ul><li><a href='/1'>One</a><li><a href='/2'>Two</a></ul></div>",
        "<div data-label=\"0\"><a href='/1'>One</a> - <a href='/2'>Two</a> - <a href='/3'>Three</a></div>",
        "<select data-label=\"0\"><option>a<option>b</select>",
        "<button data-label=\"0\">Share</button>",
        "<textarea data-label=\"0\">words</textarea>",
        "<form data-label=\"0\"><label>Name</label><input name='q'><select><option>a</option></select>"
        "<textarea>words</textarea><button>Send</button></form>",
    ]
    # Each meets several wrappers and articles.
    out += bare * 5
    return out


HEAD = (
    "<head data-label=\"0\"><meta charset='utf-8'><title>A title</title><style>p{color:red}</style>"
    "<script>var a = '<p>no</p>';</script><link rel='x'></head>"
)
SCRIPT = (
    "<script data-label=\"0\">track(1);</script><noscript data-label=\"0\">Turn it on</noscript>"
    "<style data-label=\"0\">b{}</style><iframe data-label=\"0\">frame</iframe><template data-label=\"0\">t</template>"
    "<svg data-label=\"0\"><title>icon</title><text>icon</text></svg>"
)


def labelled_pages() -> list[str]:
    """Every piece of furniture before, inside and after a long and a short article, in turn with every wrapper."""
    pieces = _furniture()
    pages, wrapped = [], []
    for i in range(0, len(pieces), 3):
        before, inside, after = (pieces[(i + k) % len(pieces)] for k in range(3))
        wrapper = WRAPPERS[(i // 3) % len(WRAPPERS)]
        named = NAMED_WRAPPERS[(i // 3) % len(NAMED_WRAPPERS)]
        body = named.format(article=ARTICLES[0], inside=inside)
        wrapped.append(f"<html>{HEAD}<body>{before}{SCRIPT}{body}{after}</body></html>")
        for article in (ARTICLES[0], ARTICLES[1 + (i // 3) % (len(ARTICLES) - 1)]):
            body = wrapper.format(article=article, inside=inside)
            pages.append(f"<html>{HEAD}<body>{before}{SCRIPT}{body}{after}</body></html>")
    return pages + wrapped
