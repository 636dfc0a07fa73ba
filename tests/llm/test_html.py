"""Main text by minimum cut: pages whose names mislead, where the cut turns a block, and pages that no parser likes."""

import tracemalloc

import numpy as np
import pytest

from skillgrid.llm import html_cut
from skillgrid.llm.html_cut import PRIOR, main_text

P = "This is a long paragraph of plain prose, with commas, and with enough words to look like an article to anyone who reads it. It goes on."


@pytest.mark.parametrize(
    "html",
    [
        f'<body class="no-sidebar"><p>{P}</p><p>{P}</p></body>',
        f'<body class="home has-cookie-banner"><p>{P}</p></body>',
        f'<div class="post-with-comments"><p>{P}</p><p>{P}</p></div>',
        f'<div id="page" class="hide-nav"><p>{P}</p></div>',
        f'<main><div class="article-header"><p>{P}</p><p>{P}</p><p>{P}</p></div></main>',
        f'<div class="sidebar"><p>{P}</p><p>{P}</p></div>',
        f"<form action=x><p>{P}</p><p>{P}</p><input name=a></form>",
        f"<![foo[bar]]><p>{P}</p>",
        f"<![if !IE]><p>{P}</p><![endif]>",
        f"<!-- open <p>x > <p>{P}</p>",
        f"<p>{P}</p><![CDATA[ x",
        f"<p>{P}</p><a href='",
    ],
)
def test_names_and_declarations_do_not_empty_a_page(html):
    assert main_text(html, PRIOR) == " ".join([P] * html.count(P))


def test_character_references():
    assert main_text(f"<article><p>{P} &amp;&#0065;&#x42;&#{'9' * 5000};</p></article>", PRIOR) == f"{P} &AB\ufffd"


@pytest.mark.parametrize("box", ["<nav>{}</nav>", "<aside>{}</aside>", '<div class="ad">{}</div>', '<div id="comments">{}</div>', '<section class="Cookie notice">{}</section>', "<form>{}</form>", "<footer>{}</footer>", "<article><div class=ads>{}</div></article>"])
def test_marked_boilerplate_goes(box):
    """One fluent sentence in a marked box beside an article or within one."""
    said = "Buy our new and very good things today, and tell all of your friends."
    page = box.replace("<article>", f"<article><p>{P}</p>").replace("</article>", f"<p>{P}</p></article>")
    html = f"<body>{page}<article><h1>Title</h1><p>{P}</p><p>{P}</p></article></body>"
    assert main_text(html.format(f"<p>{said}</p>"), PRIOR) == " ".join([*[P] * (2 * box.count("article") // 2), "Title", P, P])


def test_the_cut_turns_a_block_that_is_marked():
    """By itself the block is boilerplate, by mark and text; amid an article's paragraphs it is content."""
    said = "Figures that were gathered, over the years, by many people and in many places"
    inside = f'<main><p>{P}</p><p>{P}</p><div class="share-of-all">{said}</div><p>{P}</p></main>'
    page = html_cut.page_of(inside)
    gain = np.clip(html_cut.features(page.blocks) @ PRIOR, -html_cut.TEXT, html_cut.TEXT) + html_cut.MARKUP * html_cut.marks_of(page)
    assert gain[2] < 0 and html_cut.marks_of(page)[2] < 0
    assert main_text(inside, PRIOR) == f"{P} {P} {said} {P}"
    assert said not in main_text(f'<main><p>{P}</p></main><div class="share-of-all">{said}</div>', PRIOR)


def test_the_cut_turns_a_link_list_amid_links():
    """On a page without telling names, one block among links that looks like text goes with them, and a short title with its paragraphs."""
    links = [f"<li><a href=/{k}>Go to {k}</a></li>" for k in range(4)]
    odd = "<li>Words without any link here</li>"
    html = f"<ul>{''.join(links)}{odd}{''.join(links)}</ul><div><h2>A note on figures</h2><p>{P}</p><p>{P}</p></div>"
    page = html_cut.page_of(html)
    alone = html_cut.features(page.blocks) @ PRIOR > 0
    of = [b[0] for b in page.blocks].index
    assert alone[of("Words without any link here")] and not alone[of("A note on figures")]
    assert main_text(html, PRIOR) == f"A note on figures {P} {P}"


@pytest.mark.parametrize("html", ["<div>" * 200_000 + "x", "<div>a, b " * 100_000, "<b>" * 300_000, "<!--" * 250_000, "<a " * 300_000, "</" * 400_000, "<?" * 400_000, "<![CDATA[" * 100_000, "<div>" * 100_000 + "<header>a</header>" * 20_000, "<p>word, " * 100_000, "&#" * 400_000])
def test_a_megabyte_that_never_ends(html):
    tracemalloc.start()
    main_text(html, PRIOR)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(html)


def test_pages_of_any_kind(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>", "x"), (None, None, None, "x"), (2, "u", "", None), (2, "u", "", None), (3, None, "<![foo[bar]]>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "text AS key", "text AS h")
    got = sorted(map(tuple, html_cut.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", P), (None, None, ""), (2, "u", ""), (2, "u", ""), (3, None, "")], key=str)
