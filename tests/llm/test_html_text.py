from __future__ import annotations

import html
import random
import re

import pytest

from forgemart.llm import html_text

BODY = "<p>Stones lie in the river, and the light of the evening goes over them slowly.</p>"
LONG = "Stones lie in the river, and the light of the evening goes over them slowly."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<nav><a>Home</a></nav><article><h1>Title</h1>{BODY}<p>Short.</p></article><footer>end</footer>", f"Title\n\n{LONG}\n\nShort."),
        (f"<body><div class='ad'>Buy now, it is very very cheap and good today</div><main>{BODY}</main>", LONG),
        (f"<article>{BODY}<aside>Related things</aside><form>Your mail<button>Send</button></form></article>", LONG),
        (f"<article>{BODY}<div id='comments'><article class='comment'><p>First! I like it a lot, truly.</p></article></div></article>", LONG),
        (f"<div class='cookie-notice'>We use cookies, as everyone does.</div><div>{BODY}{BODY}</div><div class='site-footer'>(c)</div>", f"{LONG}\n\n{LONG}"),
        ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;x\n  y<br>z</p></article>", "a & b <c> é x y z"),
        ("<article><p><b>bold<p>next<br><p>third</article>", "bold\n\nnext\n\nthird"),
        ("<article><script>var t='</p>';</script><style>p{}</style><p>Text</p><!-- note --></article>", "Text"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>one</p><p>two</p", "one\n\ntwo"),
        ("<article><p>one<!-- two <p>three", "one"),
        ("<article><p>a<![foo[x]]>b</p><![endif]>", "ab"),
        ("<article><p>one</p><p>two &am", "one\n\ntwo &am"),
        ("plain words without a tag", "plain words without a tag"),
        ("", ""),
        ("<nav>menu only</nav>", ""),
        ("<ul><li>first</li><li>second</li></ul>", "first\n\nsecond"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_any_page_has_a_text():
    draw = random.Random(1)
    parts = (
        "<p> </p> <div_class=ad> </div> <![ [ ]]> <! <!-- --> & &amp text < /> <script> </script> <article> </article>"
        " ' \" = <br/> <h1> <textarea> <title> &#x110000; &#xD800; <?php ?> \0"
    ).split(" ")
    for _ in range(3000):
        html_text.main_text("".join(draw.choice(parts).replace("_", " ") for _ in range(draw.randint(0, 14)))).encode()


def test_rows(spark):
    rows = [(1, "u", "<article><p>Text</p></article>", "clash"), (2, None, None, None), (None, "u", "", "x")]
    rows += [rows[0], (5, "u", "<article>" + "<p>line of words</p>" * 20_000 + "</article>", "x")]
    found = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    expected = [(1, "u", "Text", 4), (2, None, "", 0), (None, "u", "", 0), (1, "u", "Text", 4)]
    got = [tuple(r) for r in found.collect()]
    assert got[:4] == expected
    assert got[4][3] == 20_000 * 15 - 2
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_the_table(spark, data):
    """Against a plain reading of the one article that each page has, block by block."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    found = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    for row in pages.collect():
        body = row.html.split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|article)\b[^>]*>", body)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert found[row.page_id] == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content has-sidebar'><article>{BODY}</article></div>", LONG),
        (f"<div class='no-sidebar'><article>{BODY}</article></div><div class='sidebar'><p>Other things</p></div>", LONG),
        (f"<div id='widget' class='sidebar'><div class='menu'><article>{BODY}</article></div></div>", LONG),
        (f"<div class='social'><main>{BODY}</main></div>", LONG),
        (f"<div class='banner'><h1>Title</h1>{BODY}</div>", f"Title\n\n{LONG}"),
        (f"<article><section id='discussion'><h2 id='related-work'>Work</h2>{BODY}</section></article>", f"Work\n\n{LONG}"),
        (f"<article>{BODY}<h2 id='privacy'>Privacy</h2><p class='social'>Alone.</p></article>", f"{LONG}\n\nPrivacy\n\nAlone."),
        (f"<article>{BODY}<div class='section level2' id='discussion'><p>More.</p></div></article>", f"{LONG}\n\nMore."),
        # What is marked still goes, also where articles are readers' comments.
        (f"<article>{BODY}<div class='widget'><article><h1>Card</h1></article></div></article>", LONG),
        (f"<main><article>{BODY}</article><div id='comments'><article><p>I like it.</p></article></div></main>", LONG),
        (f"<main>{BODY}<div class='cookie_notice'>Cookies</div><ul class='menu'><li>Home</li></ul></main>", LONG),
    ],
)
def test_classes_and_ids(page, text):
    assert html_text.main_text(page) == text


SHORT = "<p>Twenty letters long.</p>"
WIDE = f"<p>{'Words of the text. ' * 60}</p>"


def kept(page):
    return [block[:20] for block in html_text.main_text(page).split("\n\n")]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<article>{WIDE * 9}</article><nav>Home</nav><div><p>Far</p></div><article><p>Short.</p></article>", ["Words of the text. W"] * 9 + ["Short."]),
        (f"<article>{WIDE * 9}</article><footer>end</footer><main><p>Short.</p></main>", ["Words of the text. W"] * 9 + ["Short."]),
        (f"<div><p>First</p><article><p>a</p></article>{WIDE}</div>", ["First", "a", "Words of the text. W"]),
        (f"<body><div><p>Other</p></div><div>{SHORT * 3}{WIDE}{SHORT * 3}</div><footer>end</footer>", ["Twenty letters long."] * 3 + ["Words of the text. W"] + ["Twenty letters long."] * 3),
        (f"<div>{SHORT}<div class='ad'>Buy</div><ul><li>one</li><li>two</li></ul>{SHORT}{WIDE}</div>", ["Twenty letters long.", "one", "two", "Twenty letters long.", "Words of the text. W"]),
        (f"<div><p>Other</p></div><div><ul><li>a<li>b<li>c<li>{'word ' * 100}<ul><li>d</ul><li>e<li>f<li>g</ul></div>", ["a", "b", "c", "word word word word ", "d", "e", "f", "g"]),
        (f"<div>a<p>b</p>c<p>d</p>{'Loose text of a page ' * 50}<p>e</p>f<p>g</p>h</div><div>x</div>", ["a", "b", "c", "d", "Loose text of a page", "e", "f", "g", "h"]),
    ],
)
def test_whole_regions(page, blocks):
    assert kept(page) == blocks
