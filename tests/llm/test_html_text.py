import html
import random
import re
import time

import numpy as np

from ohmlake.llm import html_text
from ohmlake.llm.html_text import WINDOW, SURGE, extract, main_text, op9_html_text, stretches

PAGE = """<!doctype html><HTML><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad > <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class='side ad'>Buy<div>now</div></div>
<article><h1>Head &amp;amp; tail</h1><p>One<b>two</b>  three&nbsp;four<br>five<p>Six &lt;b&gt; &eacute;&#233;
<ul><li>item 1<li>item 2</ul><table><tr><td>a</td><td>b</td></tr></table><form>Name <input></form>
<p>.</p><aside>More</aside><div id="comments"><p>Nice post</p></div></article>
<section class="comment-list"><p>First!</p></section><footer>&copy; x</footer></body></html>"""


def test_marked_article():
    assert main_text(PAGE).split("\n") == ["Head &amp; tail", "Onetwo three four five", "Six <b> éé", "item 1", "item 2", "a b", "."]


def test_wrappers_and_comment_articles():
    page = '<div class="page has sidebar"><div class="sidebar">side</div><main><h1>T</h1><p>body</p></main></div><section id="comments"><article class="comment">c</article></section><div class="related"><article>r</article></div>'
    assert main_text(page) == "T\nbody"
    assert main_text('<article>a</article><article class="comment-body">c</article>') == "a"


def test_unmarked_page_by_distribution():
    long = "Some long sentence of a real paragraph that goes on and on. " * 3
    page = f"<body><div><a href=x>Home</a></div><div><a href=y>About us</a></div><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a>One</a></div><div><a>Two</a></div><div><a>Three</a></div></body>"
    assert main_text(page) == "\n".join([long.strip(), "Short.", long.strip()])


def test_main_text_beside_a_small_article():
    long = "Some long sentence of a real paragraph that goes on and on. " * 3
    page = f"<body><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a>One</a></div><div><a>Two</a></div><div><a>Three</a></div><article><p>Teaser</p></article></body>"
    assert main_text(page) == "\n".join([long.strip(), "Short.", long.strip(), "Teaser"])
    assert main_text(f"<article><p>{long}</p><p>{long}</p></article><p><a>One</a><p><a>Two</a><p><a>Three</a><p>by x") == "\n".join([long.strip()] * 2)


def test_stretches_choose_and_marks_move_their_ends(monkeypatch):
    long = "Some long sentence of a real paragraph that goes on and on. " * 3
    teasers = "<article><p><a>Other story</a></p></article>" * 2
    page = f"<body><p>by x<article><p>Lead.</p>{'<p><a>link</a></p>' * 4}<p>{long}</p><p>End.</p></article><p>Posted in y</p>{teasers}</body>"
    assert main_text(page).split("\n") == ["Lead.", "link", "link", "link", "link", long.strip(), "End."]  # grown and cut to the element, teasers gone
    page_2 = f"<article><p>Lead.</p></article><p>{long}</p><p>{long}</p>"
    assert main_text(page_2).split("\n") == ["Lead.", long.strip(), long.strip()]  # most of it is outside: not cut
    monkeypatch.setattr(html_text, "stretches", lambda lengths: [])
    assert "Other story" in main_text(page) and long.strip() not in main_text(page_2)


def test_stretches_by_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, 5, 30, 90]) for _ in range(rng.randint(0, 30))]
        state, own = False, []
        for i, n in enumerate(lengths):
            ahead = sum(lengths[i : i + WINDOW])
            state = ahead > 0 if state else ahead >= SURGE and n > 0
            own.append(state)
        got = np.zeros(len(lengths), bool)
        for a, b in stretches(np.array(lengths, np.int64)):
            got[a:b] = True
        assert got.tolist() == own


def test_long_page_with_several_stretches():
    """Megabytes: every paragraph of every stretch is kept, the links between them are not."""
    body = "".join(f"<p>{'word ' * 40}{k}</p>" * 8 + f"<div>{'<p><a>menu entry</a></p>' * 6}</div>" for k in range(3000))
    text = main_text(f"<body>{body}</body>")
    assert len(text) > 4_000_000 and text.count("\n") == 8 * 3000 - 1 and "menu" not in text


def test_ids_made_from_headings():
    page = """<article><h2 id="related-work">A</h2><section id="discussion"><h3 id="how-to-share-files">B</h3><p id="cookies">C</p></section><div id="social-impact" class="section">D</div>
    <section id="commentary">E</section><p class="notice">F</p><ul class="share-buttons"><li>no</ul><div class="related-posts">no</div><div class="social bar"><a>no</a> <a>nor</a></div><div class="promotion big">G<div>H</div></div>
    <section id="comments">I</section></article>"""
    assert main_text(page) == "\n".join("ABCDEFGHI")
    assert main_text('<article class="post category-commentary tag-social" id="related-work">a</article><article id="comment-12">c</article>') == "a"
    assert main_text('<div><h2 class="section-header" id="discussion">A</h2><div id="related-work"><p>B</p><div id="menu"><a>no</a></div></div></div><div id="sidebar">no</div>') == "A\nB"


def test_links_in_the_middle_of_an_unmarked_article():
    long = "Some long sentence of a real paragraph that goes on and on. " * 3
    refs = "<ul><li><a>One</a><li><a>Two</a><li><a>Three</a><li><a>Four</a></ul>"
    for menu in ("", f"<div>{refs}</div>"):
        page = f"<body>{menu}<div><p>{long}</p>{refs}<p>{long}</p><p>End.</p></div>{menu}</body>"
        assert main_text(page) == "\n".join([long.strip(), "One", "Two", "Three", "Four", long.strip(), "End."])
    boxes = f"<div><p>{long}</p></div><div>{refs}</div><div><p>{long}</p></div>"
    assert main_text(boxes) == "\n".join([long.strip()] * 2)


def test_odd_pages(spark):
    odd = ["", None, "plain words only", "<", "<p", "<article>a", "<article><p>x<script>never closed", "<nav>never closed<article><p>body</p></article>", "<article>" + "<p>w</p>" * 3000, "<a b='c>\"" * 2000, "<!-- open", "x" * 100_000, "<article><div class=ad>left open<p>text</article>tail"]
    df = spark.createDataFrame(list(enumerate(odd)) + [(5, "<article>a")], "page_id long, html string").selectExpr("*", "1 as n_chars", "2 as main_text")
    rows = extract(df).collect()
    got = {r.page_id: r.main_text for r in rows}
    assert len(rows) == len(odd) + 1 and all(r.n_chars == len(r.main_text) for r in rows)
    assert got[0] == got[1] == got[10] == "" and got[5] == "a" and got[6] == "x" and got[7] == "body" and got[8].count("\n") == 2999 and got[11] == odd[11]
    assert extract(df.limit(0)).count() == 0


def test_query_against_a_plain_reading_of_the_pages(spark):
    at = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    rows = op9_html_text(spark, at).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article[^>]*>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1|h2|h3|li|ul|ol|div|blockquote|pre)(?:\s[^>]*)?>", inner)]
        assert r.text == "\n".join(" ".join(b.split()) for b in blocks if b.split())
        assert r.n_chars == len(r.text)


def test_odd_pages_take_time_in_proportion():
    """Elements that never end or only end: twice the page takes about twice the time."""
    for piece, tail in (("<nav><p>a", ""), ("<div class=ad><main>", ""), ("<div><p>a", "</section>"), ("<div class=share><a>x</a>", "</div>")):
        times = []
        for n in (4000, 16000):
            page = piece * n + tail * n
            times.append(min(timed(page) for _ in range(3)))
        assert times[1] < 10 * times[0] + 0.05, piece


def timed(page):
    began = time.perf_counter()
    main_text(page)
    return time.perf_counter() - began
