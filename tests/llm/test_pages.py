import html
import random
import re
from itertools import product

from palisade.llm import pages


def test_article_of_every_page(spark, small):
    """The generated pages mark their article, which gives the text to expect."""
    for row in pages.extract(spark.read.parquet(f"{small}/pages.parquet")).join(
            spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S)[1]
        plain = re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", inner))
        assert row.text == " ".join(html.unescape(plain).split()) and row.n_chars == len(row.text)


PAGE = """<body><header><h1>Site name</h1><p>Welcome to the site of all things.</p></header>
<nav><a href=a>Start</a> <a href=b>News</a></nav>
<div id="content"><h2>Title &amp; more</h2><p>A long paragraph with many words in it, that says
something   <b>b</b>old.</p><div class="cookie-notice">We use cookies. Please accept them now to go on reading here.</div>
<p>Short.</p><script>var x = "<p>never</p>";</script><!-- <p>nor this</p> --><p>Another <a href=x>linked</a> paragraph, with
words&nbsp;and signs &lt;ok&gt; 1 < 2.</p><section class="comments"><p>First! I like this article a lot, it is really well
written.</p></section></div><aside><p>Popular posts of the week are here for all of you.</p></aside>
<form><label>Name</label><p>Your mail address will never be published by us.</p></form><footer>&copy; all rights</footer>"""


def test_parts_of_a_page():
    assert pages.main_text(PAGE) == (
        "Title & more A long paragraph with many words in it, that says something bold. Short. "
        "Another linked paragraph, with words and signs <ok> 1 < 2.")


def test_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<!-- open", "<script>alert(1)", "</div></div>", "<" * 1000, "<p>" * 5000, "&#xFFFFFFFF;"):
        assert isinstance(pages.main_text(page), str)
    assert pages.main_text("<article><p>Cut off in the mid") == "Cut off in the mid"
    assert pages.main_text("<article><p>" + "many words " * 30000 + "</article>").count("many") == 30000


def test_least_cut_against_all_labellings():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(a, b): rng.uniform(0.1, 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        cost = lambda labels: sum(
            max(0, s) * (not x) + max(0, -s) * x for s, x in zip(scores, labels)) + sum(
            c for (a, b), c in edges.items() if labels[a] != labels[b])
        least = min(cost(labels) for labels in product([False, True], repeat=n))
        assert abs(cost(pages.minimum_cut(scores, edges)) - least) < 1e-6


def test_neighbours_carry_a_doubtful_block():
    """A short line between paragraphs stays, the same line among menu entries does not."""
    long = "A paragraph that is long enough to speak for itself, and ends with a full stop."
    text = pages.main_text(f"<div><p>{long}</p><p>Yes</p><p>{long}</p></div>")
    assert text == f"{long} Yes {long}"
    assert pages.main_text("<div><p><a>One</a></p><p>Yes</p><p><a>Two</a></p></div>") == ""


LONG = "A paragraph that is long enough to speak for itself, and that ends with a full stop."
FRAME = "<nav><a href=a>Start</a> <a href=b>News</a></nav>{}<footer>All rights reserved by the owners of this site.</footer>"


def test_the_name_of_a_frame_is_no_veto():
    body = f"<h1>Title</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>"
    want = f"Title {LONG} Yes. {LONG}"
    for opened, closed in (
            ('<div class="layout has-sidebar"><article>', "</article></div>"), ('<div id="page" class="no-comments"><main>', "</main></div>"),
            ('<article class="alert-story">', "</article>"), ('<div class="sidebar-page"><div class="entry">', "</div></div>"),
            ('<div class="page-with-nav">', "</div>")):
        assert pages.main_text(FRAME.format(opened + body + closed)) == want, opened
    assert pages.main_text(f'<form id="aspnetForm">{FRAME.format(f"<article>{body}</article>")}</form>') == want


def test_parts_inside_the_content_go():
    comments = f'<section class="comments"><article class="comment-body"><p>{LONG}</p></article><article class="comment"><p>{LONG} So true!</p></article></section>'
    for part in (comments, f'<div class="ad">{LONG}</div>', f'<aside class="content"><p>{LONG}</p></aside>', f'<div class="post-footer"><p>{LONG}</p></div>',
                 f'<div class="share-buttons"><p>{LONG}</p></div>', f'<p class="notice">{LONG}</p>', f'<div role="alert">{LONG}</div>'):
        page = FRAME.format(f"<article><h1>Title</h1>{f'<p>{LONG}</p>' * 4}{part}<p>{LONG}</p></article>")
        assert pages.main_text(page) == " ".join(["Title", *[LONG] * 5]), part


def noisy(rng):
    """A page without any telling mark: a list of short links, an article with short lines in it, another list."""
    word = lambda: rng.choice("some words of any kind that come in a line".split())
    line = lambda n: " ".join(word() for _ in range(n))
    links = lambda: "<div>" + "".join(
        f"<p>{f'<a href=x>{line(rng.randint(1, 3))}</a>' if rng.random() < 0.8 else line(2)}</p>" for _ in range(rng.randint(3, 8))) + "</div>"
    own = [line(rng.randint(1, 3)) if rng.random() < 0.35 else line(rng.randint(15, 40)) + "." for _ in range(rng.randint(4, 10))]
    own[0], own[-1] = line(30) + ".", line(30) + "."
    return links() + "<div>" + "".join(f"<p>{x}</p>" for x in own) + "</div>" + links(), " ".join(own)


def test_the_cut_mends_labels_on_noisy_pages():
    rng = random.Random(21)
    changed = right = right_without = 0
    for _ in range(200):
        page, want = noisy(rng)
        found = pages.blocks(page)
        alone = [s > 0 for s in pages.scores(found)]
        cut = pages.minimum_cut(pages.scores(found), pages._edges(found))
        changed += sum(a != b for a, b in zip(alone, cut))
        right += pages.main_text(page) == want
        right_without += " ".join(b.text for b, keep in zip(found, alone) if keep) == want
    assert changed > 200 and right >= 170 and right_without < 60


def test_table(spark):
    rows = [(1, "u", None, "a"), (2, None, "", "a"), (None, "u", PAGE, "a"), (3, "u", PAGE, "a"), (3, "u", PAGE, "a")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(frame).collect()
    assert len(got) == 5 and [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0]
    assert pages.extract(frame.where("false")).count() == 0
