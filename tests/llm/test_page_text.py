import html
import re

from planloom.llm.page_text import main_text, page_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">{menu}</a></li></ul></nav><!-- no <p>text</p> --><div class="cookie-notice"><p>We use cookies</p></div>
<div class="ad">Buy {menu}</div><article><h1>{title}</h1><p><b>One  &lt;two&gt;<br>three
 four<p>Five <a title="a>b" href=x>six</a>, &amp;c &am</p><form>Your mail <input></form><aside>See also</aside>
<div id="comments"><p>First!</p></div><ul><li>seven<li>eight</ul></article>
<footer>&copy; {title}</footer></body></html>"""
TEXT = "{title}\nOne <two> three four\nFive six, &c &am\nseven\neight"


def test_hosts_with_and_without_articles(spark):
    rows = [(k, f"http://a.com/{k}", PAGE.format(menu="home", title=f"Title {k}")) for k in range(8)]
    rows += [(8, "http://a.com/8", rows[0][2]), (8, "http://a.com/8", rows[0][2])]
    rows += [(20 + k, f"http://B.org/{k}", f"<p>All rights reserved</p><div>Body {k} &eacute;</div>tail") for k in range(6)]
    rows += [(40, None, None), (41, "", ""), (42, "x", "plain < text & more"), (43, "http://a.com/cut", rows[1][2][:-61] + "<foot"), (44, "http://c.d/", "<p>é</p>" * 9000)]
    frame = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id bigint, url string, html string, text int, host string")
    got = main_text(frame).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[k] == TEXT.format(title=f"Title {k}") for k in range(8)) and by[8] == by[0]
    assert all(by[20 + k] == f"Body {k} é" for k in range(6))
    assert (by[40], by[41], by[42], by[43]) == ("", "", "plain < text & more", TEXT.format(title="Title 1"))
    assert by[44] == "\n".join("é" * 9000) and all(r.n_chars == len(r.text) for r in got)
    assert main_text(frame.limit(0)).count() == 0


def test_classes_tell_template_texts_on_hosts_without_articles(spark):
    """A third of the host's pages are of a second template, and a host has four pages only; three pages
    are copies of one story."""
    story = "<html><body><div class='top'>Our site</div><div class='story'>{body}</div>{more}</body></html>"
    sport = "<div class='box'><h2>Sports desk</h2><span>Scores by phone</span></div><div class='tip'>Send a tip</div>"
    body = lambda k: f"<p>First {k}</p><p>Second {k}</p>" + "<p>More</p>" * (k % 3 // 2)
    rows = [(k, f"http://a.com/{k}", story.format(body=body(k), more=sport if k < 10 else "")) for k in range(30)]
    rows += [(40 + k, f"http://b.com/{k}", story.format(body=body(k), more="<div class='legal'>All rights reserved</div>")) for k in range(4)]
    rows += [(50 + k, f"http://c.com/{k}", story.format(body=body(5), more=f"<i>{k}</i>")) for k in range(3)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = lambda k: "\n".join([f"First {k}", f"Second {k}", *["More"] * (k % 3 // 2)])
    assert all(got[k] == want(k) for k in range(30))
    assert all(got[40 + k] == want(k) for k in range(4))
    assert all(got[50 + k] == f"{want(5)}\n{k}" for k in range(3))


def test_names_are_a_hint_that_the_text_confirms(spark):
    side = "<div class='sidebar'>Links</div>"
    for page in (
        f"<html class='no-js social'><body class='has-sidebar'><p>One two three</p>{side}</body></html>",
        f"<body><article class='post comments-open'><p>One two three</p></article>{side}",
        f"<main id='share-prices'><p>One two three</p>{side}</main>",
        f"<body><div class='has-sidebar'><div><p>One two three</p></div>{side}</div></body>",
        f"<body><div class='with-banner'><article><p>One two three</p><div class='share'>Send</div></article></div>{side}</body>",
        "<body><p>One two three</p><div id='comments'><article>First!</article></div></body>",
    ):
        assert page_text(page) == ("One two three", 1)
    # On one page the comments are longer than the story; the host's other pages tell what they are.
    page = "<body><div class='has-sidebar'><p>Story {k} of many words</p><div id='comments'>{said}</div></div></body>"
    rows = [(k, "http://a.com/", page.format(k=k, said="Long talk. " * 9 if k == 3 else "First!")) for k in range(30)]
    got = main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id} of many words" for r in got) and len(got) == 30


def test_broken_markup():
    assert page_text("<p>a<p>b</div>c<script>never closed <p>x") == ("a\nb\nc", 3)
    assert page_text("<script>if (a</b) x</scripty></script >z<p") == ("z", 1)
    assert page_text("1 <2 and <!-- open comment <p>x") == ("1 <2 and", 1)


def test_whole_table_against_its_own_layout(spark, small_folder):
    """The table's pages have one article of a heading and paragraphs each, whose tags are known."""
    from planloom.llm.queries import QUERIES

    got = {r.page_id: r.text for r in QUERIES["op6_page_text"](spark, small_folder).collect()}
    pages = spark.read.parquet(f"{small_folder}/pages.parquet").collect()
    for r in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [html.unescape(re.sub(r"</?b>|<br>", "", p)) for p in re.split(r"</?(?:h1|p)>", body)]
        assert got[r.page_id] == "\n".join(t for p in parts if (t := re.sub(r"\s+", " ", p).strip()))


STORY = "<h1>Title {k}</h1><p>Story number {k} has a line of its own.</p>"
COMMENTS = "".join(f"<p>Reader {i} thinks that story {{k}} is far too short for a site like this.</p>" for i in range(8))


def on_host(spark, layout, n=40):
    rows = [(k, f"https://h.example/{k}", layout.replace("{k}", str(k))) for k in range(n)]
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_comments_and_notices_longer_than_the_story_go(spark):
    want = {k: f"Title {k}\nStory number {k} has a line of its own." for k in range(40)}
    for part in (f'<section class="comments">{COMMENTS}</section>', f'<div id="post-comments"><article><p>{COMMENTS}</p></article></div>',
                 f'<div class="cookie-banner">{COMMENTS}</div>', f'<div class="newsletter">{COMMENTS}</div>'):
        assert on_host(spark, f"<body><article>{STORY}{part}</article></body>") == want
        assert on_host(spark, f"<body><div class='story'>{STORY}</div>{part}</body>") == want


def test_names_that_only_hint(spark):
    """An article whose names say that comments are open, or what shares cost, stays whole; a page that
    is nothing but comments shows them."""
    want = {k: f"Title {k}\nStory number {k} has a line of its own." for k in range(40)}
    assert on_host(spark, f'<body class="has-comments"><div class="post comments-open">{STORY}</div></body>') == want
    assert on_host(spark, f'<body><article class="comment">{STORY}</article></body>') == want
    assert on_host(spark, f'<body><div class="comments">{STORY}</div></body>') == want


def test_adverts_in_a_line_and_unclosed_menus():
    assert page_text('<article><p>One <span class="ad">Buy now</span>two</p></article>')[0] == "One two"
    assert page_text('<article><p>One <span class="added">three</span> two</p></article>')[0] == "One three two"
    assert page_text("<nav><a href=/>Home</a><article><h1>T</h1><p>Text.</p></article>")[0] == "T\nText."
    assert page_text("<nav><a href=/>Home</a></nav>")[0] == ""


def test_broken_markup_is_read_in_time():
    import time

    start = time.time()
    assert page_text("<div>x</span></p>" * 20_000)[1] == 20_000
    assert page_text("<article>" + "<div>" * 20_000 + "deep")[0] == "deep"
    assert time.time() - start < 10
