"""HTML extraction: planted pages, and the articles of the given pages by a plain cut."""

import html as entities
import re

import pytest

from threatloom.llm import html

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>x</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{0}<aside>Related</aside><div id="comments"><p>First!</p></div>
<form><p>Search</p></form><footer>&copy; 2024</footer></body></html>"""
BODY = ["<h1>Head &amp; line</h1>", "<p>One\n  two <b>three</b><br>four</p>", "<p>Short.</p>", "<ul><li>item a<li>item b</ul>", "<p hidden>no</p>"]
TEXT = "Head & line\n\nOne two three four\n\nShort.\n\nitem a\n\nitem b"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<article><header>{}</header></article>"])
def test_declared_articles(wrap):
    assert html.main_text(PAGE.format(wrap.format("".join(BODY)))) == TEXT


def test_undeclared_content_is_found_by_its_ratio():
    long = ["".join(f"word{i} " for i in range(40)) for _ in range(4)]
    page = "<div>" + "".join(f"<div><a href=/{i}>link {i}</a></div>" for i in range(12)) + "</div>" + "".join(f"<p>{x}</p>" for x in long)
    page += "<div>" + "".join(f"<span><a href=/{i}>l{i}</a></span>" for i in range(30)) + "</div>"
    assert html.main_text(page) == "\n\n".join(x.strip() for x in long)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<article><p>a &am", "a &am"),
    ("<p>&#x41;&eacute;&nbsp;x</p>", "Aé x"), ("<![foo[ x ]]><p>a</p>", "a"), ("<p>a</b></i></p></div>", "a"), ("<br><br>", ""),
    ("<article>a<article class='comment'>c</article></article>", "a"), ("<script>x", ""), ("<p>a<!-- c --> b</p>", "a b"),
])
def test_small_pages(page, text):
    assert html.main_text(page) == text


def test_pages_of_the_test_data(spark, folder, rows):
    from threatloom.llm.queries import QUERIES

    got = {r["page_id"]: r for r in QUERIES["op1_html_main_text"](spark, folder).collect()}
    for page_id, url, page in rows("pages", "page_id, url, html"):
        article = re.split(r"</article>|<footer>", page.split("<article>")[1])[0]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page_id]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[page_id]["n_chars"] == len(got[page_id]["text"]) and got[page_id]["url"] == url


def test_long_pages_clashing_names_and_empty_table(spark):
    page = "<article>" + "<p>some words here &lt;</p>" * 30_000 + "x" * 600_000 + "</article>"
    pages = spark.createDataFrame([(1, page, "t"), (1, page, "t"), (2, None, "t")], "page_id bigint, html string, n_chars string")
    got = html.with_main_text(pages, n_chars="size").collect()
    assert [r["size"] for r in got] == [19 * 30_000 + 600_000, 19 * 30_000 + 600_000, 0] and got[0]["n_chars"] == "t"
    assert html.with_main_text(pages.limit(0), n_chars="size").count() == 0


LONG, OTHER = ("".join(f"{w}{i} " for i in range(90)).strip() for w in "ab")


@pytest.mark.parametrize("page, text", [
    (f"<div><p>{LONG}</p><p>Short.</p></div>", [LONG, "Short."]),
    (f"<div><h1>Title</h1><p>{LONG}</p><ul><li>x<li>y</ul><p>{OTHER}</p><p>End.</p></div>", ["Title", LONG, "x", "y", OTHER, "End."]),
    (f"<div><a href=/>Home</a></div><div><h1>Title</h1></div><div><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{OTHER}</p></div></div>",
     ["Title", LONG, "Short.", OTHER]),
    ("<p>One line.</p><p>And one more line.</p><p>Third.</p>", ["One line.", "And one more line.", "Third."]),
])
def test_undeclared_article_is_kept_whole(page, text):
    assert html.main_text(page) == "\n\n".join(text)


@pytest.mark.parametrize("page", [
    "<article class='post has-sidebar'>{}</article>", "<div class='overflow-hidden'><article>{}</article></div>",
    "<div id='page' class='no-comments'><article>{}</article></div>", "<div class='widget'><article>{}</article></div>",
    "<div class='content-widget'><div>{}</div></div><div class='sidebar'>Other</div>", "<article class='widget'>{}</article>",
])
def test_names_round_the_article_drop_nothing(page):
    assert html.main_text(page.format(f"<p>{LONG}</p><p>Short.</p>")) == f"{LONG}\n\nShort."


@pytest.mark.parametrize("name", ["site-footer", "cookie-notice", "relatedPosts", "post_comments", "ad", "newsletter-signup"])
def test_names_of_menus_and_comments_drop(name):
    assert html.main_text(f"<article><p>Text.</p><div class='{name}'><p>{LONG}</p></div></article>") == "Text."
    assert html.main_text(f"<div><p>{LONG}</p></div><div id='{name}'><article>c</article></div><article>Text.</article>") == "Text."


def test_unfinished_markup_takes_linear_time():
    import time

    start = time.time()
    for one in ("<a ", "<a href='", "<!--", "<a <a x='", "</p "):
        assert html.main_text("<p>head text here</p>" + one * (1_000_000 // len(one))) == "head text here"
    assert time.time() - start < 5
    assert html.main_text("<p>one 3 < 4 two") == "one 3 < 4 two"
