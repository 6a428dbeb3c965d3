"""What belongs to the article of a page, by name and structure at any size."""

import html
import re
import time

import pytest

from tillcast.llm.html_text import main_text

LINE = "Some words, of the article, that say something, at some length."
SAID = "no, said a reader, not at all, no, and went on, and on, with commas"


def comments(form, n):
    each = {"div": f"<div class=comment><p>{SAID}</p></div>", "ol": f"<li class=comment>{SAID}</li>",
            "article": f"<article class=comment-body><h4>A reader</h4><p>{SAID}</p><p>{SAID}</p></article>"}[form]
    holder = "ol" if form == "ol" else "div"
    return f"<{holder} id=comments>{each * n}</{holder}>"


@pytest.mark.parametrize("form", ["div", "ol", "article"])
@pytest.mark.parametrize("share", [1, 50, 95])
@pytest.mark.parametrize("wrap", ["article", "main", "div", "section"])
def test_comments_of_any_size_are_left_out(form, share, wrap):
    """``share`` is about the percentage that the comments have of the text."""
    prose = f"<p>{LINE}</p>" * 100
    n = max(1, 100 * share // (100 - share) // (2 if form == "article" else 1))
    text = "\n".join([LINE] * 100)
    beside = f"<body><{wrap}>{prose}</{wrap}>{comments(form, n)}</body>"
    inside = f"<body><{wrap}>{prose}{comments(form, n)}</{wrap}></body>"
    before = f"<body>{comments(form, n)}<{wrap}>{prose}</{wrap}></body>"
    assert main_text(beside) == main_text(inside) == main_text(before) == text


@pytest.mark.parametrize("name", ["sidebar", "ad", "cookie-notice", "newsletter", "related-posts", "share", "social-links", "promo"])
@pytest.mark.parametrize("n", [1, 40, 400])
def test_sidebars_notices_and_adverts_of_any_size_are_left_out(name, n):
    prose, other = f"<p>{LINE}</p>" * 40, f"<p>{SAID}</p>" * n
    text = "\n".join([LINE] * 40)
    assert main_text(f"<body><div class={name}>{other}</div><div>{prose}</div></body>") == text
    assert main_text(f"<body><article>{prose}<div id={name}>{other}</div></article></body>") == text
    assert main_text(f"<body><div class={name}>{other}</div><article>{prose}</article></body>") == text


def test_forms_go_but_not_one_around_the_page():
    prose, fields = f"<p>{LINE}</p>" * 5, f"<form><label>no</label><p>{SAID}</p></form>"
    text = "\n".join([LINE] * 5)
    assert main_text(f"<body><form><h1>Title</h1>{prose}</form></body>") == "Title\n" + text
    assert main_text(f"<body><form><article>{prose}</article></form>{fields}</body>") == text
    assert main_text(f"<body><div>{prose}</div>{fields * 30}</body>") == text


def test_a_header_inside_the_article_leaves_its_title():
    prose = f"<p>{LINE}</p>" * 5
    text = "\n".join([LINE] * 5)
    page = f"<body><header><h1>Site</h1></header><article><header><div><h1>Title</h1><h2>More</h2></div><p>by no one</p><nav>no</nav></header>{prose}</article></body>"
    assert main_text(page) == "Title\nMore\n" + text
    assert main_text(f"<body><header><h1>Site</h1><p>no, no</p></header><div>{prose}</div></body>") == text


def test_of_several_articles_the_best_is_taken():
    teaser = "<article><h2>Other</h2><p>Short, a teaser.</p></article>"
    prose = f"<p>{LINE}</p>" * 5
    assert main_text(f"<body>{teaser}<article>{prose}</article>{teaser}</body>") == "\n".join([LINE] * 5)


def test_names_that_leave_nothing_meant_something_else():
    prose = f"<p>{LINE}</p>" * 5
    text = "\n".join([LINE] * 5)
    for name in ("comments", "sidebar", "widget", "reply", "header"):
        assert main_text(f"<body><div class={name}>{prose}</div></body>") == text
    assert main_text(f"<body><div class=sidebar>{prose}</div><div class=comments><p>{SAID}</p></div></body>") == text
    assert main_text(f"<body><div class=widget>{prose}</div><p>Tagline, of the site.</p></body>").startswith(LINE)


@pytest.mark.parametrize("page", [
    "<div>" * 8000 + "</section>" * 8000 + "x", "<p><i>" + "<b>" * 8000 + "<div>" + "</i>" * 8000 + "x", "<i><div>" + "<b>" * 8000 + "</i>" * 8000 + "x",
    "<b>" * 8000 + "<div></div>" * 8000 + "x", "<ul>" + "<span>" * 8000 + "<li>x</li>" * 8000, "x, x" + "<article><header>" * 4000 + "<h1>x</h1>",
    "<form>" * 3000 + "<h1>x</h1>" * 3000])
def test_odd_nesting_takes_linear_time(page):
    start = time.process_time()
    assert main_text(page).count("x") >= 1
    assert time.process_time() - start < 2


def test_pages_equal_a_plain_reading(spark, small):
    """The given pages hold one article each, with blocks of inline elements only."""
    from tillcast.llm import QUERIES
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, small).collect():
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)
        blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inside[1]) if inside else []
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r.text == "\n".join(t for t in texts if t) and r.n_chars == len(r.text)
