"""Marks around the article don't reach into it; marks on blocks and spans do count."""

import pytest

from driftline.llm.html_text import extract

WORDS = "word " * 30
BODY = f"<article><h1>Title</h1><p>{WORDS}end.</p></article>"
TEXT = f"Title\n\n{WORDS}end."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><div class='layout has-sidebar'>{BODY}</div></body></html>",
        f"<html><body><div class='sidebar'>{BODY}</div></body></html>",
        f"<html><body><form action=/>{BODY}<button>Send</button></form></body></html>",
        f"<html><head><meta charset=utf-8><body>{BODY}</body></html>",
        f"<html><head><meta charset=utf-8><body><main><p>{BODY}</main></body></html>",
    ],
)
def test_marks_around_the_article(page):
    assert extract(page, {}) == TEXT


def test_layout_without_an_article():
    assert extract(f"<body><div class='page with-sidebar'><p>{WORDS}end.</p></div></body>", {}) == f"{WORDS}end."
    assert extract(f"<body><div class='sidebar'><p>{WORDS}</p></div><div class='text'><p>{WORDS}end.</p></div></body>", {}) == f"{WORDS}end."


def test_marks_on_blocks():
    page = f"<body><article><p>{WORDS}</p><p class='notice'>Read our notice<p>Next.</p><ul><li class=share>Share this<li>one</ul><p>A <span class='ad'>Buy</span> line.</p></article></body>"
    assert extract(page, {}) == f"{WORDS.strip()}\n\nNext.\n\none\n\nA line."
    assert extract(f"<article><p>{WORDS}<span class='ad'>Buy</p><p>Next.</p></article>", {}).endswith("word")


def test_articles_in_the_article():
    page = f"<body><article><p>{WORDS}end.</p><div class=comments><article><p>So true.</p></article></div><p>{WORDS}Last.</p></article></body>"
    assert extract(page, {}) == f"{WORDS}end.\n\n{WORDS}Last."
