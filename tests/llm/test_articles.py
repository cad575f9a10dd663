"""Marked articles are whole, whatever their wrappers are called."""

import pytest

from tallyframe.llm import html_text

ARTICLE = "<article><h1>T</h1><p>text here</p></article>"
PAGES = {
    f"<div class='with-sidebar'>{ARTICLE}</div>": "T\n\ntext here",
    f"<div class='no-banner'>{ARTICLE}<div class='sidebar'><p>no</p></div></div>": "T\n\ntext here",
    f"<div id='page-search'>{ARTICLE}</div>": "T\n\ntext here",
    f"<div class='search'>{ARTICLE}</div>": "T\n\ntext here",
    f"<main><p>real</p></main><div class='comments'>{ARTICLE}</div><aside>{ARTICLE}</aside><div hidden>{ARTICLE}</div>": "real",
    "<article><p>a</p><section id='discussion'><p>b</p></section><h2 id='related-work'>c</h2><p class='notice-period'>d</p></article>": "a\n\nb\n\nc\n\nd",
    "<article><p>a</p><ul><li><a href=x>Smith 2001</a></li></ul><h2><a href=y>linked</a></h2></article>": "a\n\nSmith 2001\n\nlinked",
    "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>": "so x=2 holds",
    "<article><p>a</p><div id='comments'><p>no</p></div><div class='site-footer'>no</div></article>": "a",
}


@pytest.mark.parametrize("page", PAGES)
def test_articles_are_whole(page):
    assert html_text.main_text(page) == PAGES[page]
