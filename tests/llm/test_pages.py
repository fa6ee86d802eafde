"""Main text of pages: names that mislead, what has no name, and the whole query against a plain reader of articles."""

import os
from html.parser import HTMLParser

import pytest

from veritally.llm import html_extract

FOLDER = "/root/testdata/sf0.001"
TEXT = " ".join(f"word{k}" for k in range(66))
NAMED = [
    '<div class="elementor-widget">@</div>', '<div class="widget"><article>@</article></div>', '<section id="feedback"><article>@</article></section>', '<div class="page-social"><main>@</main></div>',
    '<div class="modal"><article>@</article></div>', '<div class="article-tracking">@</div>', '<div class="notice"><main>@</main></div>', '<div class="related">@</div>',
]
NOTICE = "We use cookies on this site to make it better for you and for everyone who visits it."
COMMENT = "I think that this article is very long and deserves an answer by someone who knows it better."
ARTICLE = f"<article><h1>Title of it</h1><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p></article>"


@pytest.mark.parametrize("page", NAMED)
def test_a_name_alone_takes_no_article_away(page):
    for before, after in (("", ""), ("<nav><a href=1>One</a></nav>", "<footer>foot</footer>"), (f'<div class="cookie-notice">{NOTICE}</div>', f'<section class="comments"><p>{COMMENT}</p></section>')):
        assert html_extract.main_text(f"<html><body>{before}{page.replace('@', f'<p>{TEXT}</p>')}{after}</body></html>") == TEXT


@pytest.mark.parametrize("other", [f'<div class="hinweis">{NOTICE}</div>', f'<div class="thread"><div>{COMMENT}</div><div>{COMMENT}</div></div>', f"<div>{TEXT}</div>", f'<div class="related-posts"><p>{TEXT}</p></div>', f'<div class="social"><p>{TEXT}</p></div>'])
def test_what_stands_beside_an_article_goes_whatever_its_name(other):
    want = f"Title of it\n{TEXT}\nShort.\n{TEXT}"
    for page in (other + ARTICLE, ARTICLE + other, f"<div id=page>{other}<div><main>{ARTICLE}</main></div></div>"):
        assert html_extract.main_text(f"<body>{page}</body>") == want


def test_a_teaser_in_an_article_element_does_not_hide_the_text():
    page = f"<body><article>See also this one</article><div><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div></body>"
    assert html_extract.main_text(page).endswith("\n".join([TEXT] * 3))


class Articles(HTMLParser):
    """The text of the article element by blocks, without what cannot be text in it."""

    OUT = {"nav", "aside", "footer", "script", "style", "form", "select", "button", "noscript", "iframe", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.stack = [], "", []

    def close_block(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BREAKS:
            self.close_block()
        elif tag in html_extract.SPACES:
            self.text += " "
        if tag not in html_extract.VOID:
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            self.stack.append((tag, tag in self.OUT or any(n in names for n in ("ad", "cookie", "comment", "share", "related"))))

    def handle_endtag(self, tag):
        if tag in html_extract.BREAKS:
            self.close_block()
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(out for _, out in self.stack):
            self.text += data


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_whole_query_equals_a_plain_reader_of_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = html_extract.query(spark, FOLDER).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        plain = Articles()
        plain.feed(pages[r.page_id].html)
        plain.close()
        plain.close_block()
        assert r.text == "\n".join(plain.blocks) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
