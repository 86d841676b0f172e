"""Names, attributes and open elements in HTML extraction: nothing of an article is lost for how its wrappers are called."""

import random
import time

import pytest

from tessera.llm import html_extract

LONG = "This is a paragraph of the article, long enough to be read as one."
ARTICLE = f"<article><h1>Head</h1><p>{LONG}</p><p>Second one.</p></article>"
WANT = f"Head {LONG} Second one."


@pytest.mark.parametrize(
    "wrapper",
    ['style="overflow:hidden"', "style='visibility: hidden'", 'title="the hidden truth"', 'data-id="sidebar"', 'data-class="menu" data-hidden="x"', 'class="content with-sidebar"', 'class="social-science"', 'id="post-related-works"',
     'class="has-sidebar no-comments"', 'aria-hidden="false"', 'class="layout-nav-open adapt badge"', "class='a' title='x class=menu'", 'alt="class=&quot;nav&quot;"', "class=shared id=sharepoint", 'class="commentary"'],
)
@pytest.mark.parametrize("tag", ["div", "section", "p"])
def test_wrappers_that_stay(wrapper, tag):
    assert html_extract.main_text(f"<body><{tag} {wrapper}>{ARTICLE}</{tag}></body>") == WANT
    inner = f"<body><article><h1>Head</h1><{tag} {wrapper}>{LONG}</{tag}><p>Second one.</p></article></body>"
    assert html_extract.main_text(inner) == WANT


@pytest.mark.parametrize(
    "name",
    ["sidebar", "site-footer", "nav_menu", "cookieBanner", "ad", "ad-slot-3", "ads", "related-posts", "comments-area", "comment-list", "share-bar", "social-media-links", "newsletter-signup-form", "top-nav", "SIDEBAR", "page-header", "widget widget-area", "x menu", "promo2"],
)
@pytest.mark.parametrize("key", ["class", "id", "CLASS"])
def test_names_that_go(name, key):
    assert html_extract.main_text(f'<body><div {key}="{name}"><p>{LONG} Not this one.</p></div>{ARTICLE}</body>') == WANT


def test_hidden_elements_go():
    for mark in ("hidden", 'hidden=""', "HIDDEN", 'aria-hidden="true"', "aria-hidden=true", "title=x hidden"):
        assert html_extract.main_text(f"<body><div {mark}><p>{LONG} Not this one.</p></div>{ARTICLE}</body>") == WANT


def test_random_pages():
    rng = random.Random(4)
    keep = ['class="has-sidebar"', 'style="overflow:hidden"', 'title="a hidden menu"', 'class="with-ads-off"', 'id="non-commented"', ""]
    drop = ['class="sidebar"', "hidden", 'id="comments"', 'role="navigation"', 'class="share-box left"']
    for _ in range(200):
        parts, want = [], []
        for i in range(rng.randrange(1, 8)):
            text = f"Paragraph {i} has {rng.randrange(1000)} words and some more."
            if rng.random() < 0.3:
                parts.append(f"<div {rng.choice(drop)}><p>{text}</p></div>")
            else:
                parts.append(f"<div {rng.choice(keep)}><p {rng.choice(keep)}>{text}</p></div>")
                want.append(text)
        page = "".join(parts)
        for _ in range(rng.randrange(4)):
            page = f"<div {rng.choice(keep)}>{page}</div>"
        assert html_extract.main_text(f"<html><body><main {rng.choice(keep)}>{page}</main></body></html>") == " ".join(want)


@pytest.mark.parametrize("noise", ["<b>" * 20_000 + "</i>" * 20_000, "</i>" * 60_000, "<b>" * 20_000 + "<br>x" * 20_000, "<li>x" * 20_000, "<p><b>y" * 20_000])
def test_open_and_stray_elements_in_linear_time(noise):
    began = time.perf_counter()
    text = html_extract.main_text(f"<body><article><p>{LONG}</p>{noise}</article></body>")
    assert text.startswith(LONG) and time.perf_counter() - began < 5
