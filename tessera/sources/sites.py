"""Extraction rules of single sites over fetched HTML."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE_CAP = 50
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style"))

# Hosts, names and marks of the sites.
XHS_IMAGE_HOSTS = ("xhscdn.com", "xiaohongshu.com")
XHS_NOISE = re.compile("avatar|qrcode|icon", re.IGNORECASE)
XHS_SUFFIX, BAIKE_SUFFIX = re.compile(r"\s*-\s*小红书\s*$"), "_百度百科"
FEISHU_IMAGE_HOST = "internal-api-drive-stream.feishu.cn"
BAIKE_LEAST, BAIKE_WORDS = 200, ("播报", "编辑")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def below(self) -> Iterator[Node | str]:
        """Elements and texts below in order; nesting may have any depth."""
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            yield c
            if isinstance(c, Node):
                todo += c.children[::-1]

    def walk(self) -> Iterator[Node]:
        return (c for c in self.below() if isinstance(c, Node))

    def text(self) -> str:
        return "".join(c for c in self.below() if isinstance(c, str))

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in _SILENT:
            self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _first(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if test(n)), None)


def _said(node: Node | None) -> str:
    return node.text().strip() if node is not None else ""


def _meta(root: Node, key: str, value: str) -> str:
    node = _first(root, lambda n: n.tag == "meta" and n.attrs.get(key) == value)
    return node.attrs.get("content", "").strip() if node is not None else ""


def _host(src: str) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", src)
    return m[1].lower() if m else ""


def _images(nodes: Iterator[Node], keep, sources=("data-src", "src"), cap: int | None = IMAGE_CAP) -> list[str]:
    """Sources of img elements once each, in order."""
    found: dict[str, None] = {}
    for n in nodes:
        src = next((n.attrs[s] for s in sources if n.attrs.get(s)), "") if n.tag == "img" else ""
        if src and not src.startswith("data:") and keep(src):
            found.setdefault(src)
    return list(found)[:cap]


def xhs(html: str) -> tuple[str, str, list[str]]:
    """(title, body, images) of a note; each falls back over the page's layouts."""
    root = parse(html)
    by_id = lambda i: _first(root, lambda n: n.attrs.get("id") == i)
    title = XHS_SUFFIX.sub("", _said(_first(root, lambda n: n.tag == "title"))) or _meta(root, "property", "og:title") or _said(by_id("detail-title")) or _said(_first(root, lambda n: n.tag == "h1"))
    body = _meta(root, "name", "description")
    if not body:
        for node in (n for n in root.walk() if n.has_class("author-desc")):
            for trigger in (n for n in node.walk() if "author-desc-trigger" in n.attrs.get("class", "")):
                if trigger.children and isinstance(trigger.children[0], str):
                    trigger.children[0] = ""
            body = body or _said(node)
    body = body or _said(by_id("detail-desc")) or _meta(root, "property", "og:description")
    return title, body, _images(root.walk(), lambda s: any(h in s for h in XHS_IMAGE_HOSTS) and not XHS_NOISE.search(s))


def is_video_note(url: str) -> bool:
    query = url.partition("?")[2].partition("#")[0]
    return next((v for k, _, v in (p.partition("=") for p in query.split("&")) if k == "type"), "") == "video"


def wechat(html: str) -> tuple[str, str, list[str]]:
    """(title, text, images) of an image post or an article, told apart by their elements."""
    root = parse(html)
    by_id = lambda i: _first(root, lambda n: n.attrs.get("id") == i)
    lazy = lambda node: _images(node.walk(), lambda s: True, ("data-src",))
    post, article = by_id("js_image_content"), by_id("js_content")
    if post is not None:
        title, told = _said(_first(post, lambda n: n.tag == "h1" and "class" in n.attrs)), by_id("js_image_desc")
        images = lazy(told) if told is not None else []
        boxed = (i for box in post.walk() if box.tag == "div" and "class" in box.attrs for i in _images(box.walk(), lambda s: s not in images, ("data-src",)))
        return title, " ".join(_said(told).split()), [*[i for _, i in zip(range(1), boxed)], *images][:IMAGE_CAP]
    if article is None:
        return "", "", []
    name = by_id("activity-name")
    inner = _first(name, lambda n: n.attrs.get("class") == "js_title_inner") if name is not None else None
    return _said(inner if inner is not None else name) or _said(_first(root, lambda n: n.tag == "title")), " ".join(_said(article).split()), lazy(article)


def baike(html: str) -> tuple[str, str, list[str]]:
    """(title, text, images) of an entry: its paragraphs, or all visible text without controls where they are too short."""
    root = parse(html)
    title = _said(_first(root, lambda n: n.tag == "title")).removesuffix(BAIKE_SUFFIX).strip()
    body = "\n".join(t for n in root.walk() if "para_" in n.attrs.get("class", "") if (t := _said(n)))
    if len(body) < BAIKE_LEAST:
        visible = " ".join(root.text().split())
        visible = re.sub(r"目录\s*(?:\d+\s+\S+\s*)+", " ", visible)
        for word in BAIKE_WORDS:
            visible = visible.replace(word, " ")
        body = " ".join(visible.split())
    return title, body, _images(root.walk(), lambda s: True)


def baike_card(card: str, lemma_id: int | None, key: str) -> tuple[str, str, list[str]] | None:
    """The same from an API card, if it is of the wanted entry and has an abstract."""
    try:
        c = json.loads(card)
    except ValueError:
        return None
    if "errno" in c or lemma_id is not None and c.get("newLemmaId") != lemma_id or not (c.get("abstract") or "").strip():
        return None
    parts = [(c.get("desc") or "").strip(), c["abstract"].strip()]
    return (c.get("title") or key).strip(), "\n\n".join(p for p in parts if p), [c["image"]] if c.get("image") else []


def feishu_images(html: str) -> list[str]:
    return _images(parse(html).walk(), lambda s: _host(s) == FEISHU_IMAGE_HOST, ("src",), None)


def named_images(markdown: str, urls: list[str], names: list[str]) -> str:
    """markdown with image addresses replaced by names; names whose address isn't there follow at the end."""
    missing = []
    for u, n in zip(urls, names):
        if f"]({u})" in markdown:
            markdown = markdown.replace(f"]({u})", f"]({n})")
        else:
            missing.append(f"![]({n})")
    return "\n\n".join([markdown.rstrip(), *missing]) if missing else markdown


def feishu(html: str) -> tuple[str, str, list[str]]:
    root = parse(html)
    return _said(_first(root, lambda n: n.tag == "title")), " ".join(root.text().split()), feishu_images(html)[:IMAGE_CAP]


SITES = {"wechat": wechat, "xhs": xhs, "baike": baike, "feishu": feishu}


def extract_sites(pages: DataFrame) -> DataFrame:
    """(page_id, site, html) -> (page_id, site, title, body, images) for the sites with rules of their own."""

    def work(frames):
        for pdf in frames:
            rows = [(i, s, *SITES[s](h or "")) for i, s, h in zip(pdf.page_id, pdf.site, pdf.html)]
            yield pd.DataFrame(rows, columns=["page_id", "site", "title", "body", "images"])

    own = pages.where(F.col("site").isin(*SITES)).select("page_id", "site", "html")
    return own.mapInPandas(work, "page_id long, site string, title string, body string, images array<string>")


# Main content of any page.

# Class names of article containers, and the least text that makes one.
CONTAINER_CLASSES = ("entry-content", "post-content", "article-content", "content-inner")
CONTAINER_LEAST = 300
#: Elements that hold no content, and those that begin a block of their own.
_BESIDE = frozenset("nav header footer aside form button select iframe template noscript script style head title".split())
_BLOCK = frozenset("address article blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: A block of prose, from which a page is taken to have content of its own.
_PROSE = 80


def _blocks(root: Node, beside: frozenset[str] = _BESIDE) -> list[tuple[str, str, int]]:
    """(tag, text, characters in links) of the blocks below root in order, images as markdown; nesting of any depth."""
    out: list[tuple[str, str, int]] = []
    parts: list[str] = []
    linked, tag, links = 0, "", 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((tag, text, linked))
        parts.clear()
        linked = 0

    todo: list = [(root, False)]
    while todo:
        node, leaves = todo.pop()
        if isinstance(node, str):
            parts.append(node)
            linked += len(node.strip()) if links else 0
        elif leaves:
            links -= node.tag == "a"
            if node.tag in _BLOCK:
                flush()
                tag = ""
        elif node.tag not in beside:
            if node.tag in _BLOCK:
                flush()
                tag = node.tag
            links += node.tag == "a"
            src = (node.attrs.get("data-src") or node.attrs.get("src") or "") if node.tag == "img" else ""
            if src and not src.startswith("data:"):
                parts.append(f" ![]({src}) ")
            todo.append((node, True))
            todo += [(c, False) for c in reversed(node.children)]
    flush()
    return out


def _markdown(blocks: list[tuple[str, str, int]]) -> str:
    mark = lambda tag: "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else {"li": "- ", "blockquote": "> "}.get(tag, "")
    return "\n\n".join(mark(tag) + text for tag, text, _ in blocks)


def _is_container(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("itemprop") == "articleBody" or (node.tag == "div" and any(node.has_class(c) for c in CONTAINER_CLASSES))


def main_content(html: str) -> str:
    """The main text of a page as markdown: of three ways the first that finds some.

    1. Blocks outside of menus, headers, footers and forms that are not mostly links, if one of them is prose;
       only those of one article's container where it holds half of that text or more.
    2. The container of an article, by its element, property or class, that holds most text, from CONTAINER_LEAST characters on.
    3. All text of the page but scripts and styles.
    """
    root = parse(html)
    containers = [n for n in root.walk() if _is_container(n)]
    size = lambda blocks: sum(len(text) for _, text, _ in blocks)
    said = lambda n: [b for b in _blocks(n) if 2 * b[2] < len(b[1])]
    own, inner = said(root), max(map(said, containers), key=size, default=[])
    if any(len(text) >= _PROSE for tag, text, _ in own if not re.fullmatch("h[1-6]", tag)):
        return _markdown(inner if 2 * size(inner) >= size(own) else own)
    silent = frozenset(("script", "style", "head", "title"))
    most = max((_blocks(n, silent) for n in containers), key=size, default=[])
    return _markdown(most if size(most) >= CONTAINER_LEAST else _blocks(root, silent))


def extract_main(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text): main_content of whole pages; a null page has no text."""

    def work(frames):
        for pdf in frames:
            yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": [main_content(h or "") for h in pdf.html]})

    return pages.select("page_id", "url", "html").mapInPandas(work, "page_id long, url string, text string")
