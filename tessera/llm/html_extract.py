"""HTML main-text extraction by line-block distribution.

Markup is stripped into *lines*, one for each block element, with inline
elements joined and character references decoded. Lines of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, told by tag,
class, id and role, are taken out first: text lengths alone can't tell an
advert beside an article from a paragraph of it. A line's weight is the length
of its text outside links. Where a page marks its article, the mark is the
weight: inside it links count too, and lines outside weigh nothing.

Weights are summed over sliding windows of ``WINDOW`` lines, on every page by
the same rule. The sum *surges* where it passes ``SURGE_SHARE`` of the page's
largest and *dives* where it falls to nothing; every stretch of lines that
surges is kept up to its dive, whole. Before the surge, in a page without a
mark, go lines that neither weigh a window's share of the threshold nor end as
a sentence nor are headings: what stands above a text, such as a skip link.

One pass of Arrow batches without a shuffle; a page is handled by itself.

Defined results: null or empty html gives an empty text; unclosed scripts,
styles and comments reach to the end of the page; an unclosed boilerplate
element ends with the element around it; a page without blocks of enough text
gives its heaviest stretch all the same; repeated rows are extracted each; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WINDOW = 3
#: A stretch's window sum has to pass this share of the page's largest.
SURGE_SHARE = 0.2

# Element names of HTML by what they mean for the text.
_RAW = "script|style|noscript|template|textarea|iframe|svg|math|select|title|object|canvas"
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where another of the same kind begins.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
BOILERPLATE = frozenset("nav footer aside form menu button dialog label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words in class and id names that mark boilerplate, those that do outside of articles, and words that may stand beside them in a name.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
HEADER_HINTS = frozenset("header topbar".split())
BESIDE = frozenset(
    "a an and area article articles bar bottom box btn button buttons card cards col column container content desktop entry field fixed foot form global group head header holder home icons image info inner "
    "international item items layer left law legal line link links list lower main media message middle mini mobile more nav new overlay page panel policy post posts primary right row section secondary sidebar site slot small spot stack "
    "sticky stories story strip sub tab tags the thread top topics unit up upper user view wrap wrapper zone".split()
)
_NAME_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<raw>{_RAW})\b(?>[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][\w:.-]*)(?P<rest>(?>[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][\w:.-]*)[^>]*>?""",
    re.S | re.I,
)
_SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*$")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")


@lru_cache(maxsize=4096)
def _marks(name: str, in_article: bool) -> bool:
    """Whether a class or id name marks boilerplate: it is a hint, or made of hints, numbers and words that stand beside them.

    A hint beside any other word, as in has-sidebar or social-science, tells of something else.
    """
    parts = [re.sub(r"\d+$", "", p) for p in _NAME_PARTS.split(name) if p]
    parts = [p.lower() for p in parts if p]
    hints = HINTS if in_article else HINTS | HEADER_HINTS
    return any(p in hints for p in parts) and all(p in hints or p in BESIDE for p in parts)


def _boilerplate(name: str, rest: str, in_article: bool) -> bool:
    if name in BOILERPLATE or name == "header" and not in_article:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id") and any(_marks(n, in_article) for n in html.unescape(value).split()):
            return True
        if key == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, weight, whether in a marked article, whether boilerplate, whether a heading) of each block of a page, in order."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, and whether inside boilerplate, article, link
    opened: Counter[str] = Counter()  # names on the stack: one that isn't there is not looked for
    parts: list[str] = []
    linked = 0
    boiler = article = link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, 0 if boiler else len(text) if article else max(len(text) - linked, 0), article, boiler, any(opened[h] for h in HEADINGS)))
            parts.clear()
        linked = 0

    def data(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if link:
                linked += len(text.strip())

    def close(k: int) -> None:
        nonlocal boiler, article, link
        opened.subtract(s[0] for s in stack[k:])
        del stack[k:]
        _, boiler, article, link = stack[-1] if stack else ("", False, False, False)

    at = 0
    for m in _TOKEN.finditer(page):
        data(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if m["raw"] or not name:
            continue
        block = name in BLOCKS
        if block:
            flush()
        if m["end"] or m["end2"]:
            if opened[name]:
                flush() if boiler else None
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in VOID:
            continue
        if name in SELF_CLOSING and opened[name]:  # <p> inside an open <p> ends it, also over inline elements left open
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in BLOCKS and stack[k][0] not in SELF_CLOSING:
                    break
        inner_article = article or name in ARTICLE
        inner_boiler = boiler or _boilerplate(name, m["rest"] or "", article)
        if inner_boiler and not boiler:
            flush()
        stack.append((name, inner_boiler, inner_article, link or name == "a"))
        opened[name] += 1
        _, boiler, article, link = stack[-1]
    data(page[at:])
    flush()
    return out


def stretches(weights: list[int], window: int = WINDOW, share: float = SURGE_SHARE) -> list[tuple[int, int]]:
    """[from, to) of the stretches of lines with a surge of the window sums past the threshold, up to the dive after it."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    threshold = share * max(sums, default=0)
    out, i = [], 0
    while i < len(sums):
        if weights[i] == 0:
            i += 1
            continue
        begin, surged = i, False
        while i < len(sums) and sums[i] > 0:
            surged |= sums[i] >= threshold
            i += 1
        if surged:
            out.append((begin, i))
    return out


def main_text(page: str, window: int = WINDOW, share: float = SURGE_SHARE) -> str:
    found = [line for line in lines(page) if not line[3]]
    marked = any(a and w for _, w, a, _, _ in found)
    weights = [w if a or not marked else 0 for _, w, a, _, _ in found]
    least = share * max((sum(weights[i : i + window]) for i in range(len(weights))), default=0) / window
    out: list[str] = []
    for a, z in stretches(weights, window, share):
        surge = a if marked else next(i for i in range(a, z) if weights[i] >= least)
        out += [found[i][0] for i in range(a, z) if (found[i][2] or not marked) and (i >= surge or found[i][4] or _SENTENCE_END.search(found[i][0]))]
    return " ".join(out)


OUT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text of html and its length in code points."""

    def work(batches):
        for batch in batches:
            pages = batch.column("html").to_pylist()
            for lo in range(0, len(pages), 256):
                texts = [main_text(p or "") for p in pages[lo : lo + 256]]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, len(texts)), batch.column("url").slice(lo, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_texts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), work, OUT)
