"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url

# Markers of verification pages and of pages that need a browser.
TITLE_MARKERS = ("安全验证", "百度百科-验证", "人机验证", "验证中心")
BODY_MARKERS = ("安全验证", "请完成下方验证", "人机验证", "滑动验证", "captcha", "verify you are human", "登录后查看", "sign in to continue")
SCRIPT_MARKERS = ("javascript is disabled", "enable javascript", "just a moment", "please enable cookies", "please turn on javascript", "javascript required")
BODY_LIMIT, HEAD, FALLBACK_LIMIT = 500, 2000, 300


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def shortened(c: Column, limit: int = 160) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def sha256(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def text_title(text: Column, title: Column) -> Column:
    """The given title, else the first line that is not blank up to 80 characters, else text-<8 hex of the hash>."""
    line = F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), F.lit(0))
    return F.coalesce(blank_to_null(strip(title)), F.substring(line, 1, 80), F.concat(F.lit("text-"), F.substring(sha256(text), 1, 8)))


def html_title(html: Column, netloc: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)
    return F.when(html.rlike(r"(?i)<title[^>]*>[^<]+</title>"), strip(found)).otherwise(netloc)


#: What of a page is not seen: comments, scripts and styles with what they hold, and all other markup.
_UNSEEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]+>"


def visible_text(html: Column) -> Column:
    """Text outside of markup; white space runs become one space."""
    return F.array_join(F.filter(F.split(F.regexp_replace(html, _UNSEEN, " "), r"\s+"), lambda w: w != ""), " ")


def _first_marker(text: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(m.lower())), F.lit(m)) for m in markers])


def block_reason(html: Column, title: Column) -> Column:
    """Why a page is taken for a verification page or login wall, else null."""
    in_title = _first_marker(F.lower(F.coalesce(title, F.lit(""))), TITLE_MARKERS)
    in_head = _first_marker(F.lower(F.substring(html, 1, HEAD)), SCRIPT_MARKERS)
    text = visible_text(html)
    in_body = F.when(F.length(text) < BODY_LIMIT, _first_marker(F.lower(text), BODY_MARKERS))
    return (
        F.when(in_title.isNotNull(), F.concat(F.lit("title: "), in_title))
        .when(in_head.isNotNull(), F.concat(F.lit("script: "), in_head))
        .when(in_body.isNotNull(), F.concat(F.lit("body: "), in_body))
    )


def needs_browser(content: Column) -> Column:
    s = strip(F.coalesce(content, F.lit("")))
    return (F.length(s) < FALLBACK_LIMIT) | _first_marker(F.lower(F.substring(s, 1, HEAD)), SCRIPT_MARKERS).isNotNull()


def image_sources(html: Column, page: Column | None = None, cap: int = 50) -> Column:
    """Sources of img elements in order, duplicates kept, without data: URLs, at most ``cap``.

    An element's last src or data-src counts. With the page's address relative sources become absolute.
    """
    elements = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>?"), F.lit(0))
    values = lambda e: F.regexp_extract_all(e, F.lit(r"""(?i)src=["']([^"']+)["']"""), F.lit(1))
    found = F.filter(F.array_compact(F.transform(elements, lambda e: F.try_element_at(values(e), F.lit(-1)))), lambda u: ~F.startswith(u, F.lit("data:")))
    found = F.slice(found, 1, cap)
    return found if page is None else F.transform(found, lambda u: url.resolve(page, u))


# Names of languages by BCP-47 primary tag.
LANGUAGES = {"en": "English", "zh": "Chinese", "pt": "Portuguese", "es": "Spanish", "fr": "French", "de": "German", "ja": "Japanese", "ko": "Korean", "it": "Italian", "ru": "Russian"}


def language_name(tag: Column) -> Column:
    """The name of a BCP-47 tag by its first part, the tag itself if well formed but unknown, else English."""
    tag = strip(F.coalesce(tag, F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(tag.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*\z"), F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(tag, "^[A-Za-z]+", 0))), tag)).otherwise(F.lit("English"))


def duration(seconds: Column) -> Column:
    """Seconds in Chinese words: hours and minutes, or minutes and seconds, or seconds; zero tails go."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(s < 60, F.concat(s, F.lit(" 秒")))
        .when(s < 3600, F.when(rest > 0, F.concat(m, F.lit(" 分 "), rest, F.lit(" 秒"))).otherwise(F.concat(m, F.lit(" 分"))))
        .otherwise(F.when(m > 0, F.concat(h, F.lit(" 小时 "), m, F.lit(" 分"))).otherwise(F.concat(h, F.lit(" 小时"))))
    )


def rfc3339(text: Column) -> Column:
    """Timestamp of RFC 3339 text, nanoseconds cut to microseconds; null before 1970 or if malformed."""
    micro = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    at = F.try_to_timestamp(micro)
    return F.when(at >= F.lit("1970-01-01 00:00:00").cast("timestamp"), at)


def permanent_browser_error(message: Column) -> Column:
    """The code of a certificate error, or of a host that serves no TLS; null where a retry may help."""
    cert = F.regexp_extract(message, r"net::(ERR_CERT_\w+)", 1)
    return F.when(cert != "", cert).when(F.contains(message, F.lit("net::ERR_SSL_UNRECOGNIZED_NAME_ALERT")), F.lit("ERR_SSL_UNRECOGNIZED_NAME_ALERT"))


def principal_key(sub: Column, uid: Column, api_key: Column, forwarded: Column, host: Column) -> Column:
    """Whom a request counts for: token subject, hashed key, first forwarded hop, host, unknown."""
    hop = strip(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(blank_to_null(sub), blank_to_null(uid), F.when(api_key != "", F.substring(sha256(api_key), 1, 16)), blank_to_null(hop), blank_to_null(host), F.lit("unknown"))


def pipe_row(cells: Column) -> Column:
    """One row of a pipe table: bars escaped, line breaks to spaces, nulls empty."""
    clean = F.transform(cells, lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", r"\\|"), r"\r\n|\r|\n", " "))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def pipe_table(rows: Column) -> Column:
    """A pipe table of rows of cells: the first is the header, short rows are filled up."""
    width = F.aggregate(rows, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    even = F.transform(rows, lambda r: pipe_row(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(even, 1, 1), F.array(rule), F.slice(even, 2, F.greatest(F.size(even) - 1, F.lit(0)))), "\n")
