"""URL rules as Column expressions and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Tracking parameters, blocked file types, pages that can't be read, image rates, private ranges.
TRACKING_KEYS = ("gclid", "gclsrc", "gbraid", "wbraid", "fbclid", "yclid", "msclkid", "dclid", "ref", "ref_src", "ref_url")
TRACKING_PREFIXES = ("gad_", "utm_", "mc_")
BLOCKED_SUFFIXES = (
    ".mp4", ".avi", ".mov", ".wmv", ".flv", ".mkv", ".webm", ".m4v", ".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a", ".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz",
    ".exe", ".msi", ".dmg", ".pkg", ".deb", ".rpm", ".apk", ".ipa", ".iso", ".img", ".ttf", ".otf", ".woff", ".woff2",
)
UNREADABLE = (
    ("bilibili.com", "/video/", "bilibili video page"),
    ("b23.tv", None, "bilibili short link"),
    ("douyin.com", "/video/", "douyin video page"),
    ("v.douyin.com", None, "douyin short link"),
    ("tiktok.com", "/@[^/]+/video/", "tiktok video page"),
    ("iqiyi.com", "/v_", "iqiyi video page"),
    ("youku.com", "/v_show", "youku video page"),
    ("ixigua.com", r"/\d+", "xigua video page"),
    ("larksuite.com", None, "login wall"),
)
IMAGE_RATES = (("qpic.cn", 10), ("xhscdn.com", 3), ("xiaohongshu.com", 3), ("sinaimg.cn", 5), ("pbs.twimg.com", 2), ("pic-bj.bcebos.com", 5), ("zhimg.com", 5))
DEFAULT_RATE = 10
PRIVATE_RANGES = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
)
MAX_LENGTH = 2048
#: Handlers of sites in the order they are asked; the last takes everything.
SITES = (
    ("wechat", ("mp.weixin.qq.com",)),
    ("xhs", ("xiaohongshu.com", "xhslink.com")),
    ("x", ("x.com", "twitter.com")),
    ("feishu", ("feishu.cn",)),
    ("blacklist", None),
    ("baike", ("baike.baidu.com",)),
    ("generic", None),
)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _URL, 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, _URL, 2)


def path(u: Column) -> Column:
    return F.regexp_extract(u, _URL, 3)


def query(u: Column) -> Column:
    return F.regexp_extract(u, _URL, 4)


def host(u: Column) -> Column:
    """Host in lower case, without credentials and port; '' if there is none."""
    at = F.regexp_replace(netloc(u), "^.*@", "")
    return F.lower(F.when(F.startswith(at, F.lit("[")), F.regexp_extract(at, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(at, ":.*$", "")))


def port(u: Column) -> Column:
    """Port as text; '' if there is none."""
    return F.regexp_extract(F.regexp_replace(netloc(u), "^.*@", ""), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)


def host_is(h: Column, suffix: str) -> Column:
    return (h == suffix) | F.endswith(h, F.lit("." + suffix))


def gate(u: Column) -> Column:
    """Why a URL can't be ingested: a code, or null where it may."""
    credentials = F.regexp_extract(netloc(u), "^(.*)@", 1)
    low = F.lower(path(u))
    media = F.lit(False)
    for s in BLOCKED_SUFFIXES:
        media = media | F.endswith(low, F.lit(s))
    return (
        F.when(F.coalesce(F.length(u), F.lit(0)).between(1, MAX_LENGTH) == F.lit(False), "length")
        .when(~scheme(u).isin("http", "https"), "scheme")
        .when(~credentials.isin("", ":"), "credentials")
        .when(~port(u).isin("", "80", "443"), "port")
        .when(host(u) == "", "host")
        .when(media, "file_type")
    )


def strip_tracking(u: Column) -> Column:
    """URL without tracking parameters; the others stay as they are written."""
    q = query(u)
    key = lambda p: F.get(F.split(p, "="), F.lit(0))

    def stays(p: Column) -> Column:
        out = ~key(p).isin(*TRACKING_KEYS)
        for prefix in TRACKING_PREFIXES:
            out = out & ~F.startswith(key(p), F.lit(prefix))
        return out

    kept = F.array_join(F.filter(F.split(q, "&"), stays), "&")
    base, tail = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"(#.*)$", 1)
    return F.when(q == "", u).otherwise(F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), tail))


def resolve(base: Column, ref: Column) -> Column:
    """A reference as an absolute address: of a page, against the page's own address."""
    scheme_, rest = r"^([A-Za-z][A-Za-z0-9+.-]*):", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
    origin, own = F.regexp_extract(base, rest, 0), F.regexp_extract(base, rest + "([^?#]*)", 1)
    target, tail = F.regexp_extract(ref, "^[^?#]*", 0), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_replace(own, "[^/]*$", ""), F.when(own == "", F.lit("/")).otherwise(F.lit("")))
    steps = F.split(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, target)), "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))),
    )
    open_ = F.when(F.element_at(steps, -1).isin("..", "."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(origin, F.lit("/"), F.regexp_replace(F.concat(F.array_join(kept, "/"), open_), "^/$", ""), tail)
    return (
        F.when(ref.rlike(scheme_), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, scheme_, 1), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(origin, own, ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(F.regexp_extract(base, "^[^#]*", 0), ref))
        .otherwise(joined)
    )


def image_rate(h: Column) -> Column:
    out = F.lit(DEFAULT_RATE)
    for suffix, rate in reversed(IMAGE_RATES):
        out = F.when(host_is(h, suffix), F.lit(rate)).otherwise(out)
    return out


def canonical_image(u: Column) -> Column:
    """Image URLs of three networks with their JPEG or original variant asked for; others as they are."""
    h, q = host(u), query(u)
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    joined = lambda *parts: F.concat(base, F.lit("?"), F.concat_ws("&", *parts))
    some = F.when(q != "", q)
    pairs = F.filter(F.split(q, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("name=")))
    x_query = F.array_join(F.concat(pairs, F.array(F.lit("name=orig")), F.when(q.rlike("(^|&)format="), F.array().cast("array<string>")).otherwise(F.array(F.lit("format=jpg")))), "&")
    return (
        F.when((h == "mmbiz.qpic.cn") & ~q.rlike("(^|&)wx_fmt="), joined(some, F.lit("wx_fmt=jpeg")))
        .when(h == "pbs.twimg.com", F.concat(base, F.lit("?"), x_query))
        .when((host_is(h, "xhscdn.com") | host_is(h, "xiaohongshu.com")) & F.contains(q, F.lit("format/webp")), F.concat(base, F.lit("?"), F.replace(q, F.lit("format/webp"), F.lit("format/jpg"))))
        .otherwise(u)
    )


def unreadable(u: Column, more: tuple[str, ...] = ()) -> Column:
    """Why pages of this address can't be read, else null; more: suffixes that are out of reach."""
    h, p = host(u), path(u)
    rules = [F.when(host_is(h, s) & (p.rlike(r) if r else F.lit(True)), F.lit(why)) for s, r, why in UNREADABLE]
    return F.coalesce(*rules, *[F.when(host_is(h, s), F.lit("region unreachable")) for s in more], F.lit(None).cast("string"))


def site(u: Column) -> Column:
    """The handler that takes a URL: the first that matches."""
    h = host(u)
    out = F.lit("generic")
    for name, suffixes in reversed(SITES[:-1]):
        match = unreadable(u).isNotNull() if suffixes is None else F.lit(False)
        for s in suffixes or ():
            match = match | host_is(h, s)
        out = F.when(match, F.lit(name)).otherwise(out)
    return out


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    parts = F.split(ip, r"\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).cast("long") * (256 ** (3 - k)) for k in range(4)), F.lit(0).cast("long"))
    return F.when(ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), number)


def address_key(ip: Column) -> Column:
    """Family, 4 or 6, and the address in hexadecimal digits of fixed width, which sort as addresses do; null if it is none."""
    wide = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    dotted = r"(\d+\.\d+\.\d+\.\d+)$"
    tail = wide(ipv4_number(F.regexp_extract(ip, dotted, 1)), 8)
    spelt = F.when(ip.rlike(dotted), F.concat(F.regexp_replace(ip, dotted, ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(ip)
    halves = F.split(F.upper(spelt), "::")
    well_formed = F.forall(halves, lambda h: h.rlike(r"^([0-9A-F]{1,4}(:[0-9A-F]{1,4})*)?\z"))
    groups = lambda k: F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    before, after = groups(0), groups(1)
    gap = 8 - F.size(before) - F.size(after)
    whole = F.when(F.size(halves) == 1, gap == 0).when(F.size(halves) == 2, gap > 0)
    digits = F.transform(F.concat(before, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), after), lambda g: F.lpad(g, 4, "0"))
    return F.when(F.contains(ip, F.lit(":")), F.when(well_formed & whole, F.concat(F.lit("6"), F.array_join(digits, "")))).otherwise(F.concat(F.lit("4"), wide(ipv4_number(ip), 8)))


def private_ranges(spark: SparkSession) -> DataFrame:
    """(low, high, range): the ranges that must not be fetched from, by address_key."""
    import ipaddress

    nets = [ipaddress.ip_network(n) for n in PRIVATE_RANGES]
    rows = [(*(f"{n.version}{int(a):0{n.max_prefixlen // 4}X}" for a in (n.network_address, n.broadcast_address)), str(n)) for n in nets]
    return spark.createDataFrame(rows, "low string, high string, range string")


def blocked_addresses(addresses: DataFrame, ip: str = "ip") -> DataFrame:
    """addresses with the private range they are in, or null: a range join with fourteen broadcast rows."""
    ranges = F.broadcast(private_ranges(addresses.sparkSession))
    return addresses.withColumn("_n", address_key(F.col(ip))).join(ranges, F.col("_n").between(F.col("low"), F.col("high")), "left").drop("_n", "low", "high")


def is_private(ip: str) -> bool:
    """The same for one address of either family; embedded IPv4 counts as itself."""
    import ipaddress

    a = ipaddress.ip_address(ip)
    return any(a in ipaddress.ip_network(n) for n in PRIVATE_RANGES)
