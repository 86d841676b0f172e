"""Bytes, images and file names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of file name extensions, magic numbers, image types, engine preferences.
FAMILIES = {
    "pdf": ("pdf",), "office-doc": ("doc", "docx"), "office-sheet": ("xls", "xlsx"), "office-slide": ("ppt", "pptx"),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif"), "text": ("md", "txt", "csv", "html", "htm"),
}
MAGIC = (
    ("25504446", ("pdf",)), ("89504E470D0A1A0A", ("image",)), ("FFD8FF", ("image",)), ("47494638", ("image",)), ("424D", ("image",)), ("49492A00", ("image",)), ("4D4D002A", ("image",)),
    ("504B0304", ("office-doc", "office-slide", "office-sheet")), ("D0CF11E0A1B11AE1", ("office-doc", "office-sheet", "office-slide")), ("4D5A", ("executable",)),
)
IMAGE_MAGIC = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp"))
IMAGE_EXTENSIONS = (("image/png", ".png"), ("image/jpeg", ".jpg"), ("image/gif", ".gif"), ("image/webp", ".webp"), ("image/tiff", ".tiff"), ("image/bmp", ".bmp"))
ENGINES = {
    "pdf": ("paddle", "pdfium", "markitdown"), "docx": ("docx-native", "markitdown"), "doc": ("docx-native", "markitdown"), "pptx": ("pptx-native", "markitdown"), "ppt": ("pptx-native", "markitdown"),
    "xlsx": ("xlsx-native", "markitdown"), "xls": ("xlsx-native", "markitdown"), "png": ("vision-native", "ocr-native"), "jpg": ("vision-native", "ocr-native"),
    "jpeg": ("vision-native", "ocr-native"), "tiff": ("vision-native", "ocr-native"), "bmp": ("vision-native", "ocr-native"), "webp": ("vision-native", "ocr-native"),
    "csv": ("markitdown",), "md": ("markitdown",), "txt": ("markitdown",),
}
DEFAULT_ENGINES = ("markitdown",)
RATIOS = ((16, 9), (4, 3), (3, 2), (1, 1), (9, 16), (3, 4), (2, 3))
MAX_BYTES, MAX_PAGES, MIN_SIDE, VISION_SIDE = 52_428_800, 200, 100, 200


def extension(filename: Column) -> Column:
    """Lower-cased text behind the last dot of the name, '' without one."""
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))).otherwise(F.lit(""))


def _starts(content: Column, magic: str) -> Column:
    return F.hex(F.substring(content, 1, len(magic) // 2)) == magic


def detected_families(head: Column) -> Column:
    """Families that the first bytes may be of, [] if unknown."""
    out = F.when(F.hex(F.substring(head, 1, 4)).eqNullSafe("52494646") & (F.hex(F.substring(head, 9, 4)) == "57454250"), F.array(F.lit("image")))
    for magic, families in MAGIC:
        out = out.when(_starts(head, magic), F.array(*[F.lit(f) for f in families]))
    return out.otherwise(F.array().cast("array<string>"))


def claimed_family(filename: Column) -> Column:
    ext = extension(filename)
    out = F.lit(None).cast("string")
    for family, extensions in FAMILIES.items():
        out = F.when(ext.isin(*extensions), F.lit(family)).otherwise(out)
    return out


def mime_ok(filename: Column, head: Column) -> Column:
    """Whether name and content agree: never for executables, always for what can't be told."""
    found, claimed = detected_families(head), claimed_family(filename)
    return F.when(F.array_contains(found, "executable"), False).when((F.size(found) == 0) | claimed.isNull(), True).otherwise(F.array_contains(found, claimed))


def size_ok(content: Column, limit: int = MAX_BYTES) -> Column:
    return F.octet_length(content) <= limit


def pages_ok(pages: Column, limit: int = MAX_PAGES) -> Column:
    """Too many pages are rejected; an unreadable count passes."""
    return F.coalesce(pages <= limit, F.lit(True))


def image_type(content: Column, default: str = "image/png") -> Column:
    out = F.when(F.hex(F.substring(content, 1, 4)).eqNullSafe("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), F.lit("image/webp"))
    for magic, mime in IMAGE_MAGIC:
        out = out.when(_starts(content, magic), F.lit(mime))
    return out.otherwise(F.lit(default))


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height of a PNG from its header, null for other bytes."""
    is_png = _starts(content, "89504E470D0A1A0A") & (F.octet_length(content) >= 24)
    number = lambda at: F.when(is_png, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long"))
    return number(17), number(21)


def preferred_engines(filename: Column, url: Column | None = None) -> Column:
    ext = extension(filename)
    out = F.array(*[F.lit(e) for e in DEFAULT_ENGINES])
    for name, engines in ENGINES.items():
        out = F.when(ext == name, F.array(*[F.lit(e) for e in engines])).otherwise(out)
    return out if url is None else F.when(F.coalesce(url, F.lit("")) != "", F.array(F.lit("url"))).otherwise(out)


def select_engine(filename: Column, available: Column, url: Column | None = None) -> Column:
    """The first preferred engine that is available, else the first preferred one."""
    preferred = preferred_engines(filename, url)
    return F.coalesce(F.get(F.filter(preferred, lambda e: F.array_contains(available, e)), F.lit(0)), F.get(preferred, F.lit(0)))


def fallback_chain(filename: Column, after: Column, registered: Column) -> Column:
    """Registered engines behind a given one; none if it is not in the chain; all for null."""
    chain = F.filter(preferred_engines(filename), lambda e: F.array_contains(registered, e))
    at = F.array_position(chain, after)
    return F.when(after.isNull(), chain).when(at > 0, F.slice(chain, at.cast("int") + 1, F.size(chain))).otherwise(F.array().cast("array<string>"))


def aspect_ratio(width: Column, height: Column) -> Column:
    """A common ratio if near, else the reduced one; '' if a side is unknown or 0."""
    a, b = F.greatest(width, height).cast("long"), F.least(width, height).cast("long")
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"])).alias("b")))
    divisor = pair["a"]
    rw, rh = F.floor(width / divisor), F.floor(height / divisor)
    ratio = width.cast("double") / height
    out = F.concat_ws(":", rw, rh)
    for limit, only_long in ((0.1, True), (0.05, False)):
        for w, h in reversed(RATIOS):
            near = F.abs(ratio - F.lit(w) / F.lit(h)) < limit
            out = F.when(near & ((rw > 20) | (rh > 20)) if only_long else near, F.lit(f"{w}:{h}")).otherwise(out)
    return F.when((F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0), F.lit("")).otherwise(out)


def image_kept(width: Column, height: Column) -> Column:
    """Images stay unless both sides are known and one is under the least."""
    return F.coalesce((width >= MIN_SIDE) & (height >= MIN_SIDE), F.lit(True)) | width.isNull() | height.isNull()


def vision_status(configured: bool, width: Column, height: Column) -> Column:
    if not configured:
        return F.lit("skipped")
    unknown = width.isNull() | height.isNull()
    return F.when(unknown | ((width >= VISION_SIDE) & (height >= VISION_SIDE)), F.lit("pending")).otherwise(F.lit("skipped"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes of 16 hex digits differ."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
