"""Markdown outline and image references."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import media
from tessera.functions.text import strip

CONTEXT = 200
MIN_SIDE = 100


def outline(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, line, level, title) of each heading that is not between a pair of code fences.

    Windows run within one document. The last of an odd number of fences opens nothing.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "s"))
    fence = F.startswith("s", F.lit("```")).cast("int")
    w = Window.partitionBy(key).orderBy("line")
    counted = lines.withColumn("f", fence).withColumn("before", F.sum("f").over(w)).withColumn("total", F.sum("f").over(Window.partitionBy(key)))
    inside = (F.col("before") % 2 == 1) & (F.col("before") < F.col("total")) | (F.col("f") == 1)
    found = counted.where(F.col("s").rlike(r"^#{1,6}\s+.+") & ~inside)
    return found.select(key, "line", F.length(F.regexp_extract("s", r"^(#{1,6})\s", 1)).alias("level"), strip(F.regexp_extract("s", r"^#{1,6}\s+(.+)$", 1)).alias("title"))


@dataclass
class Ref:
    """An image that a parser took out of a document."""

    name: str
    width: int | None = None
    height: int | None = None
    page: int | None = None
    alt: str = ""
    context: str = ""
    section_title: str = ""
    position: int = 0


_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)


def place(markdown: str, refs: list[Ref]) -> list[Ref]:
    """References in document order with alternative text, context and section, small ones left out.

    Each image link takes the first reference, in order, that is free and whose
    name is part of its path or the other way round. A reference without a link
    goes before the first placed one of a later page, or to the end.
    """
    headings = [(m.start(), m.group(2).strip()) for m in _HEADING.finditer(markdown)]
    free = {r.name: r for r in refs}
    placed: list[tuple[int, int, Ref]] = []
    pages: list[tuple[int, int]] = []
    for m in _IMAGE.finditer(markdown):
        path = m.group(2)
        name = next((n for n in free if n in path or path in n), None)
        if name is None:
            continue
        ref = free.pop(name)
        around = (markdown[max(0, m.start() - CONTEXT) : m.start()].strip(), markdown[m.end() : m.end() + CONTEXT].strip())
        ref.alt, ref.context = m.group(1), "\n\n".join(a for a in around if a)
        ref.section_title = next((t for at, t in reversed(headings) if at <= m.start()), "")
        placed.append((m.start(), 1, ref))
        if ref.page is not None:
            pages.append((ref.page, m.start()))
    pages.sort()
    for ref in free.values():
        at = next((p for page, p in pages if ref.page is not None and page > ref.page), len(markdown))
        placed.append((at, 0, ref))
    placed.sort(key=lambda x: x[:2])
    out = []
    for at, _, ref in placed:
        ref.position = at
        if ref.width is None or ref.height is None or min(ref.width, ref.height) >= MIN_SIDE:
            out.append(ref)
    return out


_PLACED = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("position", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("alt", "context", "section_title")]]))


@F.pandas_udf(_PLACED)
def place_udf(markdown: pd.Series, refs: pd.Series) -> pd.Series:
    """place() over columns: refs is an array of structs (name, width, height, page)."""

    def whole(x):
        return None if x is None or pd.isna(x) else int(x)

    out = []
    for text, many in zip(markdown, refs):
        given = [Ref(r["name"], whole(r["width"]), whole(r["height"]), whole(r["page"])) for r in ([] if many is None else many)]
        out.append([{"name": r.name, "position": r.position, "alt": r.alt, "context": r.context, "section_title": r.section_title} for r in place(text or "", given)])
    return pd.Series(out)


def unique_names(images: DataFrame, key: str = "doc_id", order: str = "image_index", name: str = "name") -> DataFrame:
    """images with a file name that is free in its document: query and folders cut, repeats numbered _1, _2, ...

    A document's images are few; they are numbered in order in one group.
    """
    schema = f"{key} long, {order} long, filename string"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for n in pdf.sort_values(order)[name]:
            base = (n or "").split("?")[0].rstrip("/").rsplit("/", 1)[-1] or "image"
            base = base if "." in base else base + ".png"
            stem, dot, suffix = base.rpartition(".")
            free, i = base, 0
            while free in used:
                i += 1
                free = f"{stem}_{i}{dot}{suffix}"
            used.add(free)
            out.append(free)
        return pd.DataFrame({key: pdf.sort_values(order)[key].to_numpy(), order: pdf.sort_values(order)[order].to_numpy(), "filename": out})

    return images.groupBy(key).applyInPandas(pick, schema)


#: Images of a wide band's value from which on it is split by the other bits.
CROWD = 1000


def met_images(images: DataFrame, most: int = 5, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b, pa, pb), a < b, of images that may differ in ``most`` bits: all that do, some of them more than once.

    Hashes are cut into so few bands that in one of them a near pair differs in
    one bit at most; an image looks up its bands' values and all that are
    a bit away. Values that more than ``crowd`` images have are split: what is left
    of the bits is cut into most + 1 bands, of which a near pair has one alike.
    """
    wide = max(2, most // 2 + 1)
    edges = lambda n, size: [(round(k * size / n), round((k + 1) * size / n)) for k in range(n)]
    cut = lambda c, a, z: F.conv(F.substring(c, a + 1, z - a), 2, 10).cast("long")
    bits = F.concat(F.lpad(F.conv(F.substring("phash", 1, 8), 16, 2), 32, "0"), F.lpad(F.conv(F.substring("phash", 9, 8), 16, 2), 32, "0"))

    def band(k: int, a: int, z: int) -> Column:
        other = F.concat(F.substring("bits", 1, a), F.substring("bits", z + 1, 64 - z))
        return F.struct(F.lit(k).alias("band"), F.lit(z - a).alias("width"), cut("bits", a, z).alias("value"), F.array(*[cut(other, x, y) for x, y in edges(most + 1, 64 - (z - a))]).alias("rest"))

    rows = images.where("phash IS NOT NULL").select("id", "phash", bits.alias("bits"))
    held = rows.select("id", "phash", F.explode(F.array(*[band(k, *e) for k, e in enumerate(edges(wide, 64))])).alias("x")).select("id", "phash", "x.*")
    one = F.lit(1).cast("long")
    near = F.concat(F.array("value"), F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.col("value").bitwiseXOR(F.call_function("shiftleft", one, i))))
    asked = held.withColumn("value", F.explode(near))
    crowds = held.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("band", "value", F.lit(True).alias("crowded"))

    def dealt(side: DataFrame) -> DataFrame:
        split = F.transform("rest", lambda v, k: F.struct(k.alias("part"), v.alias("other")))
        whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("other")))
        both = side.join(crowds, ["band", "value"], "left")
        return both.select("id", "phash", "band", "value", F.explode(F.when(F.col("crowded"), split).otherwise(whole)).alias("x")).select("id", "phash", "band", "value", "x.*")

    left, right = dealt(asked).withColumnsRenamed({"id": "a", "phash": "pa"}), dealt(held).withColumnsRenamed({"id": "b", "phash": "pb"})
    return left.join(right, ["band", "value", "part", "other"]).where("a < b").select("a", "b", "pa", "pb")


def near_images(images: DataFrame, most: int = 5, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b, bits) of image ids whose 64-bit hashes differ in at most ``most`` bits; null hashes are near nothing."""
    met = met_images(images, most, crowd)
    return met.withColumn("bits", media.hamming(F.col("pa"), F.col("pb"))).where(F.col("bits") <= most).select("a", "b", "bits").distinct()


def near_image_classes(images: DataFrame, most: int = 5) -> DataFrame:
    """near_images without its copies expanded: pairs (a, b, bits) that state every near pair once.

    Images with equal hashes are a class, which its smallest id represents. Rows
    are pairs of representatives, and with 0 bits each other member b beside its
    representative a. Two images are near if their representatives are one or a pair.
    """
    rows = images.where("phash IS NOT NULL").select("id", "phash")
    classes = rows.groupBy("phash").agg(F.min("id").alias("rep"))
    members = rows.join(classes, "phash").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("bits")).distinct()
    return near_images(classes.select(F.col("rep").alias("id"), "phash"), most).unionByName(members)
