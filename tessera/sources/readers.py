"""Readers and sinks: uploads, text and sheets, office packages, layout gateways, digests.

Files come as (path, content) rows, as Spark's binaryFile source gives them,
so any store that Spark reads will do. Decoding runs in Arrow batches, one
document at a time; rendering rules are Column expressions.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import pipe_table, strip

MAX_ROWS, MAX_COLUMNS, MAX_PAGE_CHARS = 500, 50, 100_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(filename, content, length) of files in any Hadoop file system."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content", "length")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def csv_tables(files: DataFrame) -> DataFrame:
    """(filename, markdown) of CSV contents: RFC 4180 cells as a pipe table."""
    import csv

    @F.pandas_udf("string")
    def table(content: pd.Series) -> pd.Series:
        return pd.Series([table_markdown([r for r in csv.reader(io.StringIO(bytes(c).decode("utf-8-sig", "replace"))) if r]) for c in content])

    return files.select("filename", table("content").alias("markdown"))


def sheet_markdown(rows: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """(doc_id, sheet, row, cells) -> (doc_id, sheet, markdown).

    Blank rows before the first and behind the last filled one go, those between
    stay; rows and columns past the limits are cut and a notice says so. Rows are
    numbered before any are gathered, so a sheet of any length gathers max_rows.
    """
    sheet = Window.partitionBy("doc_id", "sheet")
    filled = F.when(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), F.col("row"))
    inner = rows.select("doc_id", "sheet", "row", "cells", F.min(filled).over(sheet).alias("a"), F.max(filled).over(sheet).alias("z")).where("row BETWEEN a AND z")
    placed = inner.select("doc_id", "sheet", F.row_number().over(sheet.orderBy("row", "cells")).alias("k"), F.count("*").over(sheet).alias("n"), F.slice("cells", 1, max_columns).alias("c"))
    out = placed.where(F.col("k") <= max_rows).groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("t"), F.max("n").alias("n"))
    notice = F.when(F.col("n") > max_rows, F.concat(F.lit("\n\n_"), F.lit(max_rows), F.lit(" of "), F.col("n").cast("string"), F.lit(" rows shown_"))).otherwise(F.lit(""))
    return out.select("doc_id", "sheet", F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n\n"), pipe_table(F.transform("t", lambda x: x["c"])), notice).alias("markdown"))


def page_markdown(pages: DataFrame, limit: int = MAX_PAGE_CHARS) -> DataFrame:
    """(doc_id, page, text) -> (doc_id, content, page_count): a section for each page, each up to a limit."""
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n\n_page cut_"))).otherwise(text)
    section = F.struct("page", F.concat(F.lit("## Page "), "page", F.lit("\n\n"), cut).alias("s"))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(section)).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["s"]), "\n\n").alias("content"), F.size("p").alias("page_count"))


def ocr_markdown(stem: Column, lines: Column) -> Column:
    """Recognised lines that are not blank under the file's name."""
    return F.concat(F.lit("# "), stem, F.lit("\n\n"), F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n"))


def vision_markdown(stem: Column, markdown: Column) -> Column:
    """What a vision model said of an image, under the file's name; null if it said nothing, which sends the file to the next engine."""
    title = F.coalesce(F.nullif(stem, F.lit("")), F.lit("image"))
    return F.when(strip(F.coalesce(markdown, F.lit(""))) != "", F.concat(F.lit("# "), title, F.lit("\n\n"), strip(markdown), F.lit("\n")))


_GATEWAY = "errorCode int, errorMsg string, result struct<layoutParsingResults: array<struct<markdown: struct<text: string, images: map<string,string>>>>>"


def layout_gateway(responses: DataFrame) -> DataFrame:
    """(doc_id, body) JSON of a layout service -> (doc_id, content, page_count, images (page from 1, name)); errors give a message."""
    r = responses.select("doc_id", F.from_json("body", _GATEWAY).alias("b"))
    pages = F.coalesce(F.col("b.result.layoutParsingResults"), F.array())
    html_image = r"""<img[^>]*?src=["'](?:[^"']*/)?([^"'/]+)["'][^>]*>"""
    text = F.array_join(F.transform(pages, lambda p: F.regexp_replace(F.coalesce(p["markdown"]["text"], F.lit("")), html_image, r"![]($1)")), "\n\n")
    names = F.flatten(F.transform(pages, lambda p, i: F.transform(F.map_keys(F.coalesce(p["markdown"]["images"], F.create_map().cast("map<string,string>"))), lambda k: F.struct((i + 1).alias("page"), F.element_at(F.split(k, "/"), -1).alias("name")))))
    bad = F.coalesce(F.col("b.errorCode") != 0, F.lit(True))
    return r.select("doc_id", F.when(~bad, text).alias("content"), F.when(~bad, F.size(pages)).alias("page_count"), F.when(~bad, names).alias("images"), F.when(bad, F.coalesce("b.errorMsg", F.lit("malformed response"))).alias("error"))


def content_list_pages(lists: DataFrame) -> DataFrame:
    """(doc_id, content_list) JSON text -> (doc_id, pages): image base name to page from 1; the last duplicate wins."""
    items = F.from_json("content_list", "array<struct<img_path: string, page_idx: int>>")
    entry = F.transform(F.filter(items, lambda x: F.coalesce(x["img_path"], F.lit("")) != ""), lambda x: F.struct(F.element_at(F.split(x["img_path"], "/"), -1).alias("k"), (x["page_idx"] + 1).alias("v")))
    last = F.aggregate(entry, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))
    return lists.select("doc_id", last.alias("pages"))


def post_record(records: DataFrame) -> DataFrame:
    """(doc_id, body) JSON of a social post -> (doc_id, markdown): header, text or article, images once each."""
    schema = "author struct<name: string, screen_name: string>, text string, article struct<title: string, body: string>, images array<string>"
    r = records.select("doc_id", F.from_json("body", schema).alias("b"))
    head = F.when(F.col("b.author.name").isNotNull(), F.concat(F.lit("# "), "b.author.name", F.coalesce(F.concat(F.lit(" (@"), "b.author.screen_name", F.lit(")")), F.lit(""))))
    article = F.when(F.col("b.article").isNotNull(), F.concat_ws("\n\n", F.concat(F.lit("## "), "b.article.title"), "b.article.body"))
    images = F.array_join(F.transform(F.array_distinct(F.coalesce("b.images", F.array().cast("array<string>"))), lambda u: F.concat(F.lit("![]("), u, F.lit(")"))), "\n\n")
    return r.select("doc_id", F.concat_ws("\n\n", head, F.nullif("b.text", F.lit("")), article, F.nullif(images, F.lit(""))).alias("markdown"))


# Office packages, with the standard library only.


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _joined(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _related(z: zipfile.ZipFile) -> dict[str, str]:
    """Targets of a word-processing package's relations by id."""
    rels = _xml(z, "word/_rels/document.xml.rels")
    return {r.get("Id"): r.get("Target", "") for r in rels} if rels is not None else {}


def _numbered(z: zipfile.ZipFile) -> set[tuple[str, str]]:
    """(list id, level) of lists that count; the others have bullets."""
    root = _xml(z, "word/numbering.xml")
    if root is None:
        return set()
    counting = {(a.get(f"{_W}abstractNumId"), v.get(f"{_W}ilvl")) for a in root.iter(f"{_W}abstractNum") for v in a.iter(f"{_W}lvl") if (f := v.find(f"{_W}numFmt")) is not None and f.get(f"{_W}val") not in ("bullet", "none")}
    uses = [(n.get(f"{_W}numId"), n.find(f"{_W}abstractNumId").get(f"{_W}val")) for n in root.iter(f"{_W}num") if n.find(f"{_W}abstractNumId") is not None]
    return {(used, level) for used, kind in uses for k, level in counting if k == kind}


def _is_on(run: ET.Element, name: str) -> bool:
    node = run.find(f"{_W}rPr/{_W}{name}")
    return node is not None and node.get(f"{_W}val", "1") not in ("0", "false", "none")


def _extension(target: str) -> str:
    name = target.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else "png"


def _spans(node: ET.Element, targets: dict[str, str], images: list[str], plain: bool = False) -> str:
    """A paragraph's text: bold and italic runs, links, a placeholder for each image."""
    out = ""
    for child in node:
        if child.tag == f"{_W}hyperlink":
            said, target = _spans(child, targets, images, plain), targets.get(child.get(f"{_R}id", ""), "")
            out += f"[{said}]({target})" if said and target else said
        elif child.tag == f"{_W}r":
            said = "".join(t.text or "" for t in child.iter(f"{_W}t"))
            if said.strip() and not plain:
                marks = "**" * _is_on(child, "b") + "*" * _is_on(child, "i")
                core = said.strip()
                said = said.replace(core, f"{marks}{core}{marks[::-1]}", 1)
            for blip in child.iter(f"{_A}blip"):
                images.append(targets.get(blip.get(f"{_R}embed", ""), ""))
                said += f"![](image_{len(images):04d}.{_extension(images[-1])})"
            out += said
        elif child.tag != f"{_W}pPr":
            out += _spans(child, targets, images, plain)
    return out


def docx_markdown(content: bytes, stem: str = "") -> tuple[str, str, int]:
    """(markdown, title, images) of a word-processing package: headings, paragraphs, lists, tables, placeholders for images.

    The title is the first heading of level 1, else the file's name.
    """
    out, images, title, in_list = [], [], "", False
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body, targets, numbered = _xml(z, "word/document.xml").find(f"{_W}body"), _related(z), _numbered(z)
    for node in body:
        if node.tag == f"{_W}tbl":
            rows = [[_joined(c, f"{_W}t") for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            out.append(table_markdown(rows))
            in_list = False
        elif node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.match(r"(?i)heading\s*([1-6])$", style.get(f"{_W}val", "") if style is not None else "")
            text = _spans(node, targets, images, plain=level is not None)
            if not text.strip():
                continue
            item = node.find(f"{_W}pPr/{_W}numPr") if level is None else None
            if item is not None:
                at = {n: x.get(f"{_W}val", "0") for n in ("ilvl", "numId") if (x := item.find(f"{_W}{n}")) is not None}
                depth = at.get("ilvl", "0")
                line = "    " * int(depth) + ("1. " if (at.get("numId"), depth) in numbered else "- ") + text.strip()
                out[-1:] = [f"{out[-1]}\n{line}"] if in_list else [*out[-1:], line]
            else:
                out.append("#" * int(level[1]) + " " + text if level else text)
                if level and level[1] == "1" and not title:
                    title = text.strip()
            in_list = item is not None
    return "\n\n".join(out), title or stem, len(images)


def docx_images(content: bytes) -> list[tuple[str, bytes | None]]:
    """(name, bytes) of a word-processing package's images in the order and by the names of their placeholders; None if they are not in it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets, held = _related(z), set(z.namelist())
        used = [targets.get(b.get(f"{_R}embed", ""), "") for b in _xml(z, "word/document.xml").iter(f"{_A}blip")]
        part = lambda t: t.lstrip("/") if t.startswith("/") else f"word/{t}"
        return [(f"image_{k:04d}.{_extension(t)}", z.read(part(t)) if part(t) in held else None) for k, t in enumerate(used, 1)]


def docx_repair(content: bytes) -> bytes:
    """The package without image relations that dangle or whose bytes are damaged; as it is if nothing can be done."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names, parts, bad = set(z.namelist()), {}, set()
            for n in z.namelist():
                try:
                    parts[n] = z.read(n)
                except zipfile.BadZipFile:
                    bad.add(n)
        rels_name = "word/_rels/document.xml.rels"
        if rels_name not in parts or "word/document.xml" not in parts:
            return content
        rels = ET.fromstring(parts[rels_name])
        gone = [r for r in rels if r.get("Type", "").endswith("/image") and r.get("TargetMode") != "External" and ("word/" + r.get("Target", "") not in names or "word/" + r.get("Target", "") in bad)]
        if not gone:
            return content
        ids = {r.get("Id") for r in gone}
        for r in gone:
            rels.remove(r)
        doc = ET.fromstring(parts["word/document.xml"])
        for parent in list(doc.iter()):
            for child in list(parent):
                if child.tag == f"{_A}blip" and child.get(f"{_R}embed") in ids:
                    parent.remove(child)
        parts[rels_name], parts["word/document.xml"] = ET.tostring(rels), ET.tostring(doc)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, b in parts.items():
                z.writestr(n, b)
        return out.getvalue()
    except Exception:  # a package that can't be mended goes to the parser as it came
        return content


_SLIDE = re.compile(r"^ppt/slides/slide(\d+)\.xml$")


def slide_count(content: bytes) -> int | None:
    """Slides of a presentation package; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return sum(bool(_SLIDE.match(n)) for n in z.namelist())
    except zipfile.BadZipFile:
        return None


def pptx_markdown(content: bytes, stem: str = "") -> tuple[str, int]:
    """(markdown, slides): the first line of a slide is its title, then text, tables and notes."""
    out = [f"# {stem}"]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := _SLIDE.match(n)))
        for k, (number, name) in enumerate(slides, 1):
            slide = _xml(z, name)
            tables = [[[_joined(c, f"{_A}t") for c in r.iter(f"{_A}tc")] for r in t.iter(f"{_A}tr")] for t in slide.iter(f"{_A}tbl")]
            in_tables = {id(p) for t in slide.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
            lines = [t for p in slide.iter(f"{_A}p") if id(p) not in in_tables and (t := _joined(p, f"{_A}t").strip())]
            out.append(f"## Slide {k}: {lines[0]}" if lines else f"## Slide {k}")
            out += ["\n".join(lines[1:])] if lines[1:] else []
            out += [table_markdown(t) for t in tables]
            notes = _xml(z, f"ppt/notesSlides/notesSlide{number}.xml")
            said = [t for p in notes.iter(f"{_A}p") if (t := _joined(p, f"{_A}t").strip())] if notes is not None else []
            out += ["### Notes\n\n" + "\n".join(said)] if said else []
    return "\n\n".join(out), len(slides)


def xlsx_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook, shared and inline strings resolved."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _xml(z, "xl/sharedStrings.xml")
        strings = [_joined(s, f"{_S}t") for s in shared.iter(f"{_S}si")] if shared is not None else []
        rels = {r.get("Id"): r.get("Target", "") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in _xml(z, "xl/workbook.xml").iter(f"{_S}sheet"):
            target = rels[sheet.get(f"{_R}id")].lstrip("/")
            root = _xml(z, target if target.startswith("xl/") else f"xl/{target}")
            for n, row in enumerate(root.iter(f"{_S}row"), 1):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    letters = re.match("[A-Z]+", c.get("r", ""))
                    at = 0
                    for x in letters[0] if letters else "":
                        at = at * 26 + ord(x) - 64
                    cells += [""] * (max(at, len(cells) + 1) - 1 - len(cells))
                    value = c.find(f"{_S}v")
                    text = _joined(c, f"{_S}t") if c.get("t") == "inlineStr" else value.text or "" if value is not None else ""
                    cells.append(strings[int(text)] if c.get("t") == "s" and text else text)
                out.append((sheet.get("name"), int(row.get("r", n)), cells))
    return out


def table_markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    clean = [[c.replace("|", "\\|").replace("\r\n", " ").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines else ""


def workbook_rows(files: DataFrame) -> DataFrame:
    """(doc_id, content) -> (doc_id, sheet, row, cells); sheet_markdown renders them."""

    def work(frames):
        for pdf in frames:
            rows = [(i, s, r, c) for i, b in zip(pdf.doc_id, pdf.content) for s, r, c in xlsx_rows(bytes(b))]
            yield pd.DataFrame(rows, columns=["doc_id", "sheet", "row", "cells"])

    return files.select("doc_id", "content").mapInPandas(work, "doc_id long, sheet string, row int, cells array<string>")


def packages(files: DataFrame) -> DataFrame:
    """(doc_id, filename, content) -> (doc_id, markdown, title, pages, error) of word-processing and presentation files."""

    def work(frames):
        for pdf in frames:
            out = []
            for i, name, content in zip(pdf.doc_id, pdf.filename, pdf.content):
                stem = name.rsplit(".", 1)[0]
                try:
                    if name.lower().endswith((".ppt", ".pptx")):
                        text, pages = pptx_markdown(bytes(content), stem)
                        out.append((i, text, stem, pages, None))
                    else:
                        text, title, _ = docx_markdown(docx_repair(bytes(content)), stem)
                        out.append((i, text, title, None, None))
                except Exception as e:  # one broken file is that file's outcome, not the job's
                    out.append((i, None, stem, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "markdown", "title", "pages", "error"]).astype({"pages": "Int32"})

    return files.select("doc_id", "filename", "content").mapInPandas(work, "doc_id long, markdown string, title string, pages int, error string")


def passing(error: Exception) -> bool:
    """Whether a call may be tried again: 429, server errors, and transport errors without a status."""
    status = next((s for s in (getattr(error, a, None) for a in ("status_code", "status", "code")) if isinstance(s, int)), None)
    return isinstance(error, OSError) if status is None else status == 429 or status >= 500


def external(df: DataFrame, call: Callable[[list[str]], list], column: str, out: str, batch: int = 4, tries: int = 3, kind: str = "array<float>", pause: float = 1.0) -> DataFrame:
    """A column from an injected client, called with small batches in order; a batch that fails in passing is tried again.

    Pauses double up to 10 s, each with up to half of it more, so that executors
    do not return together. The boundary to models and services: the client is
    built on the executor.
    """
    import time
    from random import uniform

    @F.pandas_udf(kind)
    def ask(texts: pd.Series) -> pd.Series:
        got = []
        for lo in range(0, len(texts), batch):
            part = [t or "" for t in texts[lo : lo + batch]]
            for n in range(tries):
                try:
                    got += call(part)
                    break
                except Exception as e:
                    if n + 1 == tries or not passing(e):
                        raise
                    wait = min(pause * 2**n, 10)
                    time.sleep(wait + uniform(0, wait / 2))
        return pd.Series(got)

    return df.withColumn(out, ask(column))


def report_json(metrics: DataFrame, path: str) -> None:
    """A result table as JSON lines in any file system that Spark writes."""
    metrics.write.mode("overwrite").json(path)
