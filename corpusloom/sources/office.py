"""Office files: DOCX, PPTX and ODP read from their XML parts, and items of any decoder turned into blocks.

Formats that need a program of their own (DOC, PPT, PDF) come through ``decoded``: a function from bytes to items, run on the executors.
Items are rows doc, seq, page, type (heading, list, ordered, paragraph, table, chart, smartart, notes, hidden), level, text, cells.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

ITEMS = "doc string, seq int, page int, type string, level int, text string, cells array<array<string>>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_D = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TEXT, _TABLE, _DRAW, _PRESENTATION = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("text", "table", "drawing", "presentation"))


def _words(node, space: str) -> str:
    return "".join(t.text or "" for t in node.iter(f"{space}t"))


def docx_items(raw: bytes) -> list[tuple]:
    """(page, type, level, text, cells) down the body of a DOCX; pictures are counted in a last item of type pictures."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        pictures = sum(1 for n in z.namelist() if n.startswith("word/media/"))
    out: list[tuple] = []
    for node in body:
        if node.tag == f"{_W}tbl":
            out.append((None, "table", 0, None, [[_words(c, _W).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]))
        elif node.tag == f"{_W}p" and (text := _words(node, _W).strip()):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val") if style is not None else ""
            depth = node.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
            if m := re.match(r"(?i)heading\s*(\d)", name or ""):
                out.append((None, "heading", int(m[1]), text, None))
            elif depth is not None or re.match("(?i)list", name or ""):
                out.append((None, "ordered" if "umber" in (name or "") else "list", int(depth.get(f"{_W}val")) if depth is not None else 0, text, None))
            else:
                out.append((None, "paragraph", 0, text, None))
    return out + ([(None, "pictures", pictures, None, None)] if pictures else [])


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The parts that a part's relationships name, by their ids; those that the file does not hold are left out."""
    folder, name = posixpath.split(part)
    listed = f"{folder}/_rels/{name}.rels"
    if listed not in z.namelist():
        return {}
    found = {}
    for r in ElementTree.fromstring(z.read(listed)):
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        if r.get("TargetMode") != "External" and path in z.namelist():
            found[r.get("Id")] = path
    return found


def _slides(z: zipfile.ZipFile) -> list[str]:
    """The slides' parts in the order of the presentation; by their numbers where it does not say."""
    if "ppt/presentation.xml" in z.namelist():
        known = _targets(z, "ppt/presentation.xml")
        listed = ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")
        if order := [known[s.get(f"{_R}id")] for s in listed if s.get(f"{_R}id") in known]:
            return order
    numbers = sorted(int(m[1]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return [f"ppt/slides/slide{n}.xml" for n in numbers]


def _chart_cells(chart) -> list[list[str]]:
    """A chart's cached numbers as a table: a row for each category, a column for each series."""
    points = lambda node: {int(p.get("idx")): (p.findtext(f"{_C}v") or "").strip() for p in node.iter(f"{_C}pt")} if node is not None else {}
    series = [(points(s.find(f"{_C}tx")).get(0, ""), points(s.find(f"{_C}cat")), points(s.find(f"{_C}val"))) for s in chart.iter(f"{_C}ser")]
    if not series:
        return []
    places = sorted({k for _, _, values in series for k in values})
    labels = {k: v for _, names, _ in reversed(series) for k, v in names.items()}
    return [["", *(name for name, _, _ in series)], *([labels.get(k, str(k + 1)), *(values.get(k, "") for _, _, values in series)] for k in places)]


def pptx_items(raw: bytes) -> list[tuple]:
    """(page, type, level, text, cells) of the slides of a PPTX, in the presentation's order; hidden slides are marked; charts are tables, SmartArt
    a list after the slide's text, and notes come last."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for page, part in enumerate(_slides(z), start=1):
            slide, known = ElementTree.fromstring(z.read(part)), _targets(z, part)
            if slide.get("show") == "0":
                out.append((page, "hidden", 0, "(hidden slide)", None))
            for shape in slide.iter(f"{_P}sp"):
                place = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                is_title = place is not None and place.get("type") in ("title", "ctrTitle")
                for p in shape.iter(f"{_A}p"):
                    if not (text := _words(p, _A).strip()):
                        continue
                    props = p.find(f"{_A}pPr")
                    level = int(props.get("lvl", 0)) if props is not None else 0
                    ordered = props is not None and props.find(f"{_A}buAutoNum") is not None
                    bullet = place is not None and place.get("type") in (None, "body", "obj") or (props is not None and props.find(f"{_A}buChar") is not None)
                    out.append((page, "heading" if is_title else "ordered" if ordered else "list" if bullet else "paragraph", 2 if is_title else level, text, None))
            for table in slide.iter(f"{_A}tbl"):
                out.append((page, "table", 0, None, [[_words(c, _A).strip() for c in r.iter(f"{_A}tc")] for r in table.iter(f"{_A}tr")]))
            for frame in slide.iter(f"{_C}chart"):
                if (at := known.get(frame.get(f"{_R}id"))) and (cells := _chart_cells(ElementTree.fromstring(z.read(at)))):
                    out.append((page, "chart", 0, None, cells))
            for diagram in slide.iter(f"{_D}relIds"):
                if at := known.get(diagram.get(f"{_R}dm")):
                    texts = (_words(p, _A).strip() for p in ElementTree.fromstring(z.read(at)).iter(f"{_D}pt"))
                    out += [(page, "smartart", 0, t, None) for t in texts if t]
            for at in known.values():
                if "/notesSlides/" in at and (text := _words(ElementTree.fromstring(z.read(at)), _A).strip()):
                    out.append((page, "notes", 0, text, None))
    return out


def odp_items(raw: bytes) -> list[tuple]:
    """The same of an ODP: frames of class title are headings, lists keep their depth, tables their cells."""
    out: list[tuple] = []
    plain = lambda node: "".join(node.itertext()).strip()

    def walk(node, page: int, title: bool, depth: int, ordered: bool) -> None:
        for child in node:
            if child.tag == f"{_TEXT}list":
                walk(child, page, title, depth + 1, ordered)
            elif child.tag in (f"{_TEXT}p", f"{_TEXT}h"):
                if text := plain(child):
                    out.append((page, "heading" if title else "list" if depth >= 0 else "paragraph", 2 if title else max(depth, 0), text, None))
            elif child.tag == f"{_TABLE}table":
                out.append((page, "table", 0, None, [[plain(c) for c in r.iter(f"{_TABLE}table-cell")] for r in child.iter(f"{_TABLE}table-row")]))
            elif child.tag == f"{_PRESENTATION}notes":
                if text := plain(child):
                    out.append((page, "notes", 0, text, None))
            else:
                walk(child, page, title or child.get(f"{_PRESENTATION}class") == "title", depth, ordered)

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for page, slide in enumerate(ElementTree.fromstring(z.read("content.xml")).iter(f"{_DRAW}page"), start=1):
            walk(slide, page, False, -1, False)
    return out


DECODERS: dict[str, Callable[[bytes], list[tuple]]] = {"docx": docx_items, "pptx": pptx_items, "odp": odp_items}


def decoded(files: DataFrame, decoders: dict[str, Callable[[bytes], list[tuple]]] | None = None) -> DataFrame:
    """Items of files (doc, source_format, content); a file that its decoder cannot read, or without one, is a row with an error."""
    own = DECODERS | (decoders or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, kind, content in zip(pdf.doc, pdf.source_format, pdf.content, strict=True):
                try:
                    if kind not in own:
                        raise ValueError(f"no decoder for {kind}")
                    rows += [(doc, k, *item, None) for k, item in enumerate(own[kind](bytes(content)))]
                except Exception as e:  # a damaged file is a row, not the end of the run
                    rows.append((doc, 0, None, "error", 0, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(rows, columns=["doc", "seq", "page", "type", "level", "text", "cells", "error"])
            yield frame.astype({"page": "Int32"})

    return files.select("doc", "source_format", "content").mapInPandas(run, ITEMS)


def item_blocks(items: DataFrame) -> DataFrame:
    """slug, ordinal, page, kind, text of decoder items: runs of list items (and of their depth's numbers) are one list; charts and tables are pipe tables."""
    rows = items.where("error IS NULL AND type <> 'pictures'").withColumn("page", F.col("page"))
    listed = F.col("type").isin("list", "ordered", "smartart")
    by = Window.partitionBy("doc").orderBy("seq")
    joins = listed & F.coalesce(F.lag(listed).over(by) & F.lag("page").over(by).eqNullSafe(F.col("page")) & (F.lag(F.col("type") == "smartart").over(by) == (F.col("type") == "smartart")), F.lit(False))
    rows = rows.withColumn("run", F.sum((~joins).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    line = Window.partitionBy("doc", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum((F.col("type") == "ordered").cast("int")).over(line)
    mark = F.when(F.col("type") == "ordered", F.concat(number.cast("string"), F.lit(". "))).otherwise("- ")
    clean = T.collapsed(F.coalesce("text", F.lit("")))
    text = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest("level", F.lit(1)), F.lit(6))), F.lit(" "), clean))
        .when(listed, F.concat(F.repeat(F.lit("  "), F.greatest("level", F.lit(0))), mark, clean))
        .when(F.col("type").isin("table", "chart"), T.rendered_table(_padded("cells")))
        .when(F.col("type") == "notes", F.concat(F.lit("Notes: "), clean))
        .otherwise(clean)
    )
    kind = F.when(F.col("type") == "heading", "heading").when(listed | (F.col("type") == "smartart"), "list").when(F.col("type").isin("table", "chart"), "table").otherwise("paragraph")
    late = F.when(F.col("type") == "notes", 2).when(F.col("type") == "smartart", 1).otherwise(0)
    rows = rows.withColumns({"line": text, "kind": kind, "late": late})
    runs = rows.groupBy("doc", "run").agg(F.min("seq").alias("seq"), F.first("page").alias("page"), F.first("kind").alias("kind"), F.max("late").alias("late"), F.array_join(F.sort_array(F.collect_list(F.struct("seq", "line")))["line"], "\n").alias("text"))
    order = Window.partitionBy("doc").orderBy(F.asc_nulls_first("page"), "late", "seq")
    return runs.where(T.stripped(F.col("text")) != "").select(F.col("doc").alias("slug"), (F.row_number().over(order) - 1).alias("ordinal"), "page", "kind", "text")


def _padded(cells: str):
    """Rows filled up to the widest one."""
    width = F.aggregate(cells, F.lit(0), lambda m, r: F.greatest(m, F.size(r)))
    return F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
