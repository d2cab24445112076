"""Markdown files as blocks: cut at top-level constructs, text left as it is."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}#{1,6}(\s|$)")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)\s*$")
_ITEM = re.compile(r"^ {0,3}([-*+]|\d{1,9}[.)])(\s|$)")
_RULE = re.compile(r"^ {0,3}([-*_])(\s*\1){2,}\s*$")
_DELIMITER = re.compile(r"^\s*\|?(\s*:?-+:?\s*\|)+\s*:?-*:?\s*$")
_ANCHOR = re.compile(r"^<!-- block=")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _opener(line: str, following: str) -> str:
    """The kind of block that a line opens."""
    if _FENCE.match(line):
        return "fence"
    if _HEADING.match(line):
        return "heading"
    if _RULE.match(line):
        return "rule"
    if _ITEM.match(line):
        return "list"
    if "|" in line and _DELIMITER.match(following or ""):
        return "table"
    return "paragraph"


def blocks_of(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the top-level blocks; fenced code and rules are paragraphs. Lines that look like an anchor get a space in front."""
    lines = [(" " + x if _ANCHOR.match(x) else x) for x in text.split("\n")]
    out: list[tuple[str, list[str]]] = []
    i = 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        kind = _opener(lines[i], lines[i + 1] if i + 1 < len(lines) else "")
        j = i + 1
        if kind == "fence":
            mark = _FENCE.match(lines[i])[1]
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[j]):
                j += 1
            j += 1
        elif kind == "list":
            while j < len(lines):
                if lines[j].strip():
                    if not (_ITEM.match(lines[j]) or lines[j].startswith("  ") or lines[j - 1].strip()):
                        break
                    if _HEADING.match(lines[j]) or (_FENCE.match(lines[j]) and not lines[j].startswith("  ")):
                        break
                j += 1
        elif kind == "table":
            while j < len(lines) and lines[j].strip() and ("|" in lines[j]):
                j += 1
        elif kind == "paragraph":
            while j < len(lines) and lines[j].strip():
                if _SETEXT.match(lines[j]):
                    kind, j = "heading", j + 1
                    break
                if _opener(lines[j], lines[j + 1] if j + 1 < len(lines) else "") not in ("paragraph", "list"):
                    break
                j += 1
        part = lines[i:j]
        while part and not part[-1].strip():
            part.pop()
        out.append(({"fence": "paragraph", "rule": "paragraph"}.get(kind, kind), "\n".join(part)))
        i = j
    return out


def convert(raw: bytes) -> dict:
    """title and date that the file declares, how many images it has, its blocks. Front matter becomes a fenced block; bytes that are no UTF-8 are an error."""
    try:
        text = raw.decode("utf-8-sig").replace("\r\n", "\n")
    except UnicodeDecodeError as e:
        return {"title": None, "doc_date": None, "images": 0, "blocks": [], "error": f"not UTF-8: byte {e.start}"}
    front = re.match(r"\A---\n(.*?)\n---\n", text, re.S)
    body = text[front.end() :] if front else text
    fields = dict(re.findall(r"(?m)^([A-Za-z_]+):[ \t]*[\"']?(.*?)[\"']?[ \t]*$", front[1])) if front else {}
    made = blocks_of(body)
    title = fields.get("title") or next((re.sub(r"^#+\s*", "", t.split("\n")[0]).strip() for k, t in made if k == "heading"), None)
    date = fields.get("date") or fields.get("doc_date")
    head = [("paragraph", f"```yaml\n{front[1]}\n```")] if front else []
    return {"title": title or None, "doc_date": date if date and _DATE.match(date) else None, "images": len(_IMAGE.findall(body)), "blocks": head + made, "error": None}


def converted(files: DataFrame) -> DataFrame:
    """source_file, title, doc_date, images, error, blocks of Markdown files (source_file, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [convert(bytes(c)) for c in pdf.content]
            for r in rows:
                r["blocks"] = [{"kind": k, "text": t} for k, t in r["blocks"]]
            yield pd.DataFrame(rows).assign(source_file=pdf.source_file.values)[["source_file", "title", "doc_date", "images", "error", "blocks"]]

    return files.select("source_file", "content").mapInPandas(run, "source_file string, title string, doc_date string, images int, error string, blocks array<struct<kind:string,text:string>>")
