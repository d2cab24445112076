"""Lookups by id over the kb tables: documents, sections, pages, chunks, outlines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Characters above which a reply is a breakdown instead of the text, and lines a breakdown samples. Fixed values.
MOST_CHARS, SIGNPOSTS = 200_000, 12

_KEY = re.compile(rf"^(?:(doc):({T.SLUG})|(sec|chunk):({T.SLUG}):(\d+)|(page):({T.SLUG}):p(\d{{3,}}))$")


def parse_key(key: str) -> tuple[str, str, int | None]:
    """(kind, slug, number) of an id; ValueError for anything else."""
    m = _KEY.match(key)
    if not m:
        raise ValueError(f"unknown id: {key}")
    kind, slug, n = m[1] or m[3] or m[6], m[2] or m[4] or m[7], m[5] or m[8]
    return kind, slug, int(n) if n else None


def joined_text(order: str = "ordinal", text: str = "text", between: str = "\n\n") -> Column:
    """Texts of a group in order, a blank line between them; empty for none."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), between)


def list_documents(kb: dict[str, DataFrame], text_class: str | None = None, title_contains: str | None = None) -> DataFrame:
    """Every document, or those of a class or whose title holds a string in any case (% and _ in it are wildcards), by title."""
    docs = kb["documents"]
    if text_class is not None:
        docs = docs.where(F.col("text_class") == text_class)
    if title_contains is not None:
        docs = docs.where(F.col("title").ilike(f"%{title_contains}%"))
    counts = kb["sections"].groupBy("slug").agg(F.count(F.lit(1)).alias("sections"))
    rows = docs.join(counts, "slug", "left").withColumn("sections", F.coalesce("sections", F.lit(0)).cast("long"))
    return rows.select(T.doc_key(F.col("slug")).alias("id"), "title", "doc_date", "text_class", "page_count", "sections", "chars").orderBy("title", "id")


def section_chars(kb: dict[str, DataFrame]) -> DataFrame:
    """slug, section_index, chars: the length of each section's joined text. A section names its blocks, which are met by slug and number."""
    s = kb["sections"].select("slug", "section_index", F.explode_outer(F.sequence("block_first", "block_last")).alias("ordinal"))
    b = kb["blocks"].select("slug", "ordinal", F.length("text").alias("n"))
    sums = s.join(b, ["slug", "ordinal"], "left").groupBy("slug", "section_index").agg(F.sum(F.col("n") + 2).alias("n"))
    return sums.select("slug", "section_index", F.greatest(F.coalesce(F.col("n") - 2, F.lit(0)), F.lit(0)).cast("long").alias("chars"))


def outline(kb: dict[str, DataFrame], slug: str | None = None) -> DataFrame:
    """id, slug, section_index, level, heading, page_first, page_last, chars, of one document or all, in order."""
    one = {k: kb[k].where(F.col("slug") == slug) if slug else kb[k] for k in ("sections", "blocks")}
    rows = one["sections"].join(section_chars(one), ["slug", "section_index"])
    return rows.select(T.section_key(F.col("slug"), F.col("section_index")).alias("id"), "slug", "section_index", "level", "heading", "page_first", "page_last", "chars").orderBy("slug", "section_index")


def bounded_outline(entries: DataFrame, budget: int) -> DataFrame:
    """Of an outline (slug, section_index, level, line), what fits ``budget`` characters: deeper levels go first, then entries from the end; one stays."""
    per = Window.partitionBy("slug")
    fits = [(k, F.sum(F.when(F.col("level") <= k, F.length("line") + 1).otherwise(0)).over(per) <= budget) for k in (6, 5, 4, 3, 2, 1)]
    # A level that would leave nothing is passed over; the shallowest one that has entries is the last resort.
    shallowest = F.min("level").over(per)
    level = F.coalesce(*(F.when(ok & (F.lit(k) >= shallowest), F.lit(k)) for k, ok in fits), F.greatest(shallowest, F.lit(1)))
    rows = entries.withColumn("most", level).where("level <= most")
    used = F.sum(F.length("line") + 1).over(per.orderBy("section_index").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(per.orderBy("section_index"))
    return rows.withColumn("used", used).withColumn("nth", first).where((F.col("used") <= budget) | (F.col("nth") == 1)).drop("used", "nth", "most")


def block_range(blocks: DataFrame, lo: int, hi: int) -> DataFrame:
    """Blocks numbered ``lo`` to ``hi``."""
    return blocks.where(F.col("ordinal").between(lo, hi))


def overlapping(chunks: DataFrame, lo: int, hi: int) -> DataFrame:
    """Chunks that cover any of the blocks ``lo`` to ``hi``."""
    return chunks.where((F.col("block_last") >= lo) & (F.col("block_first") <= hi))


def page_sections(sections: DataFrame, page: int) -> DataFrame:
    """slug, section_index: of each document the section that holds ``page`` (the first of several), else the one whose first page is nearest (the first)."""
    inside = (F.col("page_first") <= page) & (F.col("page_last") >= page)
    key = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, 0).otherwise(F.abs(F.col("page_first") - page)), "section_index")
    return sections.where("page_first IS NOT NULL").groupBy("slug").agg(F.min_by("section_index", key).alias("section_index"))


def neighbour_ranges(sections: DataFrame, neighbours: int) -> DataFrame:
    """slug, section_index, lo, hi: the sections that come with each one."""
    last = F.max("section_index").over(Window.partitionBy("slug"))
    at = F.col("section_index")
    return sections.select("slug", "section_index", F.greatest(F.lit(0), at - neighbours).alias("lo"), F.least(last, at + neighbours).alias("hi"))


def end_blocks() -> list[Column]:
    """first_block, last_block: the ids of a group's first and last block."""
    return [F.min_by("block_id", "ordinal").alias("first_block"), F.max_by("block_id", "ordinal").alias("last_block")]


def resolve_page(sections: DataFrame, slug: str, page: int) -> int | None:
    best = page_sections(sections.where(F.col("slug") == slug), page).select("section_index").head(1)
    return best[0][0] if best else None


def fetch(kb: dict[str, DataFrame], key: str, neighbours: int = 0, most_chars: int = MOST_CHARS, url_base: str | None = None) -> DataFrame:
    """One row for an id: id, kind, slug, title, text, page_first, page_last, first_block, last_block, citation, url, chars, truncated.

    A document over ``most_chars`` (by its stored length, anchors included) lists its outline; any other unit over it names the chunks that cover
    it. Unknown ids are ValueErrors.
    """
    kind, slug, n = parse_key(key)
    doc = kb["documents"].where(F.col("slug") == slug).head(1)
    if not doc:
        raise ValueError(f"unknown id: {key}")
    doc = doc[0]
    lo, hi, path, title, own = 0, 2**31 - 1, doc["title"], doc["title"], None
    if kind == "sec":
        mine = kb["sections"].where(F.col("slug") == slug)
        reach = neighbour_ranges(mine, neighbours).where(F.col("section_index") == n).head(1)
        if not reach:
            raise ValueError(f"unknown id: {key}")
        rows = mine.where(F.col("section_index").between(reach[0]["lo"], reach[0]["hi"]))
        span = rows.agg(F.min("block_first"), F.max("block_last"), F.max(F.when(F.col("section_index") == n, F.col("heading_path")))).first()
        lo, hi, path = span
        title = path
    elif kind == "chunk":
        found = kb["chunks"].where((F.col("slug") == slug) & (F.col("chunk_index") == n)).join(kb["sections"].select("slug", "section_index", "heading_path"), ["slug", "section_index"], "left").head(1)
        if not found:
            raise ValueError(f"unknown id: {key}")
        lo, hi, path, own = found[0]["block_first"], found[0]["block_last"], found[0]["heading_path"] or doc["title"], found[0]["text"]
        title = path
    blocks = block_range(kb["blocks"].where(F.col("slug") == slug), lo, hi)
    if kind == "page":
        blocks = kb["blocks"].where((F.col("slug") == slug) & (F.col("page") == n))
        path, title = f"page {n}", f"{doc['title']} — page {n}"
    text = F.lit(own) if own is not None else joined_text()
    row = blocks.agg(
        text.alias("text"), F.count(F.lit(1)).alias("n_blocks"), F.min("page").alias("page_first"), F.max("page").alias("page_last"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"),
        *end_blocks(),
    )
    if kind == "page" and row.first()["n_blocks"] == 0:
        raise ValueError(f"unknown id: {key}")
    size = F.lit(doc["chars"]) if kind == "doc" else F.length("text")
    row = row.withColumn("truncated", size > most_chars)
    row = row.withColumn("text", F.when(F.col("truncated"), _breakdown(kb, slug, kind, row, most_chars)).otherwise(F.col("text"))) if row.first()["truncated"] else row
    cited = T.citation(F.lit(doc["title"]), F.lit(path), F.lit(doc["source_file"]), F.lit(doc["source_format"]), F.col("page_first"), F.col("page_last"), F.lit(doc["doc_date"]), F.col("first_block"), F.col("last_block"))
    return row.select(
        F.lit(key).alias("id"), F.lit(kind).alias("kind"), F.lit(slug).alias("slug"), F.lit(title).alias("title"), "text", "page_first", "page_last", "first_block", "last_block",
        cited.alias("citation"), T.file_url(url_base, F.lit(doc["rel_path"]), F.col("first_block")).alias("url"), F.length("text").cast("long").alias("chars"), "truncated",
    )


def signposts(chunks: DataFrame, most: int = SIGNPOSTS) -> DataFrame:
    """At most ``most`` of each document's chunks (slug, chunk_index, text), evenly spaced, with their landmark lines."""
    per = Window.partitionBy("slug")
    rows = chunks.withColumn("nth", F.row_number().over(per.orderBy("chunk_index")) - 1).withColumn("step", F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(per) / most)))
    return rows.where("nth % step = 0").select("slug", "chunk_index", T.landmark(F.col("text")).alias("landmark"))


def _breakdown(kb, slug: str, kind: str, row: DataFrame, most_chars: int) -> Column:
    """What stands for a text that is too long: a bounded listing, made of at most a dozen lines or a bounded outline."""
    lead = f"too large to fetch: over {most_chars} characters; fetch a smaller unit"
    if kind == "doc":
        lines = outline(kb, slug).withColumn("line", F.concat(F.lit("- "), "id", F.lit(" "), F.coalesce("heading", F.lit(""))))
        kept = bounded_outline(lines, most_chars - len(lead) - 2).orderBy("section_index").select("line").collect()  # bounded by most_chars
        return F.lit("\n".join([lead, "", *(r["line"] for r in kept)]))
    if kind == "chunk":
        return F.lit(lead + "\nNothing smaller is indexed for this id.")
    span = row.select("lo", "hi").first()
    chunks = kb["chunks"].where(F.col("slug") == slug).select("chunk_index", "block_first", "block_last", "text")
    inside = overlapping(chunks, span["lo"], span["hi"]).withColumn("slug", F.lit(slug))
    marks = signposts(inside).orderBy("chunk_index").collect()  # a dozen rows
    ends = inside.agg(F.min("chunk_index"), F.max("chunk_index")).first()
    return F.lit("\n".join([lead, f"chunk:{slug}:{ends[0]} … chunk:{slug}:{ends[1]}", "", *(f"- chunk:{slug}:{m['chunk_index']} — {m['landmark']}" for m in marks)]))


def get_section(kb: dict[str, DataFrame], key: str, neighbours: int = 0, **options) -> DataFrame:
    """A section, or the one that a page falls in, with as many neighbours on either side as there are."""
    kind, slug, n = parse_key(key)
    if kind == "page":
        n = resolve_page(kb["sections"], slug, n)
    if kind not in ("sec", "page") or n is None:
        raise ValueError(f"unknown id: {key}")
    return fetch(kb, f"sec:{slug}:{n}", neighbours, **options)


def health(kb: dict[str, DataFrame]) -> DataFrame:
    return kb["documents"].agg(F.count(F.lit(1)).alias("documents"))
