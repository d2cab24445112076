"""Documents as ordered blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Precedes each block of a converted body; the block's id follows.
ANCHOR = r"(?m)^<!-- block=(\S+) -->\n?"


def numbered(blocks: DataFrame, order: list[str], start: int = 0, by: tuple[str, ...] = ("slug",), name: str = "ordinal") -> DataFrame:
    """``blocks`` without blank ones, numbered from ``start`` within ``by``."""
    kept = blocks.where(T.stripped(F.col("text")) != "")
    return kept.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)).cast("int"))


def with_block_ids(blocks: DataFrame) -> DataFrame:
    """block_id: ``slug:pNNN:bNNN``, counted from 1 on each page; unpaged ids have four digits once a document has 1000 blocks."""
    page = Window.partitionBy("slug", "page")
    nth = F.row_number().over(page.orderBy("ordinal"))
    width = F.when(F.col("page").isNull() & (F.count(F.lit(1)).over(page) >= 1000), 4).otherwise(3)
    return blocks.withColumn("block_id", block_id(F.col("slug"), F.col("page"), nth, width))


def block_id(slug: Column, page: Column, nth: Column, width: Column | int = 3) -> Column:
    text = nth.cast("string")
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(slug, F.lit(":p"), T.padded(F.coalesce(page, F.lit(0))), F.lit(":b"), F.lpad(text, F.greatest(F.length(text), width), F.lit("0")))


def fallback_blocks(bodies: DataFrame) -> DataFrame:
    """slug, ordinal, block_id, page, kind, level, text of ``bodies`` (slug, body) that carry no anchors.

    A body of two lines or more that are all rows of a pipe table is one table; otherwise lines of one to three hashes are headings and
    what stands between them paragraphs. A body is split, gathered and numbered in its own row.
    """
    is_row = lambda x: T.stripped(x).startswith("|")

    def runs(lines: Column, heads: Column) -> Column:
        n = F.size(lines)
        opens = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | F.get(heads, i) | F.coalesce(F.get(heads, i - 1), F.lit(True)))
        stretch = lambda a, z: F.struct(F.get(heads, a).alias("heading"), T.without_outer_newlines(F.array_join(F.slice(lines, a + 1, z - a), "\n")).alias("text"))
        return T.bound(opens, lambda o: F.zip_with(o, F.concat(F.slice(o, F.lit(2), F.size(o)), F.array(n)), stretch))

    def made(body: Column, lines: Column) -> Column:
        filled = F.filter(lines, lambda x: T.stripped(x) != "")
        single = T.bound(filled, lambda x: (F.size(x) >= 2) & F.forall(x, is_row))
        table = F.array(F.struct(F.lit(None).cast("boolean").alias("heading"), body.alias("text")))
        split = T.bound(F.transform(lines, lambda x: x.rlike(r"^#{1,3}\s+\S")), lambda heads: F.filter(runs(lines, heads), lambda r: T.stripped(r["text"]) != ""))
        return F.when(single, table).otherwise(split)

    rows = bodies.select("slug", T.bound(T.without_outer_newlines(F.col("body")), lambda b: T.bound(F.split(b, "\n", -1), lambda lines: made(b, lines))).alias("made"))
    rows = rows.select("slug", F.size("made").alias("n"), F.posexplode("made").alias("ordinal", "m"))
    page, head = F.lit(None).cast("int"), F.col("m.heading")
    kind = F.when(head.isNull(), "table").when(head, "heading").otherwise("paragraph")
    level = F.when(head, F.length(F.regexp_extract("m.text", "^(#+)", 1)))
    key = block_id(F.col("slug"), page, F.col("ordinal") + 1, F.when(F.col("n") >= 1000, 4).otherwise(3))
    return rows.select("slug", "ordinal", key.alias("block_id"), page.alias("page"), kind.alias("kind"), level.alias("level"), F.col("m.text").alias("text"))


def anchored_blocks(bodies: DataFrame, sidecar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of ``bodies`` (slug, body) with anchors and ``sidecar`` (slug, block_id, page, kind, confidence).

    Text before the first anchor is a paragraph of id ``slug:p000:b000``. Anchors and sidecar must name the same blocks; ``errors``
    has slug, block_id, problem, and a document with one has no blocks. A body meets its sidecar once, by slug.
    """
    facts = ["page", "kind", "confidence"]
    side = sidecar.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("block_id", *facts))).alias("side"))
    parts = F.split(F.regexp_replace("body", ANCHOR, "\u0001$1\u0002"), "\u0001", -1)
    rows = bodies.select("slug", parts.alias("parts")).join(side, "slug", "left")
    rows = rows.withColumn("ids", F.transform(F.slice("parts", F.lit(2), F.size("parts")), lambda p: F.substring_index(p, "\u0002", 1)))
    rows = rows.withColumn("known", F.coalesce(F.transform("side", lambda x: x["block_id"]), F.array().cast("array<string>")))
    rows = rows.withColumn("lost", F.array_except("ids", "known")).withColumn("extra", F.array_except("known", "ids"))
    every = lambda of, odd: F.when(F.size(odd) > 0, F.filter(of, lambda x: F.array_contains(odd, x))).otherwise(F.array().cast("array<string>"))
    named = lambda of, odd, problem: F.transform(every(of, F.col(odd)), lambda x: F.struct(x.alias("block_id"), F.lit(problem).alias("problem")))
    errors = rows.where((F.size("lost") > 0) | (F.size("extra") > 0)).select("slug", F.inline(F.concat(named("ids", "lost", "not in the sidecar"), named("known", "extra", "not in the body"))))
    good = rows.where((F.size("lost") == 0) & (F.size("extra") == 0))
    none = lambda f: F.lit(None).cast(sidecar.schema[f].dataType)
    entry = lambda pos, x: F.struct(pos.cast("int").alias("pos"), *((none(f) if x is None else x[f]).alias(f) for f in facts))
    placed = F.sort_array(F.transform("ids", lambda a, i: F.struct(a.alias("id"), (i + 1).alias("pos"))))
    # Both lists are sorted by id, so they go together; only ids that come twice are looked up.
    pairs = lambda at: F.when(F.transform(at, lambda p: p["id"]) == F.col("known"), F.zip_with(at, F.col("side"), lambda p, x: entry(p["pos"], x))).otherwise(
        F.flatten(F.transform(at, lambda p: F.transform(F.filter("side", lambda x: x["block_id"] == p["id"]), lambda x: entry(p["pos"], x))))
    )
    entries = F.sort_array(F.concat(F.array(entry(F.lit(0), None)), F.when(F.size("ids") > 0, T.bound(placed, pairs)).otherwise(F.array().cast(f"array<struct<pos:int,{','.join(f'{f}:{sidecar.schema[f].dataType.simpleString()}' for f in facts)}>>"))))
    part = lambda e: F.get(F.col("parts"), e["pos"])
    text = lambda e: T.without_outer_newlines(F.when(e["pos"] == 0, part(e)).otherwise(F.regexp_replace(part(e), "(?s)^[^\u0002]*\u0002", "")))
    key = lambda e: F.when(e["pos"] == 0, F.concat("slug", F.lit(":p000:b000"))).otherwise(F.substring_index(part(e), "\u0002", 1))
    made = F.transform(entries, lambda e: F.struct(key(e).alias("block_id"), *(e[f].alias(f) for f in facts), text(e).alias("text")))
    good = good.select("slug", F.posexplode(F.filter(made, lambda b: T.stripped(b["text"]) != "")).alias("ordinal", "b")).select("slug", "ordinal", "b.*")
    good = good.withColumn("kind", F.coalesce("kind", F.lit("paragraph"))).withColumn("level", F.when(F.col("kind") == "heading", T.heading_level(F.col("text"))))
    return good.select("slug", "ordinal", "block_id", "page", "kind", "confidence", "level", "text"), errors


def rendered(blocks: DataFrame) -> DataFrame:
    """slug, body with anchors, sidecar as JSON: the inverse of ``anchored_blocks``."""
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "block_id", "page", "kind", "text")))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<!-- block="), r["block_id"], F.lit(" -->\n"), r["text"])), "\n\n")
    side = F.to_json(F.transform("rows", lambda r: F.struct(r["block_id"].alias("block_id"), r["page"].alias("page"), r["kind"].alias("kind"))))
    return blocks.groupBy("slug").agg(rows.alias("rows")).select("slug", F.concat(body, F.lit("\n")).alias("body"), side.alias("sidecar"))
