"""Chunks: small runs of a section's blocks, the unit that search matches against."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

TARGET, MOST = 1200, 2500
GLUED = ("annotation", "boxed_text")
#: Pieces of a section up to which it is folded in one row; the fold copies what it has at each step.
FOLD = 2000

_RULE = r"^\s*\|?(\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*$"


def _greedy(parts: Column, joiner: str, most: int) -> Column:
    """Neighbouring strings joined while they fit ``most``; never cut."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        longer = F.concat(s["now"], F.lit(joiner), p)
        return (
            F.when(s["now"] == "", F.struct(s["done"].alias("done"), p.alias("now")))
            .when(F.length(longer) > most, F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), p.alias("now")))
            .otherwise(F.struct(s["done"].alias("done"), longer.alias("now")))
        )

    return F.aggregate(parts, empty, step, lambda s: F.concat(s["done"], F.when(s["now"] != "", F.array(s["now"])).otherwise(F.array().cast("array<string>"))))


def paragraph_pieces(text: Column, most: int = MOST) -> Column:
    """Cut at blank lines, filled up to ``most``; a paragraph is never cut."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda p: T.stripped(p) != "")
    return F.when(F.size(parts) == 0, F.array(text)).otherwise(_greedy(parts, "\n\n", most))


def is_pipe_table(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    return (F.size(lines) >= 3) & F.ltrim(F.element_at(lines, 1)).startswith("|") & F.coalesce(F.get(lines, F.lit(1)), F.lit("")).rlike(_RULE)


def row_pieces(text: Column, most: int = MOST) -> Column:
    """A pipe table cut between rows: each piece has the header, its rule, the last row of the piece before, and one new row or more.

    Rows are places in the list of lines, pieces places in the list of rows: the fold adds lengths, and each text is joined once.
    """
    spans = lambda opens, n: F.zip_with(opens, F.concat(F.slice(opens, F.lit(2), F.size(opens)), F.array(n)), lambda a, z: F.struct(a.alias("a"), z.alias("z")))

    def rows_of(lines: Column) -> Column:
        """A line that begins with no pipe continues the row before it."""
        opens = F.filter(F.sequence(F.lit(2), F.greatest(F.size(lines) - 1, F.lit(2))), lambda i: (i < F.size(lines)) & ((i == 2) | F.ltrim(F.get(lines, i)).startswith("|")))
        return F.transform(T.bound(opens, lambda o: spans(o, F.size(lines))), lambda x: F.array_join(F.slice(lines, x["a"] + 1, x["z"] - x["a"]), "\n"))

    def cut(header: Column, rows: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("chars"), F.lit(0).alias("before"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("opens"))

        def step(s: Column, row: Column) -> Column:
            n, h = F.length(row), F.length(header)
            longer, opens = s["chars"] + 1 + n, F.concat(s["opens"], F.array(s["i"]))
            fits = longer <= most
            chars = F.when(s["chars"].isNull(), h + 1 + n).when(fits, longer).otherwise(h + 2 + s["before"] + n)
            return F.struct(chars.alias("chars"), n.alias("before"), (s["i"] + 1).alias("i"), F.when(F.coalesce(fits, F.lit(False)), s["opens"]).otherwise(opens).alias("opens"))

        first = lambda x: F.greatest(x["a"] - 1, F.lit(0))  # noqa: E731  the row before comes again
        opens = F.aggregate(rows, start, step, lambda s: s["opens"])
        return F.transform(T.bound(opens, lambda o: spans(o, F.size(rows))), lambda x: F.concat(header, F.lit("\n"), F.array_join(F.slice(rows, first(x) + 1, x["z"] - first(x)), "\n")))

    def whole(lines: Column) -> Column:
        header = F.concat(F.get(lines, F.lit(0)), F.lit("\n"), F.get(lines, F.lit(1)))
        return T.bound(rows_of(lines), lambda rows: T.bound(header, lambda h: F.when(F.size(rows) == 0, F.array(F.lit(None).cast("string"))).otherwise(cut(h, rows))))

    return T.bound(F.split(text, "\n", -1), whole)


def pieces(blocks: DataFrame, most: int = MOST) -> DataFrame:
    """``blocks`` (with section_index) in pieces: piece, role (T table, P cut paragraph or list, N other), first, last, glued, size."""
    long = F.length("text") > most
    cut = (
        F.when(long & (F.col("kind") == "table") & is_pipe_table(F.col("text")), row_pieces(F.col("text"), most))
        .when(long & F.col("kind").isin("table", "paragraph", "list"), paragraph_pieces(F.col("text"), most))
        .otherwise(F.array("text"))
    )
    role = F.when(F.col("kind") == "table", "T").when(long & F.col("kind").isin("paragraph", "list"), "P").otherwise("N")
    rows = blocks.withColumn("role", role).withColumn("cut", cut).withColumn("n_pieces", F.size("cut"))
    rows = rows.select("slug", "section_index", "ordinal", "page", "kind", "role", "n_pieces", F.posexplode("cut").alias("piece", "text"))
    return rows.withColumns({"first": F.col("piece") == 0, "last": F.col("piece") == F.col("n_pieces") - 1, "glued": F.col("kind").isin(*GLUED), "size": F.length("text")})


def _folded(sections: DataFrame, target: int) -> DataFrame:
    """Adds ``cids``: the chunk of each piece, counted within its section."""
    start = F.struct(
        F.lit(0).alias("cid"), F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("lone"), F.lit(False).alias("table"), F.array().cast("array<int>").alias("out")
    )

    def step(s: Column, p: Column) -> Column:
        open_ = s["n"] > 0
        close = open_ & (
            (s["table"] & ~p["glued"])
            | ((p["role"] == "T") & p["first"] & ~s["lone"])
            | (p["role"] == "P")
            | ((p["role"] == "N") & ~p["glued"] & (s["size"] + p["size"] > target))
        )
        cid, n = s["cid"] + close.cast("int"), F.when(close, 0).otherwise(s["n"])
        size = F.when(n == 0, p["size"]).otherwise(s["size"] + 2 + p["size"])
        after = ((p["role"] == "T") & ~p["last"]) | (p["role"] == "P")
        return F.struct(
            (cid + after.cast("int")).alias("cid"),
            F.when(after, 0).otherwise(n + 1).alias("n"),
            F.when(after, 0).otherwise(size).alias("size"),
            (~after & (n == 0) & (p["kind"] == "heading")).alias("lone"),
            (~after & ((p["role"] == "T") | (s["table"] & p["glued"]))).alias("table"),
            F.concat(s["out"], F.array(cid)).alias("out"),
        )

    return sections.withColumn("cids", F.aggregate("pieces", start, step, lambda s: s["out"]))


def _walked(target: int):
    """The same walk for a section of very many pieces, in time that grows with their number."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ordinal", "piece"], kind="stable")
        cid = n = held = 0
        lone = table = False
        out = []
        for role, first, last, glued, kind, size in zip(pdf.role, pdf["first"], pdf["last"], pdf.glued, pdf.kind, pdf["size"], strict=True):
            if n and ((table and not glued) or (role == "T" and first and not lone) or role == "P" or (role == "N" and not glued and held + size > target)):
                cid, n = cid + 1, 0
                table = False
            out.append(cid)
            held = size if n == 0 else held + 2 + size
            lone = n == 0 and kind == "heading"
            table = role == "T" or (table and glued)
            n += 1
            if (role == "T" and not last) or role == "P":
                cid, n, held, lone, table = cid + 1, 0, 0, False, False
        return pdf.assign(cid=out)[["slug", "section_index", "ordinal", "piece", "cid"]]

    return walk


def build_chunks(blocks: DataFrame, target: int = TARGET, most: int = MOST, fold: int = FOLD) -> DataFrame:
    """slug, chunk_index, section_index, block_first, block_last, page_first, page_last, text of ``blocks`` with section_index."""
    rows = pieces(blocks, most)
    key = ["slug", "section_index"]
    sized = rows.withColumn("n_all", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    fields = F.struct("ordinal", "piece", "kind", "role", "first", "last", "glued", "size", "page", "text")
    short = sized.where(F.col("n_all") <= fold).groupBy(*key).agg(F.sort_array(F.collect_list(fields)).alias("pieces"))
    short = _folded(short, target).select(*key, F.explode(F.arrays_zip("pieces", "cids")).alias("z")).select(*key, "z.pieces.ordinal", "z.pieces.piece", "z.pieces.page", "z.pieces.text", F.col("z.cids").alias("cid"))
    long = sized.where(F.col("n_all") > fold)
    numbers = long.select(*key, "ordinal", "piece", "role", "first", "last", "glued", "kind", "size").groupBy(*key).applyInPandas(_walked(target), "slug string, section_index int, ordinal int, piece int, cid int")
    long = long.select(*key, "ordinal", "piece", "page", "text").join(numbers, [*key, "ordinal", "piece"]).select(*short.columns)
    every = short.unionByName(long).repartition("slug")  # one shuffle for the texts and their numbers
    chunks = every.groupBy(*key, "cid").agg(
        F.min("ordinal").alias("block_first"), F.max("ordinal").alias("block_last"), F.min("page").alias("page_first"), F.max("page").alias("page_last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "piece", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
    )
    index = (F.row_number().over(Window.partitionBy("slug").orderBy("section_index", "cid")) - 1).cast("int")
    return chunks.withColumn("chunk_index", index).select("slug", "chunk_index", "section_index", "block_first", "block_last", "page_first", "page_last", "text")
