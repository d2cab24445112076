"""Sections: what a heading of level one to three opens, up to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Deepest level that opens a section.
DEEPEST = 3


def with_section(blocks: DataFrame) -> DataFrame:
    """``blocks`` (slug, ordinal, kind, level, text) with opens and section_index.

    A heading opens a section unless the section so far is headings alone, that is, unless the block before it is such a heading.
    """
    by = Window.partitionBy("slug").orderBy("ordinal")
    heads = (F.col("kind") == "heading") & (F.col("level") <= DEEPEST)
    rows = blocks.withColumn("heads", F.coalesce(heads, F.lit(False)))
    opens = F.col("heads") & ~F.coalesce(F.lag("heads").over(by), F.lit(False))
    rows = rows.withColumn("opens", opens).withColumn("starts", opens | F.lag("ordinal").over(by).isNull())
    return rows.withColumn("section_index", (F.sum(F.col("starts").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))


def build_sections(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """slug, section_index, level, heading, heading_path, block_first, block_last, page_first, page_last.

    The path is one value for each level: the last heading there, forgotten once a section opens at a shallower level. A heading that
    opens no section adds to the path only where it is deeper than its section's own.
    """
    rows = with_section(blocks).withColumn("name", T.heading_text(F.col("text")))
    to_here = Window.partitionBy("slug").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("opens"), F.col("level")), ignorenulls=True).over(to_here)
    rows = rows.withColumn("own", own)
    event = F.col("opens") | (F.col("heads") & (F.col("level") > F.col("own")))
    for level in range(1, DEEPEST + 1):
        here = event & (F.col("level") == level)
        rows = rows.withColumn(f"at_{level}", F.last(F.when(here, F.struct(F.col("ordinal").alias("o"), F.col("name").alias("n"))), ignorenulls=True).over(to_here))
        rows = rows.withColumn(f"cut_{level}", F.max(F.when(F.col("opens") & (F.col("level") < level), F.col("ordinal"))).over(to_here))
    at = [F.when(F.col(f"at_{k}.o") > F.coalesce(F.col(f"cut_{k}"), F.lit(-1)), F.col(f"at_{k}.n")) for k in range(1, DEEPEST + 1)]
    last = F.max_by(F.array(*at), "ordinal")
    sections = rows.groupBy("slug", "section_index").agg(
        F.coalesce(F.max(F.when(F.col("opens"), F.col("level"))), F.lit(0)).cast("int").alias("level"),
        F.max(F.when(F.col("opens"), F.col("name"))).alias("heading"),
        last.alias("names"),
        F.min("ordinal").alias("block_first"),
        F.max("ordinal").alias("block_last"),
        F.min("page").alias("page_first"),
        F.max("page").alias("page_last"),
    )
    path = F.when(F.col("heading").isNull(), F.col("title")).otherwise(F.array_join(F.concat(F.array("title"), F.array_compact("names")), T.ARROW))
    return sections.join(documents.select("slug", "title"), "slug").select("slug", "section_index", "level", "heading", path.alias("heading_path"), "block_first", "block_last", "page_first", "page_last")
