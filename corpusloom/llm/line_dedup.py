"""Line dedup: three consecutive lines that stood elsewhere before go.

Only DataFrame functions. A document's windows are its runs of three consecutive lines; windows of blank lines alone
do not count. All windows are grouped by two hashes (96 bits together) over the whole corpus. The first occurrence, by
doc_id, then position, stays; every other occurrence is removed unless it overlaps the first one in the same document.
Positions that removed windows cover are merged to spans, and a document keeps the lines between the spans.

Defined results: a null text stays null with 0 lines; an empty text is one blank line; documents under three lines
have no window and stay as they are; rows that repeat a doc_id with the same text count as one document and are all
treated alike; a null doc_id sorts first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import clean_select, documents

#: Lines in a window.
WINDOW = 3


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, pos (from 0), h1, h2: every window that is not blank, one row for each occurrence."""
    lines = F.split("text", "\n", -1)
    rows = clean_select(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("text_key"), lines.alias("lines"))
    rows = rows.where(F.size("lines") >= window)
    at = lambda i: [F.element_at(F.col("lines"), (i + 1 + k).cast("int")) for k in range(window)]
    made = F.transform(
        F.slice("lines", 1, F.size("lines") - (window - 1)),
        lambda _, i: F.struct(i.alias("pos"), F.xxhash64(*at(i)).alias("h1"), F.hash(*at(i)).alias("h2"), (F.trim(F.concat(*at(i))) != "").alias("full")),
    )
    return rows.select("doc_id", "text_key", F.inline(made)).where("full").drop("full")


def covered_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, spans: [begin, end) of the lines that go, merged and in order."""
    rows = line_windows(docs, window)
    first = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "pos")).alias("first")).where("n > 1").drop("n")
    again = rows.join(first, ["h1", "h2"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    later = again.where(~same | (F.col("pos") >= F.col("first.pos") + window)).select("doc_id", "text_key", "pos").distinct()
    by = Window.partitionBy("doc_id", "text_key").orderBy("pos")
    opens = F.coalesce((F.col("pos") - F.lag("pos").over(by) > window).cast("int"), F.lit(1))
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "text_key", "run").agg(F.min("pos").alias("begin"), (F.max("pos") + window).alias("end"))
    return spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text without the covered lines, n_lines, n_removed; a row for each row of ``docs``."""
    spans = covered_spans(docs, window).select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "spans")
    rows = clean_select(docs, doc_id="long", text="string").withColumn("text_key", F.xxhash64("text"))
    rows = rows.join(spans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_key") == F.col("span_key")), "left")
    lines = F.split("text", "\n", -1)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    begins = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    ends = F.concat(F.col("spans.begin"), F.array(n))
    kept = F.filter(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("b"), (e - b).alias("n"))), lambda k: k["n"] > 0)
    text = F.array_join(F.transform(kept, lambda k: F.array_join(F.slice(lines, k["b"] + 1, k["n"]), "\n")), "\n")
    removed = F.aggregate("spans", F.lit(0), lambda total, s: total + s["end"] - s["begin"])
    return rows.select(
        "doc_id",
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(text).alias("text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS body
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS p FROM d WHERE len(lines) >= 3)
  WHERE trim(lines[p + 1] || lines[p + 2] || lines[p + 3], ' ') <> ''
),
f AS (SELECT body, min(doc_id) AS first_doc, arg_min(p, doc_id * 10000000 + p) AS first_pos FROM w GROUP BY body HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p + k AS line
  FROM (SELECT w.doc_id, w.p FROM w JOIN f USING (body) WHERE w.doc_id <> first_doc OR w.p >= first_pos + 3), (VALUES (0), (1), (2)) AS v(k)
),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS body FROM d WHERE text IS NOT NULL),
k AS (
  SELECT l.doc_id, string_agg(body, chr(10) ORDER BY line) FILTER (g.line IS NULL) AS text, count(*) AS n_lines, count(g.line) AS n_removed
  FROM l LEFT JOIN gone g USING (doc_id, line) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN k USING (doc_id)
"""
