"""CSV files as rows and pipe tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Characters that the dialect is guessed from, and the delimiters that it may have. Fixed values.
SNIFFED, DELIMITERS = 8192, ",;\t|"


def parsed_rows(text: str) -> list[list[str]]:
    """Rows of a CSV text, dialect guessed (comma if it cannot be), blank rows left out. A line break ends a row, quoted or not."""
    text = text.removeprefix("﻿")
    try:
        dialect = csv.Sniffer().sniff(text[:SNIFFED], delimiters=DELIMITERS)
    except csv.Error:
        dialect = csv.excel
    return [r for r in csv.reader(text.splitlines(), dialect) if any(c.strip() for c in r)]


def csv_rows(files: DataFrame) -> DataFrame:
    """source_file, rows (array of arrays) of CSV files (source_file, content); a file without rows has none. One file is one value: tables
    that are converted have some hundred rows; larger data belongs in ``spark.read.csv``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source_file": pdf.source_file, "rows": [parsed_rows(bytes(c).decode("utf-8-sig", errors="replace")) for c in pdf.content]})

    return files.select("source_file", "content").mapInPandas(run, "source_file string, rows array<array<string>>")


def csv_blocks(rows: DataFrame) -> DataFrame:
    """slug, ordinal, kind, text, problem of ``csv_rows`` with slug, title, description and csv_mode: heading, description, table - or why not."""
    guard = F.when(F.size("rows") == 0, "no rows").when(F.coalesce("csv_mode", F.lit("table")) != "table", "mode not implemented")
    guard = F.coalesce(guard, T.table_guard(F.size(F.element_at("rows", 1)), F.size("rows") - 1))
    heading = F.struct(F.lit("heading").alias("kind"), F.concat(F.lit("# "), T.escaped_cell(F.coalesce(F.col("title"), T.prettified(F.col("source_file"))))).alias("text"))
    about = F.struct(F.lit("paragraph").alias("kind"), F.col("description").alias("text"))
    table = F.struct(F.lit("table").alias("kind"), T.rendered_table(F.col("rows")).alias("text"))
    parts = F.when(guard.isNull(), F.filter(F.array(heading, about, table), lambda b: b["text"].isNotNull()))
    made = rows.select("slug", guard.alias("problem"), F.posexplode_outer(parts).alias("ordinal", "b"))
    return made.select("slug", "ordinal", "b.kind", "b.text", "problem")


def dumped(rows: DataFrame, columns: list[str]) -> str:
    """A few rows as CSV text, for fixtures."""
    out = io.StringIO()
    csv.writer(out).writerows([columns, *([r[c] for c in columns] for r in rows.select(*columns).collect())])
    return out.getvalue()
