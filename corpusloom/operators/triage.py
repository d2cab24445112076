"""Triage and the corpus report: how usable each document's text is, and totals over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Fixed thresholds.
LEAST_CHARS, LEAST_ALPHA, MOST_LOW, MOST_IMAGE, ALARM = 100, 0.60, 0.20, 0.15, 0.30


def triage_pages(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Measures of each document's pages (slug, page, text): page_count, chars_mean, chars_median, low_pages, low_fraction, alpha_ratio, text_class.

    ``documents`` (slug): documents without a page become errors. Nothing but numbers is gathered: the share of good characters over
    all pages is a ratio of sums.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    rows = pages.select("slug", "page", n.alias("n"), (T.alpha_ratio(F.coalesce("text", F.lit(""))) * n).alias("good"))
    low = F.col("n") < LEAST_CHARS
    out = rows.groupBy("slug").agg(
        F.count(F.lit(1)).alias("page_count"), F.bround(F.avg("n"), 1).alias("chars_mean"), F.median("n").alias("median"),
        F.sort_array(F.collect_list(F.when(low, F.col("page")))).alias("low_pages"), F.count_if(low).alias("n_low"), F.sum("good").alias("good"), F.sum("n").alias("chars"),
    )
    if documents is not None:
        out = documents.select("slug").join(out, "slug", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    fraction = F.col("n_low") / F.col("page_count")
    ratio = F.when(F.col("chars") == 0, 0.0).otherwise(F.col("good") / F.col("chars"))
    kind = (
        F.when(F.col("page_count") == 0, "error")
        .when((F.col("median") < LEAST_CHARS) | (ratio < LEAST_ALPHA), "needs_ocr")
        .when(fraction > MOST_LOW, "partial")
        .otherwise("clean")
    )
    some = F.col("page_count") > 0
    return out.select(
        "slug", "page_count", "chars_mean", F.bround("median", 1).alias("chars_median"), F.coalesce("n_low", F.lit(0)).alias("pages_below"), F.when(some, F.bround(fraction, 4)).alias("low_fraction"),
        F.when(some, F.bround(ratio, 4)).alias("alpha_ratio"), kind.alias("text_class"), "low_pages", F.when(~some, F.lit("zero pages")).alias("error"),
    )


def triage(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """A result for each manifest entry (slug, source_format, error): only PDFs are measured, other formats are clean with no pages, errors stay errors."""
    measured = triage_pages(pages, manifest.where("source_format = 'pdf' AND error IS NULL"))
    rest = manifest.where("source_format <> 'pdf' OR error IS NOT NULL").select("slug", F.lit(0).cast("long").alias("page_count"), F.when(F.col("error").isNull(), "clean").otherwise("error").alias("text_class"), "error")
    return measured.unionByName(rest, allowMissingColumns=True)


def layout_facts(pages: DataFrame) -> DataFrame:
    """Of page analyses (slug, page, columns, ruled_tables, text_tables, annotations, callouts, form_fields, image_coverage), a row for each document."""
    images = F.col("image_coverage") > MOST_IMAGE
    out = pages.groupBy("slug").agg(
        F.max("columns").alias("max_columns"), F.sum("ruled_tables").alias("ruled_tables"), F.count_if((F.col("ruled_tables") == 0) & F.col("text_tables")).alias("borderless_table_pages"),
        F.sum("annotations").alias("annotations"), F.sum("callouts").alias("annotations_with_callout"), F.sum("form_fields").alias("form_fields"),
        F.sort_array(F.collect_list(F.when(images, F.col("page")))).alias("image_pages"), F.bround(F.max("image_coverage"), 4).alias("max_image_coverage"),
    )
    form = (F.col("form_fields") > 0) & (F.col("form_fields") > F.col("ruled_tables")) & (F.size("image_pages") == 0)
    return out.withColumn("form_like", form)


def report_totals(entries: DataFrame) -> DataFrame:
    """One row of totals over manifest entries (status, text_class, page_count, low_pages as a number); fractions of nothing are null."""
    there = F.col("status") != "missing"
    triaged = there & F.coalesce(F.col("text_class").isin(*T.TEXT_CLASSES), F.lit(False))
    pages = F.coalesce("page_count", F.lit(0))
    counts = {f"{k}_documents": F.count_if(triaged & (F.col("text_class") == k)) for k in T.TEXT_CLASSES}
    sums = {f"{k}_pages": F.coalesce(F.sum(F.when(triaged & (F.col("text_class") == k), pages)), F.lit(0)) for k in T.TEXT_CLASSES}
    row = entries.agg(
        F.count(F.lit(1)).alias("documents_in_manifest"), F.count_if(triaged).alias("documents_triaged"), F.count_if(~there).alias("documents_missing"), F.count_if(there & ~triaged).alias("documents_untriaged"),
        F.coalesce(F.sum(F.when(triaged, pages)), F.lit(0)).alias("pages_total"), F.coalesce(F.sum(F.when(triaged, F.coalesce("low_pages", F.lit(0)))), F.lit(0)).alias("low_pages_total"),
        *(v.alias(k) for k, v in (counts | sums).items()),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.bround(F.col(a) / F.col(b), 4))
    return row.withColumns(
        {
            "needs_ocr_document_fraction": share("needs_ocr_documents", "documents_triaged"),
            "needs_ocr_page_fraction": share("needs_ocr_pages", "pages_total"),
            "low_page_fraction": share("low_pages_total", "pages_total"),
        }
    )


def stop_and_ask(entries: DataFrame, skipped: DataFrame) -> DataFrame:
    """kind, detail: what a person must decide. ``entries``: source_file, status, text_class, error, page_count, low_pages; ``skipped``: extension, files."""
    totals = report_totals(entries)
    alarm = totals.where(F.col("needs_ocr_document_fraction") > ALARM).select(F.lit("needs_ocr share").alias("kind"), T.percent(F.col("needs_ocr_document_fraction")).alias("detail"))
    errors = entries.where("text_class = 'error'").select(F.lit("unreadable").alias("kind"), F.concat("source_file", F.lit(": "), F.coalesce("error", F.lit("no detail"))).alias("detail"))
    gone = entries.where("status = 'missing'")
    first = gone.orderBy("source_file").limit(5).agg(F.array_join(F.sort_array(F.collect_list("source_file")), ", ").alias("names"))
    missing = gone.agg(F.count(F.lit(1)).alias("n")).crossJoin(first).where("n > 0")  # one row with one row
    missing = missing.select(F.lit("missing").alias("kind"), F.concat(F.col("n").cast("string"), F.lit(": "), "names", F.when(F.col("n") > 5, " ...").otherwise("")).alias("detail"))
    other = skipped.agg(F.sort_array(F.collect_list(F.format_string("%s (%d)", "extension", "files"))).alias("all")).where(F.size("all") > 0)
    return alarm.unionByName(errors).unionByName(missing).unionByName(other.select(F.lit("skipped").alias("kind"), F.array_join("all", ", ").alias("detail")))


def report_json(totals: DataFrame) -> DataFrame:
    """The totals as one JSON string with sorted keys; nulls are kept."""
    return totals.select(F.to_json(F.struct(*sorted(totals.columns)), {"ignoreNullFields": "false"}).alias("report"))
