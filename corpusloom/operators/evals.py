"""Evaluation: retrieval cases against hits, answerability of texts, and whether cases can be met at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: A phrase in more sections, or a page in more sections, than this finds nothing in particular. Fixed values.
MOST_PHRASE, MOST_PAGE = 3, 6


def normalized(text: Column) -> Column:
    return T.collapsed(F.lower(text))


def case_results(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """id, rank, hit: the first of the k best hits (id, rank, slug, page_first, page_last, section_text) that has the case's
    slug, phrase (if any, in any case and spacing) and page (if any)."""
    rows = cases.join(hits, "id", "left")
    phrase = F.col("expected_phrase").isNull() | normalized(F.col("section_text")).contains(normalized(F.col("expected_phrase")))
    page = F.col("expected_page").isNull() | F.col("expected_page").between(F.col("page_first"), F.col("page_last"))
    good = (F.col("slug") == F.col("expected_slug")) & phrase & page & (F.col("rank") <= k)
    return rows.groupBy("id").agg(F.min(F.when(good, F.col("rank"))).alias("rank")).withColumn("hit", F.col("rank").isNotNull())


def hit_rate(results: DataFrame) -> DataFrame:
    """cases, hits, rate; the rate of no cases is 0."""
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if("hit").alias("hits"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("rate"))


def answerability(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """id, status (passed, failed, missing document), absent, present: cases (id, document, expect, forbid) against documents (document, text)."""
    rows = cases.join(documents.select("document", "text"), "document", "left")
    body = normalized(F.col("text"))
    absent = F.filter("expect", lambda e: ~body.contains(normalized(e)))
    present = F.filter(F.coalesce("forbid", F.array().cast("array<string>")), lambda e: body.contains(normalized(e)))
    status = F.when(F.col("text").isNull(), "missing document").when((F.size(absent) == 0) & (F.size(present) == 0), "passed").otherwise("failed")
    return rows.select("id", status.alias("status"), absent.alias("absent"), present.alias("present"))


def case_problems(cases: DataFrame) -> DataFrame:
    """id, problem of answerability cases that are not valid: repeated ids, no question, nothing expected."""
    twice = cases.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    blank = cases.where(F.coalesce(F.trim("question"), F.lit("")) == "").select("id", F.lit("no question").alias("problem"))
    empty = cases.where(F.coalesce(F.size("expect"), F.lit(0)) <= 0).select("id", F.lit("nothing expected").alias("problem"))
    return twice.unionByName(blank).unionByName(empty)


def section_texts(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """slug, section_index, page_first, page_last, text: a section's blocks (block_first to block_last) joined by one line feed."""
    keys = ["slug", "section_index", "page_first", "page_last"]
    parts = sections.select(*keys, "block_first", "block_last").join(blocks.select("slug", "ordinal", "text"), "slug").where("ordinal BETWEEN block_first AND block_last")
    return parts.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("ordinal", "text")))["text"], "\n").alias("text"))


def satisfiable(cases: DataFrame, sections: DataFrame, slugs: DataFrame) -> DataFrame:
    """id, phrase_sections, page_sections, both_sections, verdict: whether any section (slug, section_index, page_first, page_last, text) can meet a case."""
    known = cases.join(slugs.select(F.col("slug").alias("expected_slug"), F.lit(True).alias("known")), "expected_slug", "left")
    rows = known.join(sections.withColumnRenamed("slug", "expected_slug"), "expected_slug", "left")
    phrase = F.coalesce(F.col("expected_phrase").isNotNull() & normalized(F.col("text")).contains(normalized(F.col("expected_phrase"))), F.lit(False))
    page = F.coalesce(F.col("expected_page").between(F.col("page_first"), F.col("page_last")), F.lit(False))
    out = rows.groupBy("id").agg(
        F.max(F.coalesce("known", F.lit(False))).alias("known"), F.max(F.col("expected_phrase").isNotNull()).alias("has_phrase"), F.max(F.col("expected_page").isNotNull()).alias("has_page"),
        F.count_if(phrase).alias("phrase_sections"), F.count_if(page).alias("page_sections"), F.count_if(phrase & page).alias("both_sections"),
    )
    verdict = (
        F.when(~F.col("known"), "missing slug")
        .when(F.col("has_phrase") & (F.col("phrase_sections") == 0), "missing phrase")
        .when(F.col("has_page") & (F.col("page_sections") == 0), "missing page")
        .when(F.col("has_phrase") & F.col("has_page") & (F.col("both_sections") == 0), "over-constrained")
        .when((F.col("phrase_sections") > MOST_PHRASE) | (F.col("page_sections") > MOST_PAGE), "weak")
        .otherwise("ok")
    )
    return out.select("id", "phrase_sections", "page_sections", "both_sections", verdict.alias("verdict"))
