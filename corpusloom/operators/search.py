"""Search: a lexical and a vector leg over chunks, fused by rank and collapsed to sections."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.terms import STOP_WORDS, stem, term_positions

#: Candidates of each leg, the constant of rank fusion, the range of k. Fixed values.
LEG_LIMIT, RRF_K, LEAST_K, MOST_K = 20, 60, 1, 25
LEGS = ("lexical", "vector", "fused")
#: Weight of a cover of matched words.
WEIGHT = 0.1


def clamped(k: int) -> int:
    return max(LEAST_K, min(MOST_K, k))


# --- lexical --------------------------------------------------------------------------------
@dataclass
class Clause:
    """Words that must all stand (phrases in a row) and phrases that must not."""

    phrases: list[list[str]] = field(default_factory=list)
    without: list[list[str]] = field(default_factory=list)


def parse_query(query: str) -> list[Clause]:
    """Alternatives of a query: bare words all, "..." in a row, ``or`` between alternatives, a leading - for not.

    A word that splits in parts (a code with hyphens) is a phrase of them. Stop words go; an alternative without a word left goes.
    """
    clauses = [Clause()]
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if bare.lower() == "or" and not minus:
            clauses.append(Clause())
            continue
        words = [stem(w) for w in re.findall(r"[^\W_]+", (quoted or bare).lower()) if w not in STOP_WORDS]
        if words:
            (clauses[-1].without if minus else clauses[-1].phrases).append(words)
    return [c for c in clauses if c.phrases]


def postings(chunks: DataFrame) -> DataFrame:
    """term, slug, chunk_index, section_index, page_first, positions: the inverted index, made where the chunks are.

    It comes in segments, each in the order of its terms, so that a reader of the stored table skips the pages of other terms.
    """
    return term_positions(chunks.select("slug", "chunk_index", "section_index", "page_first", "text"))


def _in_a_row(words: list[str]) -> Column:
    """Where the phrase begins, among the positions of its words."""
    at = lambda w: F.coalesce(F.try_element_at(F.col("found"), F.lit(w)), F.array().cast("array<int>"))
    return reduce(lambda starts, kw: F.filter(starts, lambda p: F.array_contains(at(kw[1]), p + kw[0])), list(enumerate(words))[1:], at(words[0]))


def cover_density(words: list[str]) -> Column:
    """Sum over the minimal stretches that hold all ``words`` of WEIGHT / (1 + words between), of the column ``found``."""
    n = len(words)

    def placed(i: int, word: str) -> Column:
        return F.transform(F.coalesce(F.try_element_at(F.col("found"), F.lit(word)), F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(i).alias("i")))

    lists = [placed(i, w) for i, w in enumerate(words)]
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).cast("double").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, i: F.when(i == x["i"], x["p"]).otherwise(v))
        begin = F.array_min(last)
        new = (begin >= 0) & (begin > s["begun"])
        gain = F.lit(WEIGHT) / (1 + x["p"] - begin - (n - 1))
        return F.struct(last.alias("last"), F.when(new, begin).otherwise(s["begun"]).alias("begun"), (s["sum"] + F.when(new, gain).otherwise(0.0)).alias("sum"))

    return F.aggregate(F.array_sort(F.concat(*lists)), start, step, lambda s: s["sum"])


def lexical_leg(index: DataFrame, query: str, limit: int = LEG_LIMIT) -> DataFrame | None:
    """slug, chunk_index, section_index, score: the best matches; None for a query without words, whose leg is left out."""
    clauses = parse_query(query)
    if not clauses:
        return None
    words = sorted({w for c in clauses for p in c.phrases + c.without for w in p})
    found = index.where(F.col("term").isin(words)).groupBy("slug", "chunk_index", "section_index").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("found"))
    scores = []
    for c in clauses:
        match = reduce(lambda a, b: a & b, [F.size(_in_a_row(p)) > 0 for p in c.phrases] + [F.size(_in_a_row(p)) == 0 for p in c.without])
        scores.append(F.when(match, cover_density(sorted({w for p in c.phrases for w in p}))))
    score = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores])
    rows = found.withColumn("score", score).where("score > 0").drop("found")
    return rows.orderBy(F.desc("score"), "slug", "chunk_index").limit(limit)


# --- vector ---------------------------------------------------------------------------------
def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two number arrays in double precision; null where a norm is 0."""
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    total = lambda z: F.aggregate(z, F.lit(0.0).cast("double"), lambda s, v: s + v)
    norms = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    return F.when(norms > 0, total(F.zip_with(x, y, lambda p, q: p * q)) / norms)


def vector_leg(chunks: DataFrame, vector: list[float], limit: int = LEG_LIMIT) -> DataFrame:
    """slug, chunk_index, section_index, score: all chunks compared, the nearest kept."""
    query = F.array(*(F.lit(float(v)) for v in vector))
    rows = chunks.select("slug", "chunk_index", "section_index", cosine(F.col("embedding"), query).alias("score")).where("score IS NOT NULL")
    return rows.orderBy(F.desc("score"), "slug", "chunk_index").limit(limit)


def hash_vector(text: Column, dim: int = 8) -> Column:
    """A unit vector from the text's SHA-256, the same in SQL: numbers of four hexadecimal digits, centred. Digest and norm are computed once."""
    raw = lambda digest: F.array(*(F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("double") - 32767.5 for i in range(dim)))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0).cast("double"), lambda s, v: s + v * v))
    return T.bound(F.sha2(text, 256), lambda digest: T.bound(raw(digest), lambda r: T.bound(norm(r), lambda n: F.transform(r, lambda v: v / n))))


# --- fusion ---------------------------------------------------------------------------------
def filtered(rows: DataFrame, documents: DataFrame, slug: str | None = None, text_class: str | None = None, page_min: int | None = None, page_max: int | None = None) -> DataFrame:
    """``rows`` with slug and page_first under all filters given; documents are joined for the text class alone. An unknown page fails a bound."""
    if slug:
        rows = rows.where(F.col("slug") == slug)
    if page_min is not None:
        rows = rows.where(F.col("page_first") >= page_min)
    if page_max is not None:
        rows = rows.where(F.col("page_first") <= page_max)
    if text_class:
        rows = rows.join(documents.where(F.col("text_class") == text_class).select("slug"), "slug", "left_semi")
    return rows


def ranked(leg: DataFrame) -> DataFrame:
    """A leg's few rows with rank from 1; called on what a limit left, so one partition is enough."""
    return leg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "slug", "chunk_index")))


def fuse(*legs: DataFrame, k: int = RRF_K) -> DataFrame:
    """slug, chunk_index, section_index, score: the sum over legs of 1 / (k + rank)."""
    rows = reduce(DataFrame.unionByName, [x.select("slug", "chunk_index", "section_index", "rank") for x in legs])
    return rows.groupBy("slug", "chunk_index", "section_index").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def collapsed_to_sections(rows: DataFrame, k: int) -> DataFrame:
    """The best chunk of each section, the k best sections; ties by slug and section."""
    best = Window.partitionBy("slug", "section_index").orderBy(F.desc("score"), "chunk_index")
    one = rows.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    return one.orderBy(F.desc("score"), "slug", "section_index").limit(clamped(k))


def search(kb: dict[str, DataFrame], query: str, embed: Callable[[str], list[float]], k: int = 8, leg: str = "fused", **filters) -> DataFrame:
    """Section hits of one leg, best first. ``kb``: documents, sections, blocks, chunks (with embedding), postings."""
    if leg not in LEGS:
        raise ValueError(f"leg must be one of {LEGS}, got {leg!r}")
    spark = kb["chunks"].sparkSession
    lexical = lexical_leg(filtered(kb["postings"], kb["documents"], **filters), query) if leg != "vector" else None
    vector = vector_leg(filtered(kb["chunks"], kb["documents"], **filters), embed(query)) if leg != "lexical" else None
    legs = {name: ranked(x) for name, x in (("lexical", lexical), ("vector", vector)) if x is not None}
    nothing = spark.createDataFrame([], "slug string, chunk_index int, section_index int, score double, rank int")
    own = {name: legs.get(name, nothing) for name in ("lexical", "vector")}
    scored = fuse(*legs.values()) if leg == "fused" and legs else own.get(leg, nothing).drop("rank")
    hits = collapsed_to_sections(scored, k)
    for name, x in own.items():
        hits = hits.join(x.select("slug", "chunk_index", F.col("rank").alias(f"{name}_rank")), ["slug", "chunk_index"], "left")
    return hydrated(hits, kb).orderBy(F.desc("score"), "slug", "section_index")


def hydrated(hits: DataFrame, kb: dict[str, DataFrame]) -> DataFrame:
    """Hits with what is shown of their section, document and best chunk; these tables are read for the hits alone."""
    few = F.broadcast(hits)  # at most MOST_K rows
    sections = kb["sections"].join(few, ["slug", "section_index"])
    texts = kb["chunks"].select("slug", "chunk_index", "text").join(F.broadcast(hits.select("slug", "chunk_index")), ["slug", "chunk_index"], "left_semi")
    docs = kb["documents"].select("slug", "title", "doc_date", "text_class", "rel_path").join(F.broadcast(hits.select("slug")), "slug", "left_semi")
    rows = sections.join(F.broadcast(docs), "slug").join(F.broadcast(texts), ["slug", "chunk_index"])
    return rows.select(
        T.section_key(F.col("slug"), F.col("section_index")).alias("id"), T.section_title(F.col("title"), F.col("heading_path")).alias("title"), "slug", "section_index", "heading_path",
        "page_first", "page_last", "block_first", "block_last", "doc_date", "text_class", "rel_path", T.snippet(F.col("text")).alias("snippet"), "score", F.col("chunk_index").alias("best_chunk_index"), "lexical_rank", "vector_rank",
    )
