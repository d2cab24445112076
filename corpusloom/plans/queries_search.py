"""Queries over ranking, search and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.terms import plain_tokens
from corpusloom.operators import evals as E
from corpusloom.operators import search as S
from corpusloom.plans import corpus as K
from corpusloom.plans import sql
from corpusloom.queries import query

W = "WITH "
_VEC = "v AS (SELECT 'vec-' || (vec_id % 50) AS slug, vec_id::INT AS chunk_index, label::INT AS section_index, embedding::DOUBLE[] AS e FROM embeddings)"
_Q = ", s{0} AS (SELECT v.slug, v.chunk_index, v.section_index, list_cosine_similarity(v.e, o.e) AS score FROM v, (SELECT e FROM v WHERE chunk_index = {0}) AS o), q{0} AS (SELECT * FROM s{0} ORDER BY round(score, 12) DESC, slug, chunk_index LIMIT 20)"
_LEG = _VEC + _Q.format(7)


@query("rank2_vector", W + _LEG + " SELECT slug, chunk_index, section_index, round(score, 6) AS score FROM q7")
def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ranked_vectors(spark, sf_dir, 7).withColumn("score", F.round("score", 6))


_TWO = _LEG + _Q.format(11)
_RANKS = _TWO + ", r AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, slug, chunk_index) AS rank FROM q7 UNION ALL SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, slug, chunk_index) FROM q11), f AS (SELECT slug, chunk_index, section_index, sum(1.0::DOUBLE / (60 + rank)) AS score FROM r GROUP BY ALL)"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fuse(*(S.ranked(K.ranked_vectors(spark, sf_dir, i)) for i in (7, 11)))


@query("win5_leg_ranks", W + _RANKS + " SELECT slug, chunk_index, rank FROM r")
def leg_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = [S.ranked(K.ranked_vectors(spark, sf_dir, i)) for i in (7, 11)]
    return legs[0].unionByName(legs[1]).select("slug", "chunk_index", "rank")


@query("rank3_fusion", W + _RANKS + " SELECT slug, chunk_index, section_index, round(score, 9) AS score FROM f")
def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 9))


@query("win6_collapse", W + _RANKS + """, b AS (SELECT *, row_number() OVER (PARTITION BY slug, section_index ORDER BY round(score, 12) DESC, chunk_index) AS nth FROM f)
SELECT slug, chunk_index, section_index, round(score, 9) AS score FROM b WHERE nth = 1 ORDER BY round(score, 12) DESC, slug, section_index LIMIT 8""")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.collapsed_to_sections(_fused(spark, sf_dir), 8).select("slug", "chunk_index", "section_index", F.round("score", 9).alias("score"))


@query("fil1_filtered_leg", W.replace("WITH", "WITH RECURSIVE") + sql.CHUNKS + " SELECT slug, chunk_index FROM chunks JOIN docs USING (slug) WHERE text_class = 'clean' AND page_first >= 1 AND page_first <= 2")
def filtered_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filtered(K.chunks(spark, sf_dir), K.documents(spark, sf_dir), text_class="clean", page_min=1, page_max=2).select("slug", "chunk_index")


@query("rank1_all_words", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
m AS (SELECT doc_id, count(*) FILTER (w = 'the') AS a, count(*) FILTER (w = 'thing') AS b, count(*) AS n FROM t GROUP BY doc_id)
SELECT doc_id, a + b AS tf, round((a + b) / n, 9) AS score FROM m WHERE a > 0 AND b > 0 ORDER BY round((a + b) / n, 12) DESC, doc_id LIMIT 20""")
def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both words, by their share of all words: the SQL-expressible kin of the lexical leg."""
    rows = K.table(spark, sf_dir, "documents").select("doc_id", plain_tokens(F.col("text")).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    rows = rows.select("doc_id", count("the").alias("a"), count("thing").alias("b"), F.size("t").alias("n")).where("a > 0 AND b > 0")
    scored = rows.select("doc_id", (F.col("a") + F.col("b")).alias("tf"), ((F.col("a") + F.col("b")) / F.col("n")).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 12)), "doc_id").limit(20).withColumn("score", F.round("score", 9))


@query("rank1_lexical")
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical leg: stemmed words, a phrase, an alternative and an exclusion."""
    return S.lexical_leg(K.stored_kb(spark, sf_dir)["postings"], 'inher reed or thing "that this" -onerth or "in is" edhe').withColumn("score", F.round("score", 9))


@query("api1_search")
def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs over the chunks of ``documents``, fused, collapsed to sections and shown."""
    kb = K.stored_kb(spark, sf_dir)
    vector = spark.range(1).select(S.hash_vector(F.lit("inher thing")).alias("v")).first()["v"]
    hits = S.search(kb, "inher thing", lambda _: vector)
    return hits.select("id", "title", "snippet", "page_first", "page_last", "doc_date", "text_class", F.round("score", 9).alias("score"), "lexical_rank", "vector_rank")


@query("emb_hash_vector", """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), n AS (SELECT doc_id, unnest(range(0, 8)) AS i, h FROM d), x AS (SELECT doc_id, i, ('0x' || substr(h, (4 * i + 1)::INT, 4))::INT - 32767.5::DOUBLE AS v FROM n)
SELECT doc_id, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS v FROM x""")
def hash_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.hash_vector(F.col("text"))).alias("i", "v"))
    return rows.withColumn("v", F.round("v", 9))


@query("agg11_hit_rate", """WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents), c AS (SELECT item_id AS id, item_id * 7919 % n AS want FROM benchmark, n),
hit AS (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY (id * 7 + doc_id * 13) % 101, doc_id) AS rank FROM c JOIN documents ON doc_id // 8 = want // 8),
res AS (SELECT c.id, min(CASE WHEN doc_id = want AND rank <= 5 THEN rank END) AS rank FROM c LEFT JOIN hit USING (id) GROUP BY c.id) SELECT count(*) AS cases, count(rank) AS hits, coalesce(avg((rank IS NOT NULL)::INT), 0) AS rate FROM res""")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected ids from the whole range; the hits of a case are the documents in its group of eight ids."""
    docs = K.table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("g"))
    last = docs.agg((F.max("doc_id") + 1).alias("n"))
    cases = K.table(spark, sf_dir, "benchmark").select("item_id").crossJoin(F.broadcast(last)).withColumn("want", F.col("item_id") * 7919 % F.col("n"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy((F.col("item_id") * 7 + F.col("doc_id") * 13) % 101, "doc_id"))
    hits = cases.withColumn("g", F.floor(F.col("want") / 8)).join(docs, "g").select(F.col("item_id").cast("string").alias("id"), place.alias("rank"), F.col("doc_id").cast("string").alias("slug"), F.lit(1).alias("page_first"), F.lit(1).alias("page_last"), F.lit("").alias("section_text"))
    cases = cases.select(F.col("item_id").cast("string").alias("id"), F.col("want").cast("string").alias("expected_slug"), F.lit(None).cast("string").alias("expected_phrase"), F.lit(None).cast("int").alias("expected_page"))
    return E.hit_rate(E.case_results(cases, hits))


@query("agg16_answerability", r"""WITH c AS (SELECT item_id, item_id * 3 AS doc, lower(text) AS e FROM benchmark),
n AS (SELECT item_id, doc, trim(regexp_replace(e, '\s+', ' ', 'g')) AS e, trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')) AS t FROM c LEFT JOIN documents d ON d.doc_id = doc)
SELECT item_id AS id, CASE WHEN t IS NULL THEN 'missing document' WHEN contains(t, e) AND NOT contains(t, 'idiot') THEN 'passed' ELSE 'failed' END AS status FROM n""")
def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = K.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") * 3).alias("document"), F.array("text").alias("expect"), F.array(F.lit("idiot")).alias("forbid"))
    docs = K.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), "text")
    return E.answerability(cases, docs).select("id", "status")


@query("agg15_satisfiable", W + sql.SECTIONS + r""", c AS (SELECT item_id AS id, 'doc-' || (item_id * 30) AS slug, CASE item_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'zzzz' END AS phrase, CASE WHEN item_id % 2 = 0 THEN 1 END AS page FROM benchmark),
st AS (SELECT s.slug, s.section_index, s.page_first, s.page_last, string_agg(b.text, chr(10) ORDER BY b.ordinal) AS text FROM sections s JOIN blocks b ON b.slug = s.slug AND b.ordinal BETWEEN s.block_first AND s.block_last GROUP BY ALL),
j AS (SELECT c.*, d.slug IS NOT NULL AS known, coalesce(phrase IS NOT NULL AND contains(lower(st.text), phrase), false) AS a, coalesce(page BETWEEN page_first AND page_last, false) AS b FROM c LEFT JOIN docs d USING (slug) LEFT JOIN st USING (slug)),
g AS (SELECT id, bool_or(known) AS known, max(phrase) AS phrase, max(page) AS page, count(*) FILTER (a) AS pa, count(*) FILTER (b) AS pb, count(*) FILTER (a AND b) AS pc FROM j GROUP BY id)
SELECT id, pa AS phrase_sections, pb AS page_sections, pc AS both_sections, CASE WHEN NOT known THEN 'missing slug' WHEN phrase IS NOT NULL AND pa = 0 THEN 'missing phrase' WHEN page IS NOT NULL AND pb = 0 THEN 'missing page' WHEN phrase IS NOT NULL AND page IS NOT NULL AND pc = 0 THEN 'over-constrained' WHEN pa > 3 OR pb > 6 THEN 'weak' ELSE 'ok' END AS verdict FROM g""")
def satisfiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    cases = K.table(spark, sf_dir, "benchmark").select(i.alias("id"), F.concat(F.lit("doc-"), (i * 30).cast("string")).alias("expected_slug"), F.when(i % 3 == 0, "the").when(i % 3 == 1, "zzzz").alias("expected_phrase"), F.when(i % 2 == 0, 1).alias("expected_page"))
    return E.satisfiable(cases, E.section_texts(K.sections(spark, sf_dir), K.blocks(spark, sf_dir)), K.documents(spark, sf_dir).select("slug"))


@query("src12_case_problems", "SELECT item_id // 2 AS id, 'duplicate id' AS problem FROM benchmark GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT item_id // 2, 'no question' FROM benchmark WHERE item_id % 7 = 0 UNION ALL SELECT item_id // 2, 'nothing expected' FROM benchmark WHERE item_id % 5 = 0")
def case_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    cases = K.table(spark, sf_dir, "benchmark").select(F.floor(i / 2).alias("id"), F.when(i % 7 == 0, " ").otherwise("why").alias("question"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("text")).alias("expect"))
    return E.case_problems(cases)


@query("sort1_top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic sort with a tie-break, cut at the clamp of k."""
    return K.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(S.clamped(100))


@query("set1_fields", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'a' END AS missing, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END AS unexpected FROM documents")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("x"))).otherwise(F.array(F.lit("b")))
    want = F.array(F.lit("a"), F.lit("b"))
    missing, unexpected = T.differences(want, have)
    return K.table(spark, sf_dir, "documents").select("doc_id", F.array_join(missing, ",").alias("missing"), F.array_join(unexpected, ",").alias("unexpected"))


@query("join2_hit_sections", W + sql.SECTIONS + " SELECT s.* FROM sections s WHERE section_index = (regexp_extract(slug, '[0-9]+')::INT % 3)")
def hit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = K.documents(spark, sf_dir).select("slug", (F.col("doc_id") % 3).cast("int").alias("section_index"))
    return K.sections(spark, sf_dir).join(keys, ["slug", "section_index"], "left_semi")


@query("join1_chunks_by_class", W.replace("WITH", "WITH RECURSIVE") + sql.CHUNKS + " SELECT text_class, count(*) AS chunks FROM chunks JOIN docs USING (slug) GROUP BY text_class")
def chunks_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(spark, sf_dir).join(K.documents(spark, sf_dir).select("slug", "text_class"), "slug").groupBy("text_class").agg(F.count(F.lit(1)).alias("chunks"))
