"""Plans that stay within a row or a document, and rows that do not depend on how they were reached."""

from pyspark.sql import functions as F

from corpusloom.functions import terms as W
from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import geometry as G
from corpusloom.operators import lookup as L
from corpusloom.operators import search as S
from corpusloom.plans import corpus as K
from corpusloom.queries import QUERIES


def documents(spark, path, n=6, words=700):
    rows = [(i, " ".join(f"w{i}x{k}" + ("\n" if k % 37 == 0 else "") for k in range(words * (i % 3))), "s") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_queries_shuffle_texts_alone(spark, tmp_path):
    """the one exchange deals the texts; no word is shuffled."""
    at = documents(spark, tmp_path)
    for name in ("win7_lines", "win8_rejoined", "win10_cells"):
        got = plan(QUERIES[name](spark, at))
        assert got.count("Exchange hashpartitioning") == 1 and "Window" not in got, name


def test_arrays_and_rows_of_words_agree(spark, tmp_path):
    """both forms give the same lines and blocks."""
    at = documents(spark, tmp_path)
    words, pages = K.words(spark, at), K.word_pages(spark, at)
    rows = lambda df: sorted(map(str, df.select("doc", "page", "line", "top", "x0", "x1", "size", "bold", "text").collect()))
    assert rows(G.lines(G.with_lines(words))) == rows(G.lines(G.page_lines(pages))) and pages.count() == 10
    sizes = pages.select("doc", "page").withColumns({"width": F.lit(540.0), "height": F.lit(760.0)})
    blocks = lambda w: sorted(map(str, G.text_blocks(w, sizes).collect()))
    assert blocks(words) == blocks(pages)


def test_page_order_without_join(spark):
    """marks of two columns count once, pages without blocks give nothing."""
    b = spark.createDataFrame([("d", 1, 1, "annotation", 1.0), ("d", 1, 2, "paragraph", 9.0), ("d", 2, 1, "annotation", 9.0), ("d", 2, 2, "paragraph", 1.0)], "doc string, page int, seq int, kind string, top double")
    got = G.page_order(b, spark.createDataFrame([("d", 1), ("d", 1), ("x", 5)], "doc string, page int"))
    assert {(r["page"], r["seq"]): r["place"] for r in got.collect()} == {(1, 2): 1, (1, 1): 2, (2, 2): 1, (2, 1): 2} and "Join" not in plan(got)


def test_tables_are_made_on_demand(spark, tmp_path):
    """A listing makes no chunks and no postings."""
    kb = K.stored_kb(spark, documents(spark, tmp_path))
    assert L.list_documents(kb).count() == 6 and kb.there == {"documents", "sections"}
    assert {(r["slug"], r["section_index"]): r["chars"] for r in L.section_chars(kb).collect()} and kb.there == {"documents", "sections", "blocks"}
    kb = {"sections": spark.createDataFrame([("d", 0, 0, 1), ("d", 1, 2, 2), ("e", 0, 0, 0)], "slug string, section_index int, block_first int, block_last int"), "blocks": spark.createDataFrame([("d", 0, "ab"), ("d", 1, "c"), ("d", 2, "")], "slug string, ordinal int, text string")}
    got = L.section_chars(kb)
    assert {tuple(r) for r in got.collect()} == {("d", 0, 5), ("d", 1, 0), ("e", 0, 0)} and "BETWEEN" not in plan(got).upper() and "ordinal#" in plan(got).split("Join")[1].split("\n")[0]


def test_terms_where_the_texts_are(spark, monkeypatch):
    """Bounded counts add up, and postings need no shuffle."""
    monkeypatch.setattr(W, "MOST_COUNTED", 2)
    texts = spark.createDataFrame([("Dogs and dog, rates",), (None,), ("dog the of",)], "text string")
    assert {tuple(r) for r in W.term_counts(texts).collect()} == {("dog", 3), ("rate", 1)}
    chunks = spark.createDataFrame([("d", 0, 0, None, "b a b"), ("e", 1, 0, 3, None), ("e", 2, 0, 3, "b")], "slug string, chunk_index int, section_index int, page_first int, text string").coalesce(1)
    got = S.postings(chunks)
    assert [(r["term"], r["slug"], r["chunk_index"], r["page_first"], r["positions"]) for r in got.collect()] == [("b", "d", 0, None, [1, 3]), ("b", "e", 2, 3, [1])]
    assert "hashpartitioning" not in plan(got)


def test_expressions_do_not_repeat_their_input(spark):
    """one digest and one list of rows in the plan, however many numbers and rows."""
    df = spark.createDataFrame([("x",)], "t string")
    assert plan(df.select(F.explode(S.hash_vector(F.col("t"))))).split("\n\n")[0].count("sha2(") <= 2
    assert str(T.rendered_table(F.col("big_list"))).count("big_list") == 1 and str(C.row_pieces(F.col("big_text"))).count("big_text") == 1


def test_bodies_in_their_own_row(spark):
    """No window or shuffle splits a body; ids that come twice are met as before."""
    from corpusloom.operators import blocks as B

    bodies = spark.createDataFrame([("d", "a\n# H\nb\n\nc"), ("t", "| a |\n| b |"), ("n", "")], "slug string, body string")
    got = B.fallback_blocks(bodies)
    assert sorted((r["slug"], r["ordinal"], r["kind"], r["level"], r["text"]) for r in got.collect()) == [("d", 0, "paragraph", None, "a"), ("d", 1, "heading", 1, "# H"), ("d", 2, "paragraph", None, "b\n\nc"), ("t", 0, "table", None, "| a |\n| b |")]
    assert "Exchange" not in plan(got) and "Window" not in plan(got)
    body = spark.createDataFrame([("d", "<!-- block=x -->\none\n\n<!-- block=x -->\ntwo"), ("e", "<!-- block=y -->\nz")], "slug string, body string")
    side = spark.createDataFrame([("d", "x", 1, "list", None), ("e", "q", 1, "list", None)], "slug string, block_id string, page int, kind string, confidence string")
    good, errors = B.anchored_blocks(body, side)
    assert [(r["ordinal"], r["block_id"], r["page"], r["kind"], r["text"]) for r in good.orderBy("ordinal").collect()] == [(0, "x", 1, "list", "one"), (1, "x", 1, "list", "two")]
    assert sorted(map(tuple, errors.collect())) == [("e", "q", "not in the body"), ("e", "y", "not in the sidecar")]
