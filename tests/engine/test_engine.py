"""Operators of the engine against direct versions on small, made-up inputs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.terms import stem
from corpusloom.operators import blocks as B
from corpusloom.operators import chunks as C
from corpusloom.operators import embed as E
from corpusloom.operators import evals as V
from corpusloom.operators import geometry as G
from corpusloom.operators import lookup as L
from corpusloom.operators import manifest as M
from corpusloom.operators import search as S
from corpusloom.operators import sections as X
from corpusloom.operators import triage as R
from corpusloom.plans import corpus as K
from corpusloom.queries import QUERIES
from corpusloom.sources import files as SF
from corpusloom.sources import markdown as MD
from corpusloom.sources import office as O
from corpusloom.sources import tables as CSV
from corpusloom.streaming import index as I

BLOCKS = "slug string, ordinal int, page int, kind string, level int, text string"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# --- sections and chunks --------------------------------------------------------------------
def random_blocks(rng, docs=40):
    rows = []
    for d in range(docs):
        for i in range(rng.randrange(1, 25)):
            kind = rng.choice(["heading", "heading", "paragraph", "paragraph", "list", "table", "annotation", "boxed_text"])
            text = {"heading": f"## h{i}", "table": "| a | b |\n| --- | --- |\n" + "\n".join(f"| r{k} | {'x' * rng.randrange(1, 60)} |" for k in range(rng.choice([1, 20, 90])))}.get(kind, "word " * rng.choice([1, 40, 200, 700]))
            if kind in ("paragraph", "list") and rng.random() < 0.3:
                text = "\n\n".join(["para " * rng.choice([10, 200])] * rng.randrange(2, 6))
            rows.append((f"d{d}", i, rng.choice([None, 1 + i // 5]), kind, rng.randrange(1, 6) if kind == "heading" else None, text.strip()))
    return rows


def simulated_sections(rows, title="T"):
    out, path = [], {}
    for at, (_, i, _, kind, level, text) in enumerate(rows):
        heads = kind == "heading" and level <= 3
        if heads and out and all(r[3] == "heading" and r[4] <= 3 for r in rows[out[-1]["first"] : at]):
            if level > out[-1]["level"]:
                path[level] = text.lstrip("#").strip()
        elif heads:
            path = {k: v for k, v in path.items() if k < level} | {level: text.lstrip("#").strip()}
            out.append({"first": i, "level": level, "heading": text.lstrip("#").strip()})
        elif not out:
            out.append({"first": i, "level": 0, "heading": None})
        out[-1]["last"] = i
        out[-1]["path"] = " › ".join([title, *(path[k] for k in sorted(path))]) if out[-1]["heading"] else title
    return out


def test_sections_follow_the_rules(spark):
    rows = random_blocks(random.Random(1))
    docs = spark.createDataFrame([(s, "T") for s in sorted({r[0] for r in rows})], "slug string, title string")
    got = X.build_sections(spark.createDataFrame(rows, BLOCKS), docs).orderBy("slug", "section_index").collect()
    want = [(s, x["level"], x["heading"], x["path"], x["first"], x["last"]) for s in sorted({r[0] for r in rows}) for x in simulated_sections([r for r in rows if r[0] == s])]
    assert [(r["slug"], r["level"], r["heading"], r["heading_path"], r["block_first"], r["block_last"]) for r in got] == want


def test_chunks_tile_their_sections_and_both_walks_agree(spark):
    rows = random_blocks(random.Random(2))
    blocks = X.with_section(spark.createDataFrame(rows, BLOCKS)).persist()
    folded, walked = C.build_chunks(blocks).orderBy("slug", "chunk_index").collect(), C.build_chunks(blocks, fold=0).orderBy("slug", "chunk_index").collect()
    assert folded == walked
    kinds = {(r[0], r[1]): r for r in rows}
    by = {}
    for c in folded:
        assert c["text"]
        by.setdefault((c["slug"], c["section_index"]), []).append(c)
        if len(c["text"]) > C.MOST:  # only what cannot be cut is longer
            inside = [kinds[c["slug"], o][3] for o in range(c["block_first"], c["block_last"] + 1)]
            assert len(inside) > 1 or inside[0] != "paragraph" or "\n\n" not in c["text"]
    for chunks in by.values():
        for a, b in zip(chunks, chunks[1:], strict=False):
            assert a["block_last"] <= b["block_first"] <= a["block_last"] + 1


def chunked(spark, *blocks):
    rows = [("d", i, None, kind, 1 if kind == "heading" else None, text) for i, (kind, text) in enumerate(blocks)]
    return [(c["block_first"], c["block_last"], len(c["text"])) for c in C.build_chunks(X.with_section(spark.createDataFrame(rows, BLOCKS))).orderBy("chunk_index").collect()]


def test_chunk_cases(spark):
    table = "| a |\n| --- |\n" + "\n".join("| " + "y" * 96 + " |" for _ in range(60))
    assert chunked(spark, ("heading", "# h"), ("table", "| a |\n| - |\n| b |"), ("paragraph", "after")) == [(0, 1, 22), (2, 2, 5)]
    assert chunked(spark, ("paragraph", "p"), ("table", "| a |"), ("annotation", "n" * 2000), ("paragraph", "q")) == [(0, 0, 1), (1, 2, 2007), (3, 3, 1)]
    assert chunked(spark, ("paragraph", "a" * 1000), ("paragraph", "b" * 200)) == [(0, 1, 1202)]  # the joiner before the candidate is not counted
    assert chunked(spark, ("paragraph", "a" * 1000), ("paragraph", "b" * 201)) == [(0, 0, 1000), (1, 1, 201)]
    assert [c[:2] for c in chunked(spark, ("heading", "# h"), ("paragraph", "z " * 1300 + "\n\n" + "z " * 1300), ("boxed_text", "n"))] == [(0, 0), (1, 1), (1, 1), (2, 2)]
    parts = chunked(spark, ("heading", "# h"), ("table", table), ("annotation", "note"), ("paragraph", "p"))
    assert parts[0][0] == 0 and all(p[2] <= C.MOST + 20 for p in parts) and parts[-1] == (3, 3, 1) and parts[-2][1] == 2


def test_row_pieces_repeat_header_and_one_row(spark):
    text = "| h |\n| --- |\n" + "\n".join(f"| {i} {'x' * 40} |\n continued" for i in range(30))
    parts = one(spark, C.row_pieces(F.lit(text), 400))
    rows = [[r for r in p.split("\n| ")[2:]] for p in parts]
    assert all(p.startswith("| h |\n| --- |\n| ") for p in parts) and all(b[0] == a[-1] for a, b in zip(rows, rows[1:], strict=False))
    assert sum(map(len, rows)) == 30 + len(rows) - 1


def test_table_pieces_have_every_order(spark, tmp_path):
    orders = spark.range(6000).selectExpr("id AS o_orderkey", "id % 600 AS o_custkey", "id / 7 AS o_totalprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["win17_table_pieces"](spark, str(tmp_path)).collect()
    assert sum(r["rows"] - (r["piece"] > 0) for r in got) == 6000 and max(r["piece"] for r in got) > 0  # later pieces repeat a row


# --- blocks, markdown, files ----------------------------------------------------------------
def test_anchored_blocks_round_trip(spark):
    rows = [("d", i, 1 + i // 2, "paragraph", None, f"text {i}\n\nmore") for i in range(5)]
    blocks = B.with_block_ids(spark.createDataFrame(rows, BLOCKS))
    assert [r["block_id"] for r in blocks.orderBy("ordinal").collect()] == ["d:p001:b001", "d:p001:b002", "d:p002:b001", "d:p002:b002", "d:p003:b001"]
    made = B.rendered(blocks).withColumn("body", F.concat(F.lit("before\n"), "body"))
    good, errors = B.anchored_blocks(made, blocks.withColumn("confidence", F.lit(None).cast("string")))
    got = good.orderBy("ordinal").collect()
    assert [r["text"] for r in got] == ["before", *(r[5] for r in rows)] and got[0]["block_id"] == "d:p000:b000" and errors.count() == 0
    _, errors = B.anchored_blocks(made, blocks.where("ordinal < 4").withColumn("confidence", F.lit(None).cast("string")))
    assert [tuple(r) for r in errors.collect()] == [("d", "d:p003:b001", "not in the sidecar")]


def test_normalized_markdown(spark):
    text = "Intro\n| a |\n| - |\n\n\n\nOne ..... 1 Two ....... 22 Three .... 3\nEnd ....... x"
    got = one(spark, T.normalized_markdown(F.lit(text)))
    assert got == "Intro\n\n| a |\n| - |\n\nOne … 1\nTwo … 22\nThree … 3\nEnd … x"
    assert one(spark, T.normalized_markdown(F.lit(got))) == got


def test_markdown_deep_in_documents(spark, tmp_path):
    text = "word " * 100 + "\nOne ..... 1 Two ....... 22 Three .... 3\nt\n| a |\n| - |\n\n\n\nend\n" + "word " * 100
    spark.createDataFrame([(0, text, "s"), (3, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["txt_normalized_markdown"](spark, str(tmp_path)).collect()
    assert all(r["stable"] and "One … 1\nTwo … 22\nThree … 3\nt\n\n| a |\n| - |\n\nend" in r["markdown"] and "Scope … 14" in r["markdown"] for r in got)


def test_notes_deep_in_documents(spark, tmp_path):
    text = "word " * 100 + "\nINCOMPLETE — page(s) 99, 98 lost\n" + "word " * 100
    spark.createDataFrame([(0, text, "s"), (3, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = {r["doc_id"]: r["pages"] for r in QUERIES["txt_incomplete_pages"](spark, str(tmp_path)).collect()}
    assert pages == {0: "1,7,98,99", 3: ""}


def test_markdown_blocks():
    text = "# T\npara\nmore\n\n- a\n- b\n  c\n\n```\n# no\n\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\nTitle\n=====\n<!-- block=x -->\n"
    assert [k for k, _ in MD.blocks_of(text)] == ["heading", "paragraph", "list", "paragraph", "table", "heading", "paragraph"]
    assert MD.blocks_of(text)[-1][1].startswith(" <!--")
    got = MD.convert(b"---\ntitle: A b\ndate: 2024-02-03\n---\n# X\n![i](j)\n")
    assert (got["title"], got["doc_date"], got["images"], got["blocks"][0][1][:7]) == ("A b", "2024-02-03", 1, "```yaml") and MD.convert(b"\xff")["error"]


def test_csv_dialects_and_guards(spark):
    assert CSV.parsed_rows("﻿a;b\n1;2\n;\n") == [["a", "b"], ["1", "2"]] and CSV.parsed_rows("only\nx\n") == [["only"], ["x"]]
    assert one(spark, T.rendered_table(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1\n2")), F.array(F.lit("x"), F.lit("y"), F.lit("z"))))) == "| a | b\\|c |\n| --- | --- |\n| 1 2 |  |\n| x | y |"
    assert [one(spark, T.table_guard(F.lit(c), F.lit(r))) for c, r in ((1, 1), (2, 301), (16, 2), (2, 300))] == ["single column", "too many rows", "too many columns", None]


def test_kb_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("---\ntitle: 'It''s'\nsource_url: null\n---\n\nbody\n")
    (tmp_path / "sub" / "a.provenance.json").write_text('{"content_sha256":"x","blocks":[{"block_id":"b","page":1,"kind":"list"}]}')
    got = SF.kb_files(spark, str(tmp_path))
    r = got.first()
    assert (r["slug"], r["rel_path"], r["body"], r["front"]["source_url"]) == ("sub__a", "sub/a.md", "body", None)
    assert SF.sidecar_blocks(got).first()["kind"] == "list"


def test_office_items(spark):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Title", "Heading1") + p("one", "ListBullet") + p("two", "ListBullet") + p("text") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    files = spark.createDataFrame([("a", "docx", raw.getvalue()), ("b", "docx", b"no"), ("c", "odp", b"")], "doc string, source_format string, content binary")
    items = O.decoded(files)
    assert {r["doc"] for r in items.where("error IS NOT NULL").collect()} == {"b", "c"}
    assert [(r["kind"], r["text"]) for r in O.item_blocks(items).orderBy("ordinal").collect()] == [("heading", "# Title"), ("list", "- one\n- two"), ("paragraph", "text"), ("table", "| c |\n| --- |")]


# --- scalars --------------------------------------------------------------------------------
@pytest.mark.parametrize(("path", "slug"), [("a/B c.pdf", "a__b-c-pdf"), ("x.tar.gz", "x-tar-gz"), ("--/..", "document")])
def test_slugs(spark, path, slug):
    assert one(spark, T.slug_of(M._with_extension(F.lit(path)))) == slug


def test_ids(spark):
    for key in ("doc:a-b__c", "sec:a:3", "page:a:p012", "page:a:p1234", "chunk:a:0"):
        kind, s, n = L.parse_key(key)
        assert tuple(one(spark, T.parsed_key(F.lit(key)))) == (kind, s, n)
    for key in ("page:a:p12", "sec:A:1", "x:a", "doc:a:1"):
        assert one(spark, T.parsed_key(F.lit(key))) is None
        with pytest.raises(ValueError):
            L.parse_key(key)


def test_stems():
    assert [stem(w) for w in ("caresses", "ponies", "hopping", "relational", "agreed", "happy", "generalizations", "oscillators", "4g")] == ["caress", "poni", "hop", "relat", "agre", "happi", "gener", "oscil", "4g"]


# --- search ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def kb(spark):
    texts = ["# Travel\nRates for travel are paid daily. FORM-7731 applies.\n# Leave\nStaff may take leave.", "# Budget\nThe travel budget is fixed.\nOther rates exist."]
    docs = spark.createDataFrame([Row(slug=f"doc-{i}", title=f"Doc {i}", rel_path=f"d{i}.md", source_file=f"d{i}.pptx", source_format="pptx", doc_date="UNCONFIRMED", text_class=["clean", "partial"][i], chars=len(t), kb_sha256=str(i), body=t) for i, t in enumerate(texts)])
    return {k: v.persist() for k, v in K.built(docs).items()}


def embed(_):
    return [1.0] + [0.0] * 7


def test_lexical_leg(kb):
    find = lambda q: None if (x := S.lexical_leg(kb["postings"], q)) is None else {r["slug"] for r in x.collect()}
    assert find("travelling rate") >= {"doc-0"} and find('"rates for travel"') == set() and find('"travel budget"') == {"doc-1"}
    assert find("travel -budget") == {"doc-0"} and find("leave or budget") == {"doc-0", "doc-1"} and find("form-7731") == {"doc-0"} and find("the of") is None


def test_search_legs(kb):
    hits = S.search(kb, "travel rates", embed).collect()
    assert hits and hits == sorted(hits, key=lambda r: (-r["score"], r["slug"], r["section_index"]))
    assert {r["slug"] for r in S.search(kb, "travel", embed, leg="lexical", text_class="partial").collect()} == {"doc-1"}
    assert all(r["lexical_rank"] is None for r in S.search(kb, "the of", embed).collect())
    assert S.search(kb, "the", embed, leg="lexical").count() == 0
    with pytest.raises(ValueError):
        S.search(kb, "x", embed, leg="other")
    assert [S.clamped(k) for k in (0, 8, 99)] == [1, 8, 25]


def test_lookups(kb):
    r = L.fetch(kb, "doc:doc-0").first()
    assert r["truncated"] is False and "Staff may take leave." in r["text"] and "slides 1–1" in r["citation"]
    assert L.get_section(kb, "page:doc-0:p001").first()["kind"] == "sec" and L.fetch(kb, "sec:doc-1:0", most_chars=10).first()["truncated"]
    for key in ("sec:doc-0:99", "doc:nope", "page:doc-0:p044", "chunk:doc-0:77"):
        with pytest.raises(ValueError):
            L.fetch(kb, key)
    lines = L.outline(kb).withColumn("line", F.lit("x" * 50))
    assert L.bounded_outline(lines, 60).groupBy("slug").count().where("count <> 1").count() == 0


# --- others ---------------------------------------------------------------------------------
def test_triage(spark):
    good, odd = "word " * 100, "�" * 300
    pages = [("clean", i, good) for i in range(5)] + [("scan", i, "") for i in range(3)] + [("mixed", i, good if i else "x") for i in range(4)] + [("moji", 1, odd)]
    docs = spark.createDataFrame([(s,) for s in ("clean", "scan", "mixed", "moji", "none")], "slug string")
    got = {r["slug"]: r for r in R.triage_pages(spark.createDataFrame(pages, "slug string, page int, text string"), docs).collect()}
    assert {k: r["text_class"] for k, r in got.items()} == {"clean": "clean", "scan": "needs_ocr", "mixed": "partial", "moji": "needs_ocr", "none": "error"}
    assert got["mixed"]["low_pages"] == [0] and got["moji"]["alpha_ratio"] == 0.0 and got["none"]["low_fraction"] is None


def test_embedding_batches_retry_and_shrink():
    assert E.batches([10, 30_000, 20_000, 50_000, 1]) == [(0, 2), (2, 3), (3, 4), (4, 5)] and len(E.batches([1] * 65)) == 3
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise E.Transient
        if any(len(t) > 1000 for t in texts):
            raise E.TooLong
        return [[1.0, 0.0]] * len(texts)

    vectors, kept = E.embedded_texts(flaky, ["a" * 3000, "b"], 2, pause=0)
    assert len(vectors) == 2 and kept == [948, 1]
    with pytest.raises(ValueError):
        E.embedded_texts(lambda t: [[1.0]], ["x"], 2, pause=0)


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", "s", "In  Here", 2), ("b", "s", None, None), ("c", "t", None, 9)], "id string, expected_slug string, expected_phrase string, expected_page int")
    hits = spark.createDataFrame([("a", 1, "s", 1, 3, "x in here y"), ("b", 6, "s", 1, 1, ""), ("c", 1, "t", 1, 3, "")], "id string, rank int, slug string, page_first int, page_last int, section_text string")
    results = V.case_results(cases, hits)
    assert {r["id"]: r["rank"] for r in results.collect()} == {"a": 1, "b": None, "c": None}
    assert V.hit_rate(results.where("false")).first()["rate"] == 0.0


def test_hits_come_from_all_documents(spark, tmp_path):
    spark.range(40, 1040).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(50).withColumnRenamed("id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i: i * 7919 % 1040 for i in range(50)}
    place = {i: sorted((d for d in range(40, 1040) if d // 8 == w // 8), key=lambda d: ((i * 7 + d * 13) % 101, d)) for i, w in want.items()}
    hits = sum(w in place[i][:5] for i, w in want.items())
    got = QUERIES["agg11_hit_rate"](spark, str(tmp_path)).first()
    assert (got["cases"], got["hits"]) == (50, hits) and hits > 0  # with ids below 40 alone there is none


def test_incremental_index_and_stream(spark, tmp_path):
    root = f"file://{tmp_path}/index"

    def build(files):
        docs = files.select("slug", F.col("slug").alias("title"), "kb_sha256", F.lit("clean").alias("text_class"), "body")
        return {k: v for k, v in K.built(docs).items() if k in I.TABLES}

    def run(rows):
        df = spark.createDataFrame(rows, "slug string, kb_sha256 string, body string")
        return {r["slug"]: r["action"] for r in I.update(spark, df, build, root).collect()}

    a, b, c = ("a", "1", "# A\ntext a"), ("b", "1", "# B\ntext b"), ("c", "1", "text c")
    assert run([a, b]) == {"a": "indexed", "b": "indexed"} and run([a, b]) == {"a": "unchanged", "b": "unchanged"}
    assert run([("a", "2", "# A\nnew"), c]) == {"a": "reindexed", "b": "deleted", "c": "indexed"}
    now = I.read_index(spark, root)
    assert sorted(r["slug"] for r in now["documents"].collect()) == ["a", "c"]
    assert [r["text"] for r in now["blocks"].where("slug = 'a'").orderBy("ordinal").collect()] == ["# A", "new"]
    source = f"{tmp_path}/in"
    spark.createDataFrame([("d", "1", "text d"), ("a", "3", "last")], "slug string, kb_sha256 string, body string").write.parquet(source)
    stream = spark.readStream.schema("slug string, kb_sha256 string, body string").parquet(source)
    I.start(spark, stream, build, root, f"{tmp_path}/check").awaitTermination()
    now = I.read_index(spark, root)
    assert sorted(r["slug"] for r in now["documents"].collect()) == ["a", "c", "d"] and now["blocks"].where("slug = 'a'").first()["text"] == "last"


def test_page_geometry(spark):
    rows = []

    def line(page, top, text, x=50.0, size=10.0, font="Sans"):
        for w in text.split(" "):
            rows.append(("d", page, x, x + 5.0 * len(w), float(top), top + size, size, font, w))
            x += 5.0 * len(w) + 4

    for page in (1, 2, 3):
        line(page, 10, f"Running head {page}")
        line(page, 100, "Big heading", size=18.0)
        line(page, 130, "First line of a paragraph that")
        line(page, 142, "goes on here")
        line(page, 180, "• one")
        line(page, 192, "• two")
        for k in range(3):
            for c in range(2):
                line(page, 240 + 12 * k, f"c{k}{c}", x=50.0 + 200 * c)
    words = spark.createDataFrame(rows, "doc string, page int, x0 double, x1 double, top double, bottom double, size double, fontname string, text string")
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in (1, 2, 3)], "doc string, page int, width double, height double")
    got = G.text_blocks(words, pages).where("page = 2").orderBy("seq").collect()
    assert [(r["kind"], r["text"]) for r in got] == [
        ("heading", "# Big heading"), ("paragraph", "First line of a paragraph that goes on here"), ("list", "- one\n- two"), ("table", "| c00 | c01 |\n| --- | --- |\n| c10 | c11 |\n| c20 | c21 |"),
    ]


def _zip(parts):
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_slides_in_the_order_of_the_presentation(spark):
    """Order, charts, SmartArt and notes by relationships; ODP the same way."""
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:dgm="http://schemas.openxmlformats.org/drawingml/2006/diagram"'
    rels = lambda **t: "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in t.items()) + "</Relationships>"
    slide = lambda title, more="": f'<p:sld {ns}><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:sp>{more}</p:sld>'
    point = lambda k, v: f'<c:pt idx="{k}"><c:v>{v}</c:v></c:pt>'
    pptx = _zip({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/><p:sldId r:id="gone"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(a="slides/slide1.xml", b="slides/slide2.xml", gone="slides/slide9.xml"),
        "ppt/slides/slide1.xml": slide("Second"),
        "ppt/slides/slide2.xml": slide("First", '<c:chart r:id="c"/><dgm:relIds r:dm="d"/>'),
        "ppt/slides/_rels/slide2.xml.rels": rels(c="../charts/chart1.xml", d="../diagrams/data1.xml", n="../notesSlides/notesSlide7.xml"),
        "ppt/charts/chart1.xml": f"<c:chartSpace {ns}><c:ser><c:tx>{point(0, 'sales')}</c:tx><c:cat>{point(0, 'Q1')}{point(1, 'Q2')}</c:cat><c:val>{point(0, 3)}{point(1, 4)}</c:val></c:ser></c:chartSpace>",
        "ppt/diagrams/data1.xml": f"<dgm:dataModel {ns}><dgm:pt><a:t>plan</a:t></dgm:pt><dgm:pt/><dgm:pt><a:t>do</a:t></dgm:pt></dgm:dataModel>",
        "ppt/notesSlides/notesSlide7.xml": f"<p:notes {ns}><a:t>say this</a:t></p:notes>",
    })
    u = "urn:oasis:names:tc:opendocument:xmlns"
    odp = _zip({"content.xml": f'<d xmlns:t="{u}:text:1.0" xmlns:b="{u}:table:1.0" xmlns:w="{u}:drawing:1.0" xmlns:s="{u}:presentation:1.0"><w:page><w:frame s:class="title"><t:p>Head</t:p></w:frame><w:frame><t:list><t:list-item><t:p>one</t:p><t:list><t:list-item><t:p>deep</t:p></t:list-item></t:list></t:list-item></t:list><b:table><b:table-row><b:table-cell><t:p>x</t:p></b:table-cell><b:table-cell><t:p>y</t:p></b:table-cell></b:table-row></b:table></w:frame></w:page></d>'})
    files = spark.createDataFrame([("p", "pptx", bytearray(pptx)), ("o", "odp", bytearray(odp)), ("bad", "pptx", bytearray(b"no zip"))], "doc string, source_format string, content binary")
    items = O.decoded(files)
    assert [r["doc"] for r in items.where("error IS NOT NULL").collect()] == ["bad"]
    got = defaultdict(list)
    for r in O.item_blocks(items).orderBy("slug", "ordinal").collect():
        got[r["slug"]].append((r["page"], r["kind"], r["text"]))
    assert got["p"] == [(1, "heading", "## First"), (1, "table", "|  | sales |\n| --- | --- |\n| Q1 | 3 |\n| Q2 | 4 |"), (1, "list", "- plan\n- do"), (1, "paragraph", "Notes: say this"), (2, "heading", "## Second")]
    assert got["o"] == [(1, "heading", "## Head"), (1, "list", "- one\n  - deep"), (1, "table", "| x | y |\n| --- | --- |")]


def test_list_markers(spark):
    """A marker, white space and something after it; letters, three digits and bare dashes are text."""
    texts = ["- a", "– a", "— a", "‣ a", "· a", "* a", "12) a", "(3) a", "4. a", "a. b", "a) b", "123. a", "-", "--", "- ", "•a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").where(F.col("text").rlike(G.LIST_LINE))
    assert sorted(r["text"] for r in rows.collect()) == sorted(texts[:9])
