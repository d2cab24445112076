"""Queries over scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.terms import plain_tokens, term_counts
from corpusloom.operators import manifest as M
from corpusloom.plans import corpus as K
from corpusloom.plans import sql
from corpusloom.queries import query
from corpusloom.sources import files as S
from corpusloom.sources import tables as C

W = "WITH "


@query("prj1_snippet", r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 300) AS snippet FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("prj2_citation", W + sql.SECTIONS + """, ends AS (SELECT slug, arg_min(block_id, ordinal) AS a, arg_max(block_id, ordinal) AS z FROM blocks GROUP BY slug)
SELECT slug, section_index, title || ', ' || heading_path || ' (source: ' || source_file || ', ' || CASE WHEN source_format = 'pptx' THEN 'slides' ELSE 'pages' END || ' ' || page_first || '–' || page_last || ', dated ' || doc_date || '; blocks ' || a || '…' || z || ')' AS citation
FROM sections JOIN docs USING (slug) JOIN ends USING (slug)""")
def citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = K.blocks(spark, sf_dir).groupBy("slug").agg(F.min_by("block_id", "ordinal").alias("a"), F.max_by("block_id", "ordinal").alias("z"))
    rows = K.sections(spark, sf_dir).join(K.documents(spark, sf_dir).drop("body"), "slug").join(ends, "slug")
    c = [F.col(x) for x in ("title", "heading_path", "source_file", "source_format", "page_first", "page_last", "doc_date", "a", "z")]
    return rows.select("slug", "section_index", T.citation(*c).alias("citation"))


@query("prj3_ids", """SELECT doc_id, 'doc:doc-' || doc_id AS doc_key, 'page:doc-' || doc_id || ':p' || lpad((doc_id % 1500)::VARCHAR, greatest(3, length((doc_id % 1500)::VARCHAR))::INT, '0') AS page_key, 'page' AS kind, 'doc-' || doc_id AS slug, doc_id % 1500 AS n FROM documents""")
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    rows = K.table(spark, sf_dir, "documents").select("doc_id", T.doc_key(slug).alias("doc_key"), T.page_key(slug, F.col("doc_id") % 1500).alias("page_key"))
    return rows.withColumn("p", T.parsed_key(F.col("page_key"))).select("doc_id", "doc_key", "page_key", "p.kind", "p.slug", "p.n")


@query("prj4_section_title", W + sql.SECTIONS + " SELECT slug, section_index, heading_path AS title, 'https://kb/' || rel_path || '#block=' || slug || ':p001:b001' AS url FROM sections JOIN docs USING (slug)")
def section_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.sections(spark, sf_dir).join(K.documents(spark, sf_dir).select("slug", "title", "rel_path"), "slug")
    return rows.select("slug", "section_index", T.section_title(F.col("title"), F.col("heading_path")).alias("title"), T.file_url("https://kb", F.col("rel_path"), F.concat("slug", F.lit(":p001:b001"))).alias("url"))


@query("prj5_landmark", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
k AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN '' WHEN starts_with(l[1], '|') THEN l[-1] ELSE l[1] END AS x FROM l) SELECT doc_id, CASE WHEN length(x) > 110 THEN substr(x, 1, 109) || '…' ELSE x END AS landmark FROM k""")
def landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "documents").select("doc_id", T.landmark(F.col("text")).alias("landmark"))


@query("txt_heading", W + sql.BLOCKS + r", x AS (SELECT slug, ordinal, CASE ordinal % 4 WHEN 0 THEN '## ' || text WHEN 1 THEN text || chr(10) || '===' WHEN 2 THEN text || chr(10) || '---' ELSE text END AS h FROM blocks WHERE kind = 'heading' AND NOT contains(text, '#')) SELECT slug, ordinal, CASE ordinal % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS level, trim(regexp_replace(string_split(h, chr(10))[1], '^#{1,6}\s*', '')) AS heading FROM x")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("ordinal") % 4
    h = F.when(r == 0, F.concat(F.lit("## "), "text")).when(r == 1, F.concat("text", F.lit("\n==="))).when(r == 2, F.concat("text", F.lit("\n---"))).otherwise(F.col("text"))
    rows = K.blocks(spark, sf_dir).where("kind = 'heading' AND NOT contains(text, '#')").withColumn("h", h)
    return rows.select("slug", "ordinal", T.heading_level(F.col("h")).alias("level"), T.heading_text(F.col("h")).alias("heading"))


@query("txt_margin_key", r"SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text || ' page ' || doc_id), '\s+', ' ', 'g')), '\d+', '#', 'g') AS key FROM documents")
def margin_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "documents").select("doc_id", T.margin_key(F.concat("text", F.lit(" page "), F.col("doc_id").cast("string"))).alias("key"))


@query("txt_normalized_markdown")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders, tables after text and blank runs, planted behind whole documents; a second pass changes nothing."""
    d = K.table(spark, sf_dir, "documents")
    planted = F.concat("text", F.lit("\n| a | b |\n| --- | --- |\n\n\n\nIntro ........ 3 Scope ........ 14 Rules ..... 20\n"))
    once = T.normalized_markdown(planted)
    return d.select("doc_id", once.alias("markdown")).withColumn("stable", F.col("markdown") == T.normalized_markdown(F.col("markdown")))


@query("txt_incomplete_pages", "SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN '' ELSE (doc_id % 4 + 1) || ',' || (doc_id % 4 + 7) END AS pages FROM documents")
def incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.documents(spark, sf_dir)
    a, b = (F.col("doc_id") % 4 + 1).cast("string"), (F.col("doc_id") % 4 + 7).cast("string")
    note = F.concat(F.lit("> INCOMPLETE — page(s) "), b, F.lit(", "), a, F.lit(" have no text.\n"), F.col("body"), F.lit("\nINCOMPLETE — page(s) "), a)
    return d.select("doc_id", F.array_join(T.incomplete_pages(note, F.col("source_format")).cast("array<string>"), ",").alias("pages"))


@query("txt_prettify", W + sql.DOCS + " SELECT doc_id, 'Travel RATES ' || doc_id || ' File' AS title FROM docs")
def prettify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.documents(spark, sf_dir).select("doc_id", M.title_of(F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("a/b/travel_RATES-"), F.col("doc_id").cast("string"), F.lit("_file.v2"))).alias("title"))


@query("txt_terms")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(K.texts(spark, sf_dir))


@query("txt_plain_tokens", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY token")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "documents").select(F.explode(plain_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("fmt1_formats", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '-' ELSE doc_id::VARCHAR END AS number, CASE WHEN doc_id % 4 = 0 THEN '-' ELSE printf('%.1f%%', (doc_id % 1000) / 7.0) END AS percent FROM documents")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return K.table(spark, sf_dir, "documents").select("doc_id", T.number_or_dash(F.when(i % 3 != 0, i)).alias("number"), T.percent(F.when(i % 4 != 0, i % 1000 / 700.0)).alias("percent"))


_RENDER = "SELECT string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT -2 AS i, '| n_nationkey | n_name | n_regionkey |' AS line UNION ALL SELECT -1, '| --- | --- | --- |' UNION ALL SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' FROM nation)"


def _nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = K.table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("r"))
    rows = n.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "r")))["r"].alias("r"))
    return rows.select(F.concat(F.array(F.array(F.lit("n_nationkey"), F.lit("n_name"), F.lit("n_regionkey"))), "r").alias("rows"))


@query("src4_table_render", _RENDER)
def table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_rows(spark, sf_dir).select(T.rendered_table(F.col("rows")).alias("text"))


@query("src14_csv_blocks", "WITH t AS (" + _RENDER + ") SELECT 0 AS ordinal, 'heading' AS kind, '# Nation' AS text, NULL AS problem UNION ALL SELECT 1, 'paragraph', 'All of them.', NULL UNION ALL SELECT 2, 'table', text, NULL FROM t")
def csv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_rows(spark, sf_dir).select("rows", F.lit("nation").alias("slug"), F.lit("x/nation.csv").alias("source_file"), F.lit(None).cast("string").alias("title"), F.lit("All of them.").alias("description"), F.lit("table").alias("csv_mode"))
    return C.csv_blocks(rows).drop("slug")


@query("src4_csv_parse", "SELECT n_nationkey::VARCHAR AS k, n_name AS name FROM nation")
def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semicolon file with a mark of its encoding, parsed with a guessed dialect."""
    n = K.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(";\""), "n_name", F.lit('"')).alias("line"))
    text = n.agg(F.array_join(F.sort_array(F.collect_list(F.struct("n_nationkey", "line")))["line"], "\n").alias("t"))
    files = text.select(F.lit("nation.csv").alias("source_file"), F.concat(F.unhex(F.lit("EFBBBF")), F.concat(F.lit("k;name\n"), "t", F.lit("\n\n;\n")).cast("binary")).alias("content"))
    return C.csv_rows(files).select(F.explode(F.slice("rows", 2, 1000)).alias("r")).select(F.col("r")[0].alias("k"), F.col("r")[1].alias("name"))


@query("pred2_csv_guard", """SELECT c_nationkey AS k, CASE WHEN c_nationkey % 20 + 1 < 2 THEN 'single column' WHEN count(*) > 8 THEN 'too many rows' WHEN c_nationkey % 20 + 1 > 15 THEN 'too many columns' END AS problem FROM customer GROUP BY c_nationkey""")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = K.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("k", T.table_guard(F.col("k") % 20 + 1, F.col("n"), most_rows=8).alias("problem"))


_META = """m AS (SELECT slug, doc_id, CASE WHEN doc_id % 10 = 1 THEN ' ' ELSE title END AS title, CASE WHEN doc_id % 10 = 2 THEN '/abs' ELSE source_file END AS source_file, CASE WHEN doc_id % 10 = 3 THEN 'xls' ELSE source_format END AS source_format,
CASE WHEN doc_id % 10 = 4 THEN '2024' ELSE doc_date END AS doc_date, (text_class = 'needs_ocr') <> (doc_id % 10 = 5) AS needs_ocr, CASE WHEN doc_id % 10 = 6 THEN 'good' ELSE text_class END AS text_class, CASE WHEN doc_id % 10 = 7 THEN 'abc' ELSE kb_sha256 END AS sha FROM docs)"""


@query("pred1_front_matter", W + sql.DOCS + ", " + _META + """ SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'title' WHEN 2 THEN 'source_file' WHEN 3 THEN 'source_format' WHEN 4 THEN 'doc_date' WHEN 5 THEN 'needs_ocr contradicts text_class' WHEN 6 THEN 'text_class' WHEN 7 THEN 'content_sha256' WHEN 8 THEN 'unexpected fields' WHEN 9 THEN 'missing fields;converter' ELSE '' END AS problems FROM m""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = K.documents(spark, sf_dir), F.col("doc_id") % 10
    values = {
        "title": F.when(r == 1, " ").otherwise(F.col("title")), "source_file": F.when(r == 2, "/abs").otherwise(F.col("source_file")), "source_format": F.when(r == 3, "xls").otherwise(F.col("source_format")),
        "source_url": F.lit(None).cast("string"), "doc_date": F.when(r == 4, "2024").otherwise(F.col("doc_date")), "retrieved": F.lit(None).cast("string"), "converter": F.when(r != 9, "lines"),
        "text_coverage": F.lit("10.5"), "text_class": F.when(r == 6, "good").otherwise(F.col("text_class")), "needs_ocr": ((F.col("text_class") == "needs_ocr") != (r == 5)).cast("string"), "content_sha256": F.when(r == 7, "abc").otherwise(F.col("kb_sha256")),
    }
    names = F.array(*(F.lit(f) for f in T.FRONT_FIELDS))
    there = F.when(r == 9, F.array_remove(names, "converter")).when(r == 8, F.array_append(names, F.lit("extra"))).otherwise(names)
    return d.select("doc_id", F.array_join(T.front_matter_problems(there, values.__getitem__), ";").alias("problems"))


@query("src13_front_round_trip", W + sql.DOCS + " SELECT slug, title, doc_date, CASE WHEN text_class = 'needs_ocr' THEN 'true' ELSE 'false' END AS needs_ocr, NULL AS retrieved FROM docs")
def front_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    meta = S.built_front(K.documents(spark, sf_dir).drop("body").withColumns({"retrieved": none, "converter": F.lit("lines"), "text_coverage": F.lit(1.5), "content_sha256": F.col("kb_sha256")}))
    read = S.front_matter(meta).select("slug", S.front_map(F.regexp_extract("front", r"(?s)\A---\n(.*?)\n---\n", 1)).alias("f"))
    return read.select("slug", "f.title", "f.doc_date", "f.needs_ocr", "f.retrieved")


@query("agg2_alpha_ratio", r"SELECT doc_id, CASE WHEN length(t) = 0 THEN 0 ELSE length(regexp_replace(t, '[\p{L}\p{N}\s!-/:-@\[-`{-~]', '', 'g'))::DOUBLE END AS good FROM (SELECT doc_id, text || repeat(chr(65533), (doc_id % 5)::INT) AS t FROM documents)")
def alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.repeat(F.lit("\ufffd"), (F.col("doc_id") % 5).cast("int")))
    return K.table(spark, sf_dir, "documents").select("doc_id", F.when(F.length(t) == 0, 0.0).otherwise(F.round(F.length(t) * (1 - T.alpha_ratio(t)))).alias("bad")).select("doc_id", F.col("bad").alias("good"))
