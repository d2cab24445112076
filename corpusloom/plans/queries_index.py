"""Queries over files, manifests, blocks, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import blocks as B
from corpusloom.operators import chunks as C
from corpusloom.operators import embed as EM
from corpusloom.operators import lookup as L
from corpusloom.operators import manifest as M
from corpusloom.operators import sections as X
from corpusloom.plans import corpus as K
from corpusloom.plans import sql
from corpusloom.queries import query

W = "WITH "


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk here: one for each document, some hidden, some of unknown extensions."""
    d = K.documents(spark, sf_dir)
    hidden = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit(".cache/"), "source_file")).otherwise(F.col("source_file"))
    path = F.when(F.col("doc_id") % 13 == 0, F.concat("source_file", F.lit(".tmp"))).otherwise(hidden)
    return d.select(path.alias("source_file"), F.col("kb_sha256").alias("sha256"), F.col("chars").alias("size_bytes"), "doc_id")


_FILES = sql.DOCS + ", files AS (SELECT CASE WHEN doc_id % 13 = 0 THEN source_file || '.tmp' WHEN doc_id % 11 = 0 THEN '.cache/' || source_file ELSE source_file END AS source_file, kb_sha256 AS sha256, chars AS size_bytes, doc_id FROM docs)"
_SLUG = "regexp_replace(regexp_replace(lower(regexp_replace({0}, '\\.([^./]+)$', '-\\1')), '[^a-z0-9/]+', '-', 'g'), '-*/-*', '__', 'g')"
_SHOWN = _FILES + ", shown AS (SELECT *, regexp_extract(source_file, '^.+(\\.[^./]+)$', 1) AS ext FROM files WHERE NOT regexp_matches(source_file, '(^|/)\\.[^/]'))"
_KNOWN = "('.pdf', '.docx', '.doc', '.csv', '.md', '.pptx', '.ppt', '.odp')"


@query("src1_inventory", W + _SHOWN + f", good AS (SELECT source_file, substr(ext, 2) AS source_format, trim({_SLUG.format('source_file')}, '-') AS slug, sha256, size_bytes FROM shown WHERE ext IN {_KNOWN}) SELECT * FROM good")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.inventory(_files(spark, sf_dir))[0]


@query("src1_skipped_extensions", W + _SHOWN + f" SELECT lower(ext) AS extension, count(*) AS files FROM shown WHERE ext NOT IN {_KNOWN} GROUP BY 1")
def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.inventory(_files(spark, sf_dir))[1]


@query("src2_sha256", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("src6_fallback_blocks", r"""
WITH b AS (SELECT 'doc-' || doc_id AS slug, CASE WHEN doc_id % 4 = 0 THEN '| ' || replace(text, chr(10), chr(10) || '| ') ELSE '# Head' || chr(10) || replace(text, '. ', '.' || chr(10) || '## Part' || chr(10)) END AS body FROM documents),
t AS (SELECT slug, regexp_replace(regexp_replace(body, '^\n+', ''), '\n+$', '') AS body FROM b),
k AS (SELECT slug, body, string_split(body, chr(10)) AS l FROM t),
f AS (SELECT *, len(list_filter(l, lambda x: trim(x) <> '')) >= 2 AND len(list_filter(l, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '|'))) = 0 AS single FROM k),
x AS (SELECT slug, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM f WHERE NOT single),
h AS (SELECT *, regexp_matches(line, '^#{1,3}\s+\S') AS head FROM x),
o AS (SELECT *, sum((head OR coalesce(lag_head, true))::INT) OVER (PARTITION BY slug ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(head) OVER (PARTITION BY slug ORDER BY pos) AS lag_head FROM h)),
r AS (SELECT slug, run, bool_or(head) AS head, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\n+', ''), '\n+$', '') AS text FROM o GROUP BY slug, run),
n AS (SELECT slug, (row_number() OVER (PARTITION BY slug ORDER BY run) - 1)::INT AS ordinal, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN head THEN length(regexp_extract(text, '^(#+)', 1))::INT END AS level, text FROM r WHERE trim(regexp_replace(text, '\s+', '', 'g')) <> ''),
a AS (SELECT slug, 0 AS ordinal, 'table' AS kind, NULL::INT AS level, body AS text FROM f WHERE single UNION ALL SELECT * FROM n)
SELECT slug, ordinal, slug || ':p000:b' || lpad((ordinal + 1)::VARCHAR, greatest(CASE WHEN count(*) OVER (PARTITION BY slug) >= 1000 THEN 4 ELSE 3 END, length((ordinal + 1)::VARCHAR))::INT, '0') AS block_id, kind, level, sha256(text) AS text FROM a
""")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.texts(spark, sf_dir)
    tabled = F.concat(F.lit("| "), F.replace("text", F.lit("\n"), F.lit("\n| ")))
    headed = F.concat(F.lit("# Head\n"), F.replace("text", F.lit(". "), F.lit(".\n## Part\n")))
    bodies = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.when(F.col("doc_id") % 4 == 0, tabled).otherwise(headed).alias("body"))
    return B.fallback_blocks(bodies).select("slug", "ordinal", "block_id", "kind", "level", F.sha2("text", 256).alias("text"))


@query("join6_anchor_sidecar", W + sql.BLOCKS + """, m AS (SELECT slug, block_id, ordinal, hash_ FROM (SELECT *, ordinal % 17 AS hash_ FROM blocks))
SELECT slug, block_id, 'not in the sidecar' AS problem FROM m WHERE hash_ = 3 AND ordinal % 34 = 3
UNION ALL SELECT slug, block_id, 'not in the body' FROM m WHERE hash_ = 5 AND ordinal % 34 = 5""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies lose some blocks, sidecars others; both directions are found."""
    rows = K.blocks(spark, sf_dir)
    bodies = B.rendered(rows.where("ordinal % 34 <> 5")).select("slug", "body")
    empty = rows.select("slug").distinct().join(bodies, "slug", "left").select("slug", F.coalesce("body", F.lit("")).alias("body"))
    return B.anchored_blocks(empty, rows.where("ordinal % 34 <> 3").withColumn("confidence", F.lit(None).cast("string")))[1]


@query("src5_sidecar_blocks", W + sql.BLOCKS + " SELECT slug, ordinal, block_id, page, kind, sha256(regexp_replace(regexp_replace(text, '^\\n+', ''), '\\n+$', '')) AS text FROM blocks")
def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written with anchors and sidecar, and read again."""
    rows = K.blocks(spark, sf_dir)
    made = B.rendered(rows)
    good, _ = B.anchored_blocks(made.select("slug", "body"), rows.withColumn("confidence", F.lit(None).cast("string")))
    return good.select("slug", "ordinal", "block_id", "page", "kind", F.sha2("text", 256).alias("text"))


@query("win1_blocks", W + sql.BLOCKS + " SELECT slug, ordinal, page, kind, level, block_id, length(text) AS chars FROM blocks")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.blocks(spark, sf_dir).select("slug", "ordinal", "page", "kind", "level", "block_id", F.length("text").alias("chars"))


@query("win2_sections", W + sql.SECTIONS + " SELECT * FROM sections")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sections(spark, sf_dir)


@query("win3_chunks", W.replace("WITH", "WITH RECURSIVE") + sql.CHUNKS + " SELECT slug, chunk_index, section_index, block_first, block_last, page_first, page_last, length(text) AS chars, sha256(text) AS text FROM chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(spark, sf_dir).withColumn("chars", F.length("text")).withColumn("text", F.sha2("text", 256))


@query("win17_table_pieces", """WITH RECURSIVE o AS (SELECT o_custkey // 20 AS g, o_orderkey::VARCHAR AS a, o_totalprice::VARCHAR AS b FROM orders),
l AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY a, b) AS i, length('| ' || a || ' | ' || b || ' |') AS n, length('| order | price |') + 1 + length('| --- | --- |') AS h FROM o),
f AS (SELECT g, i, n, h, 0 AS piece, h + 1 + n AS chars, 1 AS n_rows FROM l WHERE i = 1
  UNION ALL SELECT l.g, l.i, l.n, l.h, piece + (chars + 1 + l.n > """ + str(C.MOST) + """)::INT, CASE WHEN chars + 1 + l.n > """ + str(C.MOST) + """ THEN l.h + 2 + f.n + l.n ELSE chars + 1 + l.n END, CASE WHEN chars + 1 + l.n > """ + str(C.MOST) + """ THEN 2 ELSE n_rows + 1 END
  FROM f JOIN l ON l.g = f.g AND l.i = f.i + 1)
SELECT g, piece, max(chars) AS chars, max(n_rows) AS rows FROM f GROUP BY g, piece""")
def table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a pipe table for each 20 customers, cut between rows; a customer's orders do not grow with the table."""
    rows = K.table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 20).alias("g"), F.col("o_orderkey").cast("string").alias("a"), F.col("o_totalprice").cast("string").alias("b"))
    cells = F.sort_array(F.collect_list(F.array("a", "b")))
    tables = rows.groupBy("g").agg(T.rendered_table(F.concat(F.array(F.array(F.lit("order"), F.lit("price"))), cells)).alias("text"))
    return tables.select("g", F.posexplode(C.row_pieces(F.col("text"))).alias("piece", "text")).select("g", "piece", F.length("text").alias("chars"), (F.size(F.split("text", "\n")) - 2).alias("rows"))


@query("win14_block_ids", W + sql.BLOCKS + " SELECT slug, page, min(block_id) AS first_id, max(block_id) AS last_id, count(*) AS n FROM blocks GROUP BY slug, page")
def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.blocks(spark, sf_dir).groupBy("slug", "page").agg(F.min("block_id").alias("first_id"), F.max("block_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query("win4_embed_batches", W.replace("WITH", "WITH RECURSIVE") + sql.CHUNKS + """, c AS (SELECT slug, chunk_index AS i, length(text) AS n FROM chunks),
f AS (SELECT slug, i, n, 0 AS batch, 1 AS texts, n AS chars FROM c WHERE i = 0
  UNION ALL SELECT slug, i, n, batch + is_full::INT, CASE WHEN is_full THEN 1 ELSE texts + 1 END, CASE WHEN is_full THEN n ELSE chars + n END
  FROM (SELECT c.slug, c.i, c.n, f.batch, f.texts, f.chars, f.texts >= 32 OR f.chars + c.n > 40000 AS is_full FROM f JOIN c ON c.slug = f.slug AND c.i = f.i + 1))
SELECT slug, batch, count(*) AS texts, sum(n)::BIGINT AS chars FROM f GROUP BY slug, batch""")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's chunks in batches for the embedder: at most 32 texts and 40000 characters."""
    sizes = K.chunks(spark, sf_dir).groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.length("text").alias("n")))).alias("c"))
    rows = sizes.withColumn("batch", EM.batch_numbers(F.col("c.n")))
    return rows.select("slug", F.explode(F.arrays_zip("c", "batch")).alias("z")).groupBy("slug", F.col("z.batch").alias("batch")).agg(F.count(F.lit(1)).alias("texts"), F.sum("z.c.n").alias("chars"))


# --- manifest -------------------------------------------------------------------------------
def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = K.table(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("source_file"), F.col("o_orderkey").alias("k"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    disk = o.where("k % 7 <> 0").withColumn("sha256", F.when(F.col("k") % 5 == 0, F.sha2(F.concat(F.col("k").cast("string"), F.lit("x")), 256)).otherwise(F.col("sha256")))
    manifest = o.where("k % 3 <> 0").withColumn("status", F.when(F.col("k") % 4 == 0, "missing").otherwise("present"))
    return disk, manifest


_SNAP = """o AS (SELECT 'orders/' || o_orderkey || '.csv' AS source_file, o_orderkey AS k, sha256(o_orderkey::VARCHAR) AS sha256 FROM orders),
disk AS (SELECT source_file, CASE WHEN k % 5 = 0 THEN sha256(k::VARCHAR || 'x') ELSE sha256 END AS sha256 FROM o WHERE k % 7 <> 0),
man AS (SELECT source_file, sha256, CASE WHEN k % 4 = 0 THEN 'missing' ELSE 'present' END AS status FROM o WHERE k % 3 <> 0)"""


@query("join8_manifest_diff", W + _SNAP + """ SELECT source_file, CASE WHEN d.sha256 IS NULL THEN 'missing' WHEN m.status IS NULL THEN 'added' WHEN m.sha256 <> d.sha256 THEN 'changed' WHEN m.status = 'missing' THEN 'restored' ELSE 'unchanged' END AS outcome,
coalesce(d.sha256, m.sha256) AS sha256 FROM disk d FULL JOIN man m USING (source_file)""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.diff(*_snapshots(spark, sf_dir))


_INDEX_DIFF = _SNAP + ", act AS (SELECT source_file AS slug, CASE WHEN d.sha256 IS NULL THEN 'deleted' WHEN m.sha256 IS NULL THEN 'indexed' WHEN m.sha256 = d.sha256 THEN 'unchanged' ELSE 'reindexed' END AS action FROM disk d FULL JOIN man m USING (source_file))"


def _index_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk, manifest = (x.select(F.col("source_file").alias("slug"), F.col("sha256").alias("kb_sha256")) for x in _snapshots(spark, sf_dir))
    return M.index_diff(disk, manifest)


@query("join7_index_diff", W + _INDEX_DIFF + " SELECT * FROM act")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index_actions(spark, sf_dir)


@query("agg14_run_summary", W + _INDEX_DIFF + " SELECT count(*) FILTER (action = 'indexed') AS indexed, count(*) FILTER (action = 'reindexed') AS reindexed, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'deleted') AS deleted FROM act")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_summary(_index_actions(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries whose names clash now and then."""
    d = K.documents(spark, sf_dir)
    return d.select("source_file", T.slug_of(F.concat(F.lit("a/"), (F.col("doc_id") % 97).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".").otherwise("-"), F.lit("pdf"))).alias("slug"), F.when(F.col("doc_id") % 10 == 0, "missing").otherwise("present").alias("status"))


_ENTRIES = sql.DOCS + ", ent AS (SELECT source_file, 'a__' || (doc_id % 97) || '-pdf' AS slug, CASE WHEN doc_id % 10 = 0 THEN 'missing' ELSE 'present' END AS status FROM docs)"


@query("agg6_shared_slugs", W + _ENTRIES + " SELECT slug, count(*) AS n, string_agg(source_file, ',' ORDER BY source_file) AS sources FROM ent WHERE status = 'present' GROUP BY slug HAVING count(*) > 1")
def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shared_slugs(_entries(spark, sf_dir)).select("slug", F.size("sources").cast("long").alias("n"), F.array_join("sources", ",").alias("sources"))


@query("sink1_manifest_save", W + _ENTRIES + """ SELECT '{"slug":"' || slug || '","source_file":"' || source_file || '","status":"' || status || '"}' AS value FROM ent""")
def manifest_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.saved(_entries(spark, sf_dir))


@query("fil3_only", W + _ENTRIES + " SELECT * FROM ent WHERE contains(lower(source_file), 'src1/') OR contains(slug, 'src1/') UNION SELECT * FROM ent WHERE lower(source_file) LIKE 'src2/%.md' OR slug LIKE 'src2/%.md'")
def only(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return M.selected(e, "SRC1/").unionByName(M.selected(e, "src2/*.md"))


@query("sink4_superseded", W + sql.DOCS + """, outs AS (SELECT 'kb/' || slug || CASE WHEN doc_id % 6 = 0 THEN '-old' ELSE '' END || '.md' AS path, source_file, slug FROM docs)
SELECT path, source_file, 'kb/' || slug || '.md' AS now FROM outs WHERE path <> 'kb/' || slug || '.md'""")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.documents(spark, sf_dir)
    outs = d.select(F.concat(F.lit("kb/"), "slug", F.when(F.col("doc_id") % 6 == 0, "-old").otherwise(""), F.lit(".md")).alias("path"), "source_file")
    return M.superseded(outs, d.select("source_file", "slug", F.lit("present").alias("status")))


@query("sink4_foreign_owner", W + sql.DOCS + " SELECT source_file, 'kb/' || slug || '.md' AS path, source_file || '2' AS owner FROM docs WHERE doc_id % 9 = 0")
def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.documents(spark, sf_dir)
    outs = d.select(F.concat(F.lit("kb/"), "slug", F.lit(".md")).alias("path"), F.concat("source_file", F.when(F.col("doc_id") % 9 == 0, "2").otherwise("")).alias("source_file"))
    return M.foreign_owners(outs, d.select("source_file", "slug", F.lit("present").alias("status")))


@query("cli_prune", W + sql.DOCS + " SELECT 'kb/' || slug || '.md' AS path, source_file FROM docs WHERE doc_id % 8 = 1")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.documents(spark, sf_dir)
    outs = d.select(F.concat(F.lit("kb/"), "slug", F.lit(".md")).alias("path"), "source_file")
    return M.prunable(outs, d.select("source_file", "slug", F.when(F.col("doc_id") % 8 == 1, "missing").otherwise("present").alias("status")))


@query("conv_status", W + sql.DOCS + """ SELECT source_file, slug, CASE WHEN doc_id % 10 = 0 THEN 'skipped' WHEN doc_id % 10 = 1 THEN 'stale manifest' WHEN doc_id % 10 = 2 THEN 'stop_and_ask'
WHEN doc_id % 10 = 3 THEN 'foreign owner' WHEN doc_id % 10 = 4 AND doc_id % 4 <> 0 THEN 'unchanged' WHEN doc_id % 10 = 5 THEN 'failed' WHEN source_format = 'pdf' AND text_class = 'needs_ocr' THEN 'stub' ELSE 'convert' END AS status FROM docs""")
def conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = K.documents(spark, sf_dir), F.col("doc_id") % 10
    entries = d.select(
        "source_file", "slug", "source_format", F.col("kb_sha256").alias("sha256"), F.when(r == 0, F.lit(None)).when(r == 1, F.lit("other")).otherwise(F.col("kb_sha256")).alias("disk_sha256"),
        F.when(r == 2, "error").otherwise(F.col("text_class")).alias("text_class"), F.when(r == 4, F.col("kb_sha256")).alias("converted_sha256"), F.when(r == 5, "broken").alias("conversion_error"),
    )
    outs = d.where(r.isin(3, 4)).select(F.concat(F.lit("kb/"), "slug", F.lit(".md")).alias("path"), F.when(r == 3, "someone").otherwise(F.col("source_file")).alias("source_file"), (F.col("doc_id") % 4 != 0).alias("has_sidecar"))
    return M.conversion_status(entries, outs)


@query("pred3_index_conflict", "SELECT 'embed_dim' AS key, 'index has 64, run has 32' AS problem")
def conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = K.table(spark, sf_dir, "embeddings").select(F.size("embedding").cast("string").alias("value")).limit(1).withColumn("key", F.lit("embed_dim"))
    meta = size.select("key", "value").unionByName(spark.createDataFrame([("embed_model", "m")], "key string, value string"))
    return M.index_conflict(meta, "m", 32, "abc")


@query("pred4_credentials", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'revoked' WHEN ts <= TIMESTAMP '2024-01-15 00:00:00' THEN 'expired' ELSE 'valid' END AS status FROM events""")
def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("expires"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("revoked"))
    return M.credential_status(rows, F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).select("event_id", "status")


@query("ops_audit_rollup", "SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, max(value) AS slowest FROM events GROUP BY event_type")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("users"), F.max("value").alias("slowest"))


# --- lookups --------------------------------------------------------------------------------
def _kb(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return K.stored_kb(spark, sf_dir)


_COUNTS = """, cnt AS (SELECT slug, count(*) AS sections FROM sections GROUP BY slug), pg AS (SELECT slug, max(page) AS page_count FROM blocks GROUP BY slug)"""


@query("api3_list_documents", W + sql.SECTIONS + _COUNTS + " SELECT 'doc:' || slug AS id, title, doc_date, text_class, page_count, coalesce(sections, 0) AS sections, chars FROM docs LEFT JOIN cnt USING (slug) LEFT JOIN pg USING (slug)")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.list_documents(_kb(spark, sf_dir))


@query("fil2_list_filtered", W + sql.SECTIONS + _COUNTS + " SELECT 'doc:' || slug AS id, title, doc_date, text_class, page_count, coalesce(sections, 0) AS sections, chars FROM docs LEFT JOIN cnt USING (slug) LEFT JOIN pg USING (slug) WHERE text_class = 'clean' AND title ILIKE '%MENT 1_%'")
def list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.list_documents(_kb(spark, sf_dir), "clean", "MENT 1_")


_CHARS = ", ch AS (SELECT s.slug, s.section_index, length(coalesce(string_agg(b.text, chr(10) || chr(10) ORDER BY b.ordinal), '')) AS chars FROM sections s LEFT JOIN blocks b ON b.slug = s.slug AND b.ordinal BETWEEN s.block_first AND s.block_last GROUP BY ALL)"


@query("agg8_section_chars", W + sql.SECTIONS + _CHARS + " SELECT * FROM ch")
def section_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.section_chars(_kb(spark, sf_dir))


@query("api4_outline", W + sql.SECTIONS + _CHARS + " SELECT 'sec:' || slug || ':' || section_index AS id, slug, section_index, level, heading, page_first, page_last, chars FROM sections JOIN ch USING (slug, section_index)")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.outline(_kb(spark, sf_dir))


@query("cut1_bounded_outline", W + sql.SECTIONS + """, ct AS (SELECT slug, section_index, level, 'sec:' || slug || ':' || section_index AS id, length('- sec:' || slug || ':' || section_index || ' ' || coalesce(heading, '')) + 1 AS n FROM sections),
cm AS (SELECT slug, min(level) AS least, """ + ", ".join(f"coalesce(sum(n) FILTER (level <= {k}), 0) AS s{k}" for k in range(1, 7)) + """ FROM ct GROUP BY slug),
cp AS (SELECT slug, CASE """ + " ".join(f"WHEN s{k} <= 300 AND {k} >= least THEN {k}" for k in range(6, 0, -1)) + """ ELSE greatest(least, 1) END AS most FROM cm),
cr AS (SELECT ct.*, sum(n) OVER (PARTITION BY slug ORDER BY section_index) AS used, row_number() OVER (PARTITION BY slug ORDER BY section_index) AS nth FROM ct JOIN cp USING (slug) WHERE level <= most)
SELECT id, slug, section_index, level FROM cr WHERE used <= 300 OR nth = 1""")
def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.outline(_kb(spark, sf_dir)).withColumn("line", F.concat(F.lit("- "), "id", F.lit(" "), F.coalesce("heading", F.lit(""))))
    return L.bounded_outline(lines, 300).select("id", "slug", "section_index", "level")


@query("agg7_section_text", W + sql.SECTIONS + " SELECT s.slug, s.section_index, sha256(string_agg(b.text, chr(10) || chr(10) ORDER BY b.ordinal)) AS text FROM sections s JOIN blocks b ON b.slug = s.slug AND b.ordinal BETWEEN s.block_first AND s.block_last GROUP BY ALL")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.sections(spark, sf_dir).select("slug", "section_index", "block_first", "block_last")
    rows = s.join(K.blocks(spark, sf_dir).select("slug", "ordinal", "text"), "slug").where("ordinal BETWEEN block_first AND block_last")
    return rows.groupBy("slug", "section_index").agg(F.sha2(L.joined_text(), 256).alias("text"))


@query("agg9_page_ranges", W + sql.SECTIONS + " SELECT slug, min(page_first) AS page_first, max(page_last) AS page_last, max(section_index) + 1 AS sections FROM sections GROUP BY slug")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sections(spark, sf_dir).groupBy("slug").agg(F.min("page_first").alias("page_first"), F.max("page_last").alias("page_last"), (F.max("section_index") + 1).alias("sections"))


_ONE = "doc-8"


@query("api2_fetch_section", W + sql.SECTIONS + f" SELECT 'sec:{_ONE}:0' AS id, string_agg(b.text, chr(10) || chr(10) ORDER BY b.ordinal) AS text, min(page) AS page_first, max(page) AS page_last FROM sections s JOIN blocks b ON b.slug = s.slug AND b.ordinal BETWEEN s.block_first AND s.block_last WHERE s.slug = '{_ONE}' AND s.section_index <= 1")
def fetch_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.get_section(K.kb(spark, sf_dir), f"sec:{_ONE}:0", neighbours=1).select("id", "text", "page_first", "page_last")


@query("fil4_fetch_page", W + sql.BLOCKS + f" SELECT 'page:{_ONE}:p001' AS id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text, arg_min(block_id, ordinal) AS first_block, arg_max(block_id, ordinal) AS last_block FROM blocks WHERE slug = '{_ONE}' AND page = 1")
def fetch_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fetch(K.kb(spark, sf_dir), f"page:{_ONE}:p001").select("id", "text", "first_block", "last_block")


@query("api2_fetch_chunk", W.replace("WITH", "WITH RECURSIVE") + sql.CHUNKS + f" SELECT 'chunk:{_ONE}:0' AS id, text, length(text) AS chars FROM chunks WHERE slug = '{_ONE}' AND chunk_index = 0")
def fetch_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fetch(K.kb(spark, sf_dir), f"chunk:{_ONE}:0").select("id", "text", "chars")


@query("api6_bounded_reply")
def bounded_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = K.kb(spark, sf_dir)  # of one document: nothing is made of the others
    return L.fetch(kb, f"sec:{_ONE}:0", most_chars=50).unionByName(L.fetch(kb, f"doc:{_ONE}", most_chars=200)).select("id", "kind", "chars", "truncated", "text")


@query("fil5_block_range", W + sql.BLOCKS + " SELECT slug, ordinal, block_id FROM blocks WHERE ordinal BETWEEN 2 AND 4")
def block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.block_range(K.blocks(spark, sf_dir), 2, 4).select("slug", "ordinal", "block_id")


@query("fil6_overlap", W.replace("WITH", "WITH RECURSIVE") + sql.CHUNKS + " SELECT slug, chunk_index FROM chunks WHERE block_last >= 3 AND block_first <= 5")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.overlapping(K.chunks(spark, sf_dir), 3, 5).select("slug", "chunk_index")


@query("fil7_page_section", W + sql.SECTIONS + """, c AS (SELECT *, page_first <= 2 AND page_last >= 2 AS inside FROM sections WHERE page_first IS NOT NULL)
SELECT slug, arg_min(section_index, (CASE WHEN inside THEN 0 ELSE 1000000 + abs(page_first - 2) * 1000 END) + section_index / 1e6) AS section_index FROM c GROUP BY slug""")
def page_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's section for page 2: the first that holds it, else the first of the nearest."""
    return L.page_sections(K.sections(spark, sf_dir), 2)


@query("topk2_first_last_block", W + sql.BLOCKS + " SELECT slug, arg_min(block_id, ordinal) AS first_block, arg_max(block_id, ordinal) AS last_block FROM blocks GROUP BY slug")
def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.blocks(spark, sf_dir).groupBy("slug").agg(*L.end_blocks())


@query("win15_neighbours", W + sql.SECTIONS + " SELECT slug, section_index, greatest(0, section_index - 2) AS lo, least(max(section_index) OVER (PARTITION BY slug), section_index + 2) AS hi FROM sections")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.neighbour_ranges(K.sections(spark, sf_dir), 2)


@query("win16_signposts", W.replace("WITH", "WITH RECURSIVE") + sql.CHUNKS + """, g AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY chunk_index) - 1 AS i, greatest(1, ceil(count(*) OVER (PARTITION BY slug) / 12.0))::BIGINT AS step FROM chunks)
SELECT slug, chunk_index FROM g WHERE i % step = 0""")
def signposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.signposts(K.chunks(spark, sf_dir)).select("slug", "chunk_index")


@query("join4_sections_blocks", W + sql.SECTIONS + " SELECT s.slug, s.section_index, count(b.ordinal) AS blocks, coalesce(sum(length(b.text)), 0)::BIGINT AS chars FROM sections s LEFT JOIN blocks b ON b.slug = s.slug AND b.ordinal BETWEEN s.block_first AND s.block_last GROUP BY ALL")
def sections_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join that keeps the slug as its equi key, so it hashes."""
    s, b = K.sections(spark, sf_dir).select("slug", "section_index", "block_first", "block_last").alias("s"), K.blocks(spark, sf_dir).select("slug", "ordinal", F.length("text").alias("n")).alias("b")
    on = (F.col("s.slug") == F.col("b.slug")) & F.col("b.ordinal").between(F.col("s.block_first"), F.col("s.block_last"))
    return s.join(b, on, "left").groupBy(F.col("s.slug").alias("slug"), "section_index").agg(F.count("ordinal").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))


@query("join4_lineitem_ranges", """WITH r AS (SELECT o_orderkey, 1 + o_orderkey % 3 AS lo, 3 + o_orderkey % 3 AS hi FROM orders)
SELECT o_orderkey, count(l_linenumber) AS lines, coalesce(round(sum(l_extendedprice), 2), 0) AS price FROM r LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN lo AND hi GROUP BY o_orderkey""")
def lineitem_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = K.table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 3).alias("lo"), (3 + F.col("o_orderkey") % 3).alias("hi"))
    items = K.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    rows = r.join(items, (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_linenumber").between(F.col("lo"), F.col("hi")), "left")
    return rows.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("lines"), F.coalesce(F.round(F.sum("l_extendedprice"), 2), F.lit(0.0)).alias("price"))


@query("hlth1_health", "SELECT count(*) AS documents FROM documents")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.health({"documents": K.documents(spark, sf_dir)})
